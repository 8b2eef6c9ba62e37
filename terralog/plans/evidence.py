"""Queries of the grounding, corpus, retrieval, decision and source operators, with their SQL."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.operators import corpus, decisions, grounding, heat, retrieval, scorecard
from terralog.plans import climate
from terralog.plans.climate import rounded, table
from terralog.sources import files, layers, payloads

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def reports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Claims: all documents. Source of a claim: the document of the next id, one a report."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), "text")
    shifted = d.select((F.col("report_id") - 1).alias("report_id"), "text")
    return d, shifted


NUM = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?%?"


def strip_sql(text: str) -> str:
    """The text without what names things and states no value."""
    patterns = [
        (r"\bt\s*\+\s*\d\b", "gi"), (r"\bSPI-?3\b", "gi"), (r"\bgemini-embedding-\d+\b", "gi"), (r"\bgemini-[\d.]+-flash\b", "gi"), (r"\bMcKee et al\.?,? \d{4}\b", "gi"),
        (r"(?m)^\s*\d{1,2}[.)]\s", "g"), (r"\bERSST[ .]?v?\d*\b", "gi"), (r"\bHadISST[\d.]*\b", "gi"), (r"\b\d{4}-\d{1,2}(?:-\d{1,2})?\b", "g"),
    ]
    for p, flags in patterns:
        text = f"regexp_replace({text}, '{p}', ' ', '{flags}')"
    return text


PARSED = r"""try_cast(regexp_replace(token, '[,%+]', '', 'g') AS DOUBLE) AS value, length(regexp_extract(token, '\.(\d+)', 1))::INT AS decimals, ends_with(token, '%') AS is_percent"""


def claims_sql(name: str, rows: str, text: str) -> str:
    """Table ``name`` of the numbers of ``text`` of the table ``rows``, without years, by ``report_id`` and ``place``."""
    return rf"""{name}_0 AS (SELECT report_id, unnest(list_zip(range(len(x)), x)) AS z FROM (SELECT report_id, regexp_extract_all({strip_sql(text)}, '{NUM}') AS x FROM {rows})),
    {name}_1 AS (SELECT report_id, z[1]::INT AS place, z[2] AS token FROM {name}_0), {name}_2 AS (SELECT *, {PARSED} FROM {name}_1),
    {name} AS (SELECT * FROM {name}_2 WHERE value IS NOT NULL AND NOT (decimals = 0 AND NOT is_percent AND abs(value) BETWEEN 1900 AND 2100))"""


def hits_sql(claims: str, sources: str, on: str) -> str:
    """Table ``hit`` of the numbers that a source (``raw``) has: as written, at the claim's decimals, or within the tolerance.

    ``on`` joins claims ``c`` and sources ``s``.
    """
    return rf"""src AS (SELECT * FROM {sources} WHERE regexp_matches(raw, '\d')),
    sv_0 AS (SELECT * EXCLUDE raw, unnest(regexp_extract_all(raw, '{NUM}')) AS token FROM src), sv_1 AS (SELECT * EXCLUDE token, {PARSED} FROM sv_0),
    sv AS (SELECT * EXCLUDE (value, decimals, is_percent), value AS v FROM sv_1 UNION SELECT * EXCLUDE (value, decimals, is_percent), value / 100 FROM sv_1 WHERE is_percent),
    cv AS (SELECT *, value AS v FROM {claims} UNION ALL SELECT *, value / 100 FROM {claims} WHERE is_percent),
    hit AS (SELECT DISTINCT c.report_id, c.place FROM {claims} c JOIN src s ON {on} WHERE regexp_matches(s.raw, '(^|[^0-9.])' || regexp_escape(rtrim(c.token, '%')) || '($|[^0-9])')
            UNION SELECT c.report_id, c.place FROM cv c JOIN sv s ON {on} WHERE round_even(c.v, c.decimals) = round_even(s.v, c.decimals) OR abs(c.v - s.v) <= 5e-5)"""


SUMMED = """bad AS (SELECT report_id, string_agg(token, ' ' ORDER BY place) AS unverified, count(*) AS n_unverified FROM c ANTI JOIN hit USING (report_id, place) GROUP BY 1),
    n AS (SELECT report_id, count(*) AS n_checked FROM c GROUP BY 1)"""
STATUS = "coalesce(n_checked, 0) AS n_checked, coalesce(n_unverified, 0) AS n_unverified, coalesce(unverified, '') AS unverified, CASE WHEN trim(coalesce(raw, '')) = '' THEN 'not_generated' WHEN unverified IS NULL THEN 'clean' ELSE 'warning' END AS status"
DOCS = "docs AS (SELECT doc_id AS report_id, source, text AS raw FROM documents)"


@query(f"WITH {DOCS}, {claims_sql('c', 'docs', 'raw')} SELECT report_id, place, token, value, decimals, is_percent FROM c")
def grounding_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.numbers(reports(spark, sf)[0], "report_id", "text").select("report_id", "place", "token", "value", "decimals", "is_percent")


@query(f"""WITH {DOCS}, nxt AS (SELECT report_id - 1 AS report_id, raw FROM docs), {claims_sql('c', 'docs', 'raw')}, {hits_sql('c', 'nxt', 'c.report_id = s.report_id')}, {SUMMED},
    g AS (SELECT report_id, count(DISTINCT v) AS n_source_numbers FROM sv GROUP BY 1)
    SELECT report_id, {STATUS}, coalesce(n_source_numbers, 0) AS n_source_numbers FROM docs LEFT JOIN n USING (report_id) LEFT JOIN bad USING (report_id) LEFT JOIN g USING (report_id)""")
def grounding_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against the document of the next id, its only source."""
    claims, sources = reports(spark, sf)
    return grounding.check(claims, sources, "report_id", "text")


@query(f"""WITH {DOCS}, {claims_sql('c0', 'docs', 'raw')}, c AS (SELECT c0.*, source FROM c0 JOIN docs USING (report_id)), {hits_sql('c', 'docs', 's.source = c.source AND s.report_id <> c.report_id')}, {SUMMED}
    SELECT report_id, {STATUS} FROM docs LEFT JOIN n USING (report_id) LEFT JOIN bad USING (report_id)""")
def grounding_source_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against all other documents of its source."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), "source", "text")
    return grounding.check(d, d, "report_id", "text", "source")


@query(rf"""WITH {DOCS}, t AS (SELECT report_id, list_distinct(regexp_extract_all(raw, '{NUM}')) AS grounded FROM docs),
    l AS (SELECT report_id, grounded, list_distinct(list_transform(grounded, lambda x: replace(rtrim(x, '%'), ',', '') || '7')) AS fabricated FROM t WHERE len(grounded) > 0),
    r AS (SELECT report_id, array_to_string(list_concat(grounded, fabricated), ' ') AS body FROM l), {claims_sql('c', 'r', 'body')}, {hits_sql('c', 'docs', 'c.report_id = s.report_id')},
    f AS (SELECT report_id, list_distinct(list(token)) AS flagged FROM c ANTI JOIN hit USING (report_id, place) GROUP BY 1),
    k AS (SELECT l.*, coalesce(flagged, []) AS flagged FROM l LEFT JOIN f USING (report_id)),
    n AS (SELECT lang, sum(len(list_intersect(flagged, fabricated)))::BIGINT AS tp, sum(len(list_filter(flagged, lambda x: NOT list_contains(fabricated, x))))::BIGINT AS fp, sum(len(list_filter(fabricated, lambda x: NOT list_contains(flagged, x))))::BIGINT AS fn,
          sum(len(list_filter(grounded, lambda x: NOT list_contains(flagged, x))))::BIGINT AS tn FROM k JOIN documents ON doc_id = report_id GROUP BY 1),
    p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS r FROM n)
    SELECT lang, tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM p""")
def grounding_checker_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The checker's scores, by language, on reports of a document's numbers and as many fabricated ones (a digit longer)."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), "lang", "text")
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(grounding.NUMBER), F.lit(0)))
    longer = F.array_distinct(F.transform("grounded", lambda x: F.concat(F.replace(F.rtrim(x, F.lit("%")), F.lit(","), F.lit("")), F.lit("7"))))
    cases = d.withColumn("grounded", found).where(F.size("grounded") > 0).withColumn("fabricated", longer)
    cases = cases.select("report_id", "lang", "grounded", "fabricated", F.array_join(F.concat("grounded", "fabricated"), " ").alias("text"))
    each = grounding.case_scores(cases, d.select("report_id", "text"), "report_id", "text").join(d.select("report_id", "lang"), "report_id")
    c = each.groupBy("lang").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")))
    p, r, f1 = grounding.ratios(*(F.col(x).cast("double") for x in ("tp", "fp", "fn")))
    return rounded(c.select("lang", "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), f1.alias("f1")))


def user_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """``name, payload``: of each user one JSON text with what happened, nested by type of event, and the days."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value", F.to_date("ts").alias("day"))
    money = lambda c: F.round(c, 2).cast("decimal(18,2)")
    kinds = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), money(F.sum("value")).alias("total"), F.max("day").cast("string").alias("last_day"))
    entry = F.struct(F.col("event_type").alias("kind"), F.struct("n", "total").alias("sums"), F.array("last_day").alias("days"))
    u = kinds.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("kinds"), F.sum("n").alias("n_events"), F.sum("total").alias("total"))
    return u.select("user_id", F.concat(F.lit("users/"), "user_id").alias("name"), F.to_json(F.struct("user_id", F.struct("n_events", "total").alias("all"), "kinds")).alias("payload"))


PAYLOADS = """pk AS (SELECT user_id, event_type AS kind, count(*) AS n, round(sum(value), 2)::DECIMAL(18, 2) AS total, max(ts::DATE)::VARCHAR AS last_day FROM events GROUP BY 1, 2),
    pu AS (SELECT user_id, list({'kind': kind, 'sums': {'n': n, 'total': total}, 'days': [last_day]} ORDER BY kind) AS kinds, sum(n)::BIGINT AS n_events, sum(total)::DECIMAL(28, 2) AS total FROM pk GROUP BY 1),
    pay AS (SELECT user_id, n_events, total, 'users/' || user_id AS name, to_json({'user_id': user_id, 'all': {'n_events': n_events, 'total': total}, 'kinds': kinds})::VARCHAR AS payload FROM pu)"""


@query(f"""WITH {PAYLOADS}
    SELECT name, j.fullkey AS path, CASE WHEN j.type = 'VARCHAR' THEN j.atom->>'$' ELSE round((j.atom->>'$')::DOUBLE, 2)::VARCHAR END AS scalar
    FROM pay, json_tree(pay.payload) AS j WHERE j.type NOT IN ('OBJECT', 'ARRAY', 'NULL')""")
def source_json_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Every scalar of every user's payload with its path."""
    p = user_payloads(spark, sf).select("name", F.parse_json("payload").alias("v"))
    number = F.col("scalar").try_cast("double")
    return scorecard.leaves(p, "v").select("name", "path", F.when(number.isNull(), F.col("scalar")).otherwise(F.round(number, 2).cast("string")).alias("scalar"))


def cards(u: DataFrame) -> DataFrame:
    """A report of each user of ``user_payloads``, of sections that cite payloads: true numbers, one that no source has, a missing and no source."""
    n = F.parse_json("payload")
    count, total = F.variant_get(n, "$.all.n_events", "long"), F.variant_get(n, "$.all.total", "decimal(28,2)")
    text = F.concat(
        F.lit("# Report 7\nAll of it, as phase 3 says.\n*Source: `users/"), "user_id", F.lit("`*\n\n## Events\nThere were "), count.cast("string"), F.lit(" events worth "), total.cast("string"), F.lit(" (§5).\n*Source: `users/"), "user_id",
        F.lit("` and\n`none/9`*\n## Forecast\nNext time t+1 it will be "), (total + 1).cast("decimal(28,2)").cast("string"), F.lit(", or "), (count * 10 + 3).cast("string"), F.lit(".\n*Source: `users/"), "user_id",
        F.lit("`*\n## Elsewhere\nSome 12 of 13.\n*Source: `none/9`, `x`*\n## Open\nAbout 14.\n*Source: memory*\n## No line\n15.\n"))
    return u.select("user_id", text.alias("text"))


@query(f"""WITH {PAYLOADS}, cl(section, heading, body, n_cited, missing) AS (VALUES (0, '', 'card', 1, ''), (1, 'Events', 'events', 2, 'none/9'), (2, 'Forecast', 'forecast', 1, ''), (3, 'Elsewhere', 'elsewhere', 1, 'none/9'), (4, 'Open', 'open', 0, '')),
    docs AS (SELECT user_id * 10 + section AS report_id, user_id, name, section, heading, n_cited, missing, payload AS source,
        CASE body WHEN 'card' THEN '# Report 7 All of it, as   says.' WHEN 'events' THEN 'There were ' || n_events || ' events worth ' || total || ' ( ).' WHEN 'forecast' THEN 'Next time t+1 it will be ' || (total + 1)::DECIMAL(28, 2) || ', or ' || (n_events * 10 + 3) || '.'
             WHEN 'elsewhere' THEN 'Some 12 of 13.' ELSE 'About 14.' END AS raw FROM pay, cl),
    given AS (SELECT report_id, source AS raw FROM docs WHERE section < 3), {claims_sql('c', 'docs', 'raw')}, {hits_sql('c', 'given', 'c.report_id = s.report_id')}, {SUMMED}
    SELECT user_id, section, heading, n_cited::BIGINT AS n_cited, missing, coalesce(n_checked, 0) AS n_checked, CASE WHEN section < 3 THEN coalesce(unverified, '') ELSE '' END AS unverified,
        CASE WHEN n_cited = 0 THEN 'uncited' WHEN section = 3 THEN 'unchecked' WHEN unverified IS NULL THEN 'clean' ELSE 'warning' END AS status
    FROM docs LEFT JOIN n USING (report_id) LEFT JOIN bad USING (report_id)""")
def grounding_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Every section of every user's report against the JSON payloads that it cites."""
    u = files.stored(user_payloads(spark, sf))
    p = u.select("name", F.parse_json("payload").alias("v"))
    return scorecard.check(scorecard.sections(cards(u), "user_id", "text"), scorecard.readable(p, "v"), "user_id")


#: A character reference as a browser finds it in text: a number, or a name, with or without its semicolon.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def references_sql() -> str:
    """Tables of what references stand for: names of the HTML standard (some also without a semicolon), and numbers that do not stand for their own character."""
    names = ", ".join(f"({quoted(name)}, [{', '.join(str(ord(c)) for c in chars)}])" for name, chars in html5.items())
    old = ", ".join(f"({n}, {ord(bytes([n]).decode('cp1252'))})" for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    return f"named(name, points) AS (VALUES {names}), renumbered(n, point) AS (VALUES (0, 65533), (13, 13), {old}, {', '.join(f'({n}, {n})' for n in (0x81, 0x8D, 0x8F, 0x90, 0x9D))})"


def unescaped_sql(name: str, rows: str) -> str:
    """Table ``name`` of ``page_id, t`` of the table ``rows`` with its character references resolved.

    A number stands for its character, for that of windows-1252 from 128 to 159, for U+FFFD where there is none, and for
    nothing where it is a control or no character. Of a name the longest known start counts; unknown ones stay.
    """
    return rf"""{name}_p AS (SELECT page_id, regexp_split_to_array(t, '{REFERENCE}') AS x, regexp_extract_all(t, '{REFERENCE}') AS m FROM {rows}),
    {name}_d AS (SELECT DISTINCT unnest(m) AS ref FROM {name}_p),
    {name}_i AS (SELECT ref, CASE WHEN regexp_matches(ref, '^&#[xX]') THEN try_cast('0x' || regexp_extract(ref, '[xX]0*([0-9a-fA-F]*)', 1) AS BIGINT) ELSE try_cast(regexp_extract(ref, '[0-9]+') AS BIGINT) END AS n FROM {name}_d WHERE ref[2] = '#'),
    {name}_r AS (SELECT ref, CASE WHEN point IS NOT NULL THEN chr(point::INT) WHEN {name}_i.n IS NULL OR {name}_i.n > 1114111 OR {name}_i.n BETWEEN 55296 AND 57343 THEN chr(65533)
            WHEN {name}_i.n BETWEEN 1 AND 8 OR {name}_i.n = 11 OR {name}_i.n BETWEEN 14 AND 31 OR {name}_i.n = 127 OR {name}_i.n BETWEEN 64976 AND 65007 OR {name}_i.n % 65536 >= 65534 THEN '' ELSE chr({name}_i.n::INT) END AS c
            FROM {name}_i LEFT JOIN renumbered ON renumbered.n = {name}_i.n
        UNION ALL SELECT ref, coalesce(arg_max(array_to_string(list_transform(points, lambda p: chr(p)), '') || substring(ref, length(name) + 2), length(name)), ref) FROM {name}_d LEFT JOIN named ON starts_with(substring(ref, 2), name) WHERE ref[2] <> '#' GROUP BY ref),
    {name}_m AS (SELECT map(list(ref), list(c)) AS known FROM {name}_r),
    {name} AS (SELECT page_id, array_to_string(list_transform(list_zip(x, list_append(list_transform(m, lambda r: known[r]), '')), lambda z: z[1] || z[2]), '') AS t FROM {name}_p, {name}_m)"""


def without_sql(text: str) -> str:
    """The page without comments and what is not shown."""
    for name in ("script", "style", "noscript", "svg"):
        text = rf"regexp_replace({text}, '(?is)<{name}\b.*?</{name}\s*>', ' ', 'g')"
    return rf"regexp_replace({text}, '(?s)<!--.*?-->', '', 'g')"


HTML = rf"""{references_sql()},
    h0 AS (SELECT page_id, {without_sql("coalesce(html, '')")} AS t FROM pages),
    h1 AS (SELECT page_id, regexp_replace(t, '(?s)<[^>]*>', chr(10), 'g') AS t FROM h0), {unescaped_sql("h2", "h1")},
    h AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x{{a0}}]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS text FROM h2)"""


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", corpus.page(F.col("html"))["text"].alias("text"))


TITLE = rf"""t0 AS (SELECT page_id, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages), {unescaped_sql("t1", "t0")}"""


@query(rf"WITH {HTML}, {TITLE} SELECT page_id, trim(regexp_replace(t1.t, '[ \t\r\n\f\x{{a0}}]+', ' ', 'g'), ' ') AS title, h.text FROM h JOIN t1 USING (page_id)")
def corpus_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", corpus.page(F.col("html")).alias("p")).select("page_id", "p.title", "p.text")


@query(rf"""WITH {HTML}, a AS (SELECT page_id, length(text) AS chars, (2000 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) + length(text)) // nullif(2 * length(text), 0) / 1000 AS alpha_ratio,
        CASE WHEN length(text) < 500 THEN 'too short' WHEN contains(lower(substring(text, 1, 400)), 'page not found') THEN 'page not found' END AS r FROM h)
    SELECT page_id, chars::INT AS chars, alpha_ratio, CASE WHEN r IS NOT NULL THEN r WHEN coalesce(alpha_ratio, 0) < 0.5 THEN 'not text' END AS reason, r IS NULL AND coalesce(alpha_ratio, 0) >= 0.5 AS usable FROM a""")
def corpus_gate(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.gate(page_texts(spark, sf)).select("page_id", "chars", "alpha_ratio", "reason", "usable")


HEAD = r"regexp_replace(regexp_replace(html, '<h([1-3])[^>]*>', chr(10) || '# ', 'g'), '</h[1-3]>', chr(10), 'g')"


@query(rf"""WITH l AS (SELECT page_id, unnest(list_zip(range(len(x)), x)) AS z FROM (SELECT page_id, string_split({HEAD}, chr(10)) AS x FROM pages)),
    n AS (SELECT page_id, z[1] AS pos, z[2] AS line, sum(regexp_matches(z[2], '^#{{1,3}}\s')::INT) OVER (PARTITION BY page_id ORDER BY z[1]) AS section FROM l)
    SELECT page_id, section::BIGINT AS section, max(CASE WHEN regexp_matches(line, '^#{{1,3}}\s') THEN trim(regexp_replace(line, '^#+', ''), ' ') END) AS heading, trim(string_agg(line, chr(10) ORDER BY pos), ' ') AS body FROM n GROUP BY 1, 2""")
def corpus_sections(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.regexp_replace(F.regexp_replace("html", "<h([1-3])[^>]*>", "\n# "), "</h[1-3]>", "\n")
    return corpus.sections(table(spark, sf, "pages").select("page_id", marked.alias("text")), "page_id")


@query()
def corpus_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: packing with overlap is sequential. Tested against its rules."""
    return corpus.chunks(table(spark, sf, "documents"), "doc_id")


@query()
def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL, as it counts the chunks of ``corpus_chunks``."""
    d = corpus.gate(table(spark, sf, "documents"))
    return corpus.manifest(d, corpus.chunks(d.where("usable"), "doc_id"), "doc_id")


RANKED = """q AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, q.label AS query_label, vec_id, e.label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e WHERE vec_id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)"""


def ranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 50 = 0")
    return retrieval.top_k(q, v, 5), q, v


@query(f"WITH {RANKED} SELECT query_id, vec_id, round(score, 4) AS score, rank FROM r WHERE rank <= 5".replace("round(score, 4)", "score"))
def retrieval_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf)[0]


@query(f"""WITH {RANKED}, f AS (SELECT query_id, min(rank) AS first_rank FROM r WHERE rank <= 5 AND label = query_label GROUP BY 1)
    SELECT label, count(*) AS n_queries, round(avg(CASE WHEN first_rank <= 5 THEN 1 ELSE 0 END), 6) AS precision_at_k, round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM q LEFT JOIN f USING (query_id) GROUP BY ROLLUP (label)""")
def retrieval_scores(spark: SparkSession, sf: str) -> DataFrame:
    top, q, v = ranked(spark, sf)
    queries = q.select(F.col("vec_id").alias("query_id"), "label")
    relevant = top.join(v.select("vec_id", F.col("label").alias("l")), "vec_id").join(queries, "query_id").where("l = label").select("query_id", "vec_id")
    return retrieval.scores(top, relevant, queries, "label", 5)


@query()
def retrieval_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of blocks the search of every 50th vector visits. No SQL: cells come from k-means."""
    v = table(spark, sf, "embeddings")
    return retrieval.plan(v.where("vec_id % 50 = 0"), v, 5).report()


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def retrieval_pending(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


SIGNALS = climate.FLAGS + """, cnt AS (SELECT entity_id, date_trunc('month', day)::DATE AS month, count_if(heat_day) AS heat_days, count_if(severe_day) AS severe_days, round(avg(departure), 8) AS mean_departure FROM r GROUP BY 1, 2),
    hs0 AS (SELECT *, CASE WHEN heat_days >= 3 AND severe_days > 0 THEN 2 WHEN heat_days >= 3 THEN 1 ELSE 0 END AS a, CASE WHEN mean_departure >= 4 THEN 2 WHEN mean_departure >= 3 THEN 1 ELSE 0 END AS b FROM cnt),
    hs AS (SELECT entity_id, month, true AS heat_available, ([NULL, 'moderate', 'severe'])[greatest(a, b) + 1] AS heat_severity, CASE WHEN b > a THEN 'departure' WHEN a > 0 THEN 'days' END AS heat_basis FROM hs0)"""


def heat_signals(spark: SparkSession, sf: str) -> DataFrame:
    c = heat.monthly_counts(climate.hot_days(spark, sf))
    return decisions.heat_signal(c.withColumn("mean_departure", F.round("mean_departure", 8)))


@query(f"WITH {SIGNALS} SELECT * FROM hs")
def decision_heat_signal(spark: SparkSession, sf: str) -> DataFrame:
    return heat_signals(spark, sf)


Z = f"""{climate.M}, st AS (SELECT entity_id, month(month) AS k, avg(value) AS mean, stddev_samp(value) AS std FROM m WHERE year(month) BETWEEN 1995 AND 1998 GROUP BY 1, 2),
    z AS (SELECT m.entity_id, m.month, round((value - mean) / nullif(std, 0), 6) AS predicted, CASE month(m.month) % 3 WHEN 0 THEN 'validated' WHEN 1 THEN 'weak/directional' ELSE 'no skill' END AS label FROM m JOIN st ON st.entity_id = m.entity_id AND k = month(m.month))"""


def drought_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised monthly values as the index, with a label by month, so that every rule is met."""
    m = climate.monthly(spark, sf)
    st = m.where("year(month) between 1995 and 1998").groupBy("entity_id", F.month("month").alias("k")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    z = m.withColumn("k", F.month("month")).join(st, ["entity_id", "k"])
    lab = F.when(F.month("month") % 3 == 0, "validated").when(F.month("month") % 3 == 1, "weak/directional").otherwise("no skill")
    return z.select("entity_id", F.col("month").alias("horizon"), F.round((F.col("value") - F.col("mean")) / F.nullif("std", F.lit(0.0)), 6).alias("predicted"), lab.alias("label"), F.lit(None).cast("double").alias("skill"))


DS = """ds AS (SELECT entity_id, month, predicted IS NOT NULL AS drought_available, CASE WHEN predicted < -1.5 THEN 'severe' WHEN predicted < -1 THEN 'moderate' END AS drought_severity,
    predicted IS NOT NULL AND label = 'validated' AS decisive, predicted IS NOT NULL AND label = 'weak/directional' AS corroborating, predicted IS NOT NULL AND label LIKE 'no skill%' AS no_skill, CASE WHEN predicted IS NULL THEN 'no forecast' END AS drought_reason FROM z)"""


@query(f"WITH {Z}, {DS} SELECT entity_id, month AS horizon, drought_available, drought_severity, decisive, corroborating, no_skill, drought_reason FROM ds")
def decision_drought_signal(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.drought_signal(drought_forecasts(spark, sf))


RULES = """ranks AS (SELECT *, CASE WHEN coalesce(drought_available AND decisive, false) THEN CASE drought_severity WHEN 'severe' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END ELSE 0 END AS d, CASE WHEN coalesce(heat_available, false) THEN CASE heat_severity WHEN 'severe' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END ELSE 0 END AS h,
        coalesce(drought_available AND NOT no_skill, false) OR coalesce(heat_available, false) AS usable FROM x),
    dom AS (SELECT *, CASE WHEN NOT in_season THEN 'none dominant' WHEN NOT usable THEN 'insufficient data' WHEN d > h THEN 'drought' WHEN h > 0 THEN 'heat' ELSE 'none dominant' END AS dominant,
        CASE WHEN NOT in_season THEN 'outside the sensitive months' WHEN NOT usable THEN CASE WHEN coalesce(no_skill, false) THEN 'the forecast has no skill, and heat was not observed' ELSE 'no forecast, and heat was not observed' END
             WHEN d > 0 AND h > 0 THEN CASE WHEN d > h THEN 'both, drought is higher' WHEN d = h THEN 'both are equal, the observed one counts' ELSE 'both, heat is higher' END WHEN d > 0 THEN 'drought alone' WHEN h > 0 THEN 'heat alone' ELSE 'no risk reaches the threshold' END AS reason,
        CASE WHEN NOT in_season THEN 'not applicable' WHEN NOT usable THEN 'insufficient data' WHEN d > h THEN 'validated' WHEN h > 0 THEN 'observed, not a forecast' ELSE 'no risk reaches the threshold' END AS confidence,
        CASE WHEN NOT in_season OR NOT usable THEN NULL WHEN d > h THEN drought_severity WHEN h > 0 THEN heat_severity END AS severity FROM ranks)"""
ZM = Z.replace("raw AS", "raw_m AS").replace("FROM raw ", "FROM raw_m ").replace("LEFT JOIN raw ", "LEFT JOIN raw_m ")


@query(f"""WITH {SIGNALS}, {ZM}, {DS}, x AS (SELECT coalesce(ds.entity_id, hs.entity_id) AS entity_id, coalesce(ds.month, hs.month) AS month, drought_available, drought_severity, decisive, no_skill, heat_available, heat_severity,
        month(coalesce(ds.month, hs.month)) IN (1, 2, 3, 6, 7) AS in_season FROM ds FULL JOIN hs ON ds.entity_id = hs.entity_id AND ds.month = hs.month), {RULES}
    SELECT entity_id, month, dominant, severity, confidence, reason FROM dom""")
def decision_dominant_risk(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions.drought_signal(drought_forecasts(spark, sf)).withColumnRenamed("horizon", "month")
    both = d.join(heat_signals(spark, sf), ["entity_id", "month"], "full").withColumn("in_season", F.month("month").isin(1, 2, 3, 6, 7))
    return decisions.dominant(both).select("entity_id", "month", "dominant", "severity", "confidence", "reason")


CROPS = "VALUES ('wheat', [1, 2, 3]), ('millet', [7, 8])"
CROPS_SPARK = "VALUES ('wheat', array(1, 2, 3)), ('millet', array(7, 8))"


def assessment_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Anchors half a year before each nation's last month, a given month for every third one, forecasts of the next
    three months, and the crops of each nation: millet not where the key is even."""
    z = drought_forecasts(spark, sf).withColumnRenamed("horizon", "month")
    anchors = z.groupBy("entity_id").agg(F.add_months(F.max("month"), -6).alias("anchor"))
    n = table(spark, sf, "nation").select(F.col("n_name").alias("entity_id"), "n_nationkey")
    crops = spark.sql(f"SELECT * FROM ({CROPS_SPARK}) AS v(crop, sensitive_months)")
    given = n.where("n_nationkey % 3 = 0").select("entity_id", F.lit("wheat").alias("crop"), F.lit("1999-02-01").cast("date").alias("month"))
    targets = decisions.target_month(anchors, crops, given)
    scope = n.crossJoin(crops.select("crop")).where("crop = 'wheat' or n_nationkey % 2 = 1").select("crop", "entity_id")
    ahead = z.join(anchors, "entity_id").withColumn("horizon", ((F.year("month") - F.year("anchor")) * 12 + F.month("month") - F.month("anchor")).cast("int")).where(F.col("horizon").between(1, decisions.REACH))
    return targets, scope, decisions.drought_signal(ahead.select("entity_id", "horizon", "predicted", "label")), crops


@query(f"""WITH {SIGNALS}, {ZM}, {DS}, crops AS (SELECT * FROM ({CROPS}) AS v(crop, sm)), anc AS (SELECT entity_id, (max(month) - INTERVAL 6 MONTH)::DATE AS anchor FROM z GROUP BY 1),
    giv AS (SELECT n_name AS entity_id, 'wheat' AS crop, DATE '1999-02-01' AS month FROM nation WHERE n_nationkey % 3 = 0),
    o AS (SELECT anc.entity_id, crop, anchor, sm, (anchor + to_months(s))::DATE AS target, CASE WHEN s > 0 THEN s ELSE 10 - s END AS pref FROM anc, crops, (SELECT unnest(range(-11, 4)) AS s) WHERE list_contains(sm, month((anchor + to_months(s))::DATE))),
    t0 AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY entity_id, crop ORDER BY pref) = 1),
    t1 AS (SELECT t0.entity_id, t0.crop, anchor, sm, coalesce(giv.month, target) AS target FROM t0 LEFT JOIN giv USING (entity_id, crop)),
    t AS (SELECT *, ((year(target) - year(anchor)) * 12 + month(target) - month(anchor))::INT AS horizon FROM t1),
    x AS (SELECT t.*, n_nationkey, crop = 'wheat' OR n_nationkey % 2 = 1 AS in_scope, list_contains(sm, month(target)) AS in_season, drought_available, drought_severity, decisive, no_skill, drought_reason AS own_reason, heat_available, heat_severity
          FROM t JOIN nation ON n_name = t.entity_id LEFT JOIN ds ON ds.entity_id = t.entity_id AND ds.month = t.target AND t.horizon BETWEEN 1 AND 3 LEFT JOIN hs ON hs.entity_id = t.entity_id AND hs.month = t.target), {RULES}
    SELECT entity_id, crop, target, horizon, CASE WHEN in_scope THEN dominant ELSE 'insufficient data' END AS dominant, CASE WHEN in_scope THEN severity END AS severity, CASE WHEN in_scope THEN confidence ELSE 'not applicable: crop out of scope for the entity' END AS confidence,
           CASE WHEN in_scope THEN reason ELSE 'crop not assessed for the entity' END AS reason, CASE WHEN in_scope THEN coalesce(own_reason, CASE WHEN horizon <= 0 THEN 'the month is past, so no forecast applies' WHEN horizon > 3 THEN 'the month is beyond the forecast''s reach' END) END AS drought_reason FROM dom""")
def decision_assessment(spark: SparkSession, sf: str) -> DataFrame:
    targets, scope, drought, crops = assessment_inputs(spark, sf)
    return decisions.assessed(targets, scope, drought, heat_signals(spark, sf), crops)


TABLE = "VALUES (1, 'BUILDING', 'F', '1-URGENT', 100000.0, 200000.0, -5.0), (2, 'BUILDING', 'F', '1-URGENT', NULL, NULL, -9.0), (3, 'MACHINERY', 'O', '2-HIGH', NULL, 150000.0, -2.5), (4, 'FURNITURE', 'P', '5-LOW', 50000.0, NULL, -1.0), (5, 'FURNITURE', 'P', NULL, NULL, 120000.0, -0.5), (6, 'MACHINERY', 'F', NULL, 90000.0, NULL, -3.0)"
GAPS = "VALUES ('AUTOMOBILE', 'F'), ('HOUSEHOLD', 'O')"


@query(f"""WITH t AS (SELECT * FROM ({TABLE}) AS v(entry, crop, risk, severity, lo, hi, impact)), g AS (SELECT * FROM ({GAPS}) AS v(crop, risk)), a AS (SELECT DISTINCT crop, risk FROM t),
    r AS (SELECT o_orderkey AS row_id, c_mktsegment AS crop, o_orderstatus AS risk, o_orderpriority AS severity, o_totalprice AS metric FROM orders JOIN customer ON o_custkey = c_custkey),
    j AS (SELECT r.*, entry, lo, hi, impact FROM r LEFT JOIN t ON t.crop = r.crop AND t.risk = r.risk AND (t.severity IS NULL OR t.severity = r.severity) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY entry) = 1),
    s AS (SELECT j.*, CASE WHEN entry IS NOT NULL THEN CASE WHEN metric < lo THEN 'not available: below the band' WHEN metric > hi THEN 'not available: above the band' ELSE 'available' END WHEN a.crop IS NOT NULL THEN 'not available: other severity only' WHEN g.crop IS NOT NULL THEN 'recorded gap' ELSE 'out of scope' END AS status
          FROM j LEFT JOIN a ON a.crop = j.crop AND a.risk = j.risk LEFT JOIN g ON g.crop = j.crop AND g.risk = j.risk)
    SELECT row_id, crop, risk, severity, metric, status, CASE WHEN status = 'available' THEN impact::DOUBLE END AS impact FROM s""")
def decision_yield_impact(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("row_id"), F.col("c_mktsegment").alias("crop"), F.col("o_orderstatus").alias("risk"), F.col("o_orderpriority").alias("severity"), F.col("o_totalprice").alias("metric"))
    t = spark.sql(f"SELECT entry, crop, risk, severity, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(impact AS DOUBLE) AS impact FROM ({TABLE}) AS v(entry, crop, risk, severity, lo, hi, impact)")
    return decisions.yield_impact(rows, t, spark.sql(f"SELECT * FROM ({GAPS}) AS v(crop, risk)"))


LOSSES = "VALUES (1, 'wheat', 'heat', 'severe', 4.0, 12.0, -5.6), (2, 'wheat', 'drought', NULL, NULL, -1.0, -12.0), (3, 'millet', 'heat', 'moderate', 3.0, NULL, -4.1), (4, 'wheat', 'heat', 'moderate', NULL, 3.5, -2.0)"
NO_LOSSES = "VALUES ('millet', 'drought')"


@query(f"""WITH as0 AS ({SQL["decision_assessment"]}), {SIGNALS}, {ZM}, t AS (SELECT * FROM ({LOSSES}) AS v(entry, crop, risk, severity, lo, hi, impact)), g AS (SELECT * FROM ({NO_LOSSES}) AS v(crop, risk)), k AS (SELECT DISTINCT crop, risk FROM t),
    me AS (SELECT entity_id, month AS target, 'heat' AS risk, mean_departure AS metric FROM cnt UNION ALL SELECT entity_id, month, 'drought', predicted FROM z),
    j0 AS (SELECT as0.*, metric FROM as0 LEFT JOIN me ON me.entity_id = as0.entity_id AND me.target = as0.target AND me.risk = as0.dominant),
    j AS (SELECT j0.*, entry, lo, hi, t.impact AS loss FROM j0 LEFT JOIN t ON t.crop = j0.crop AND t.risk = j0.dominant AND (t.severity IS NULL OR t.severity = j0.severity) QUALIFY row_number() OVER (PARTITION BY j0.entity_id, j0.crop ORDER BY entry) = 1),
    s AS (SELECT j.*, CASE WHEN dominant IS NULL OR dominant IN ('none', 'insufficient data') OR severity IS NULL THEN 'not available: no binding risk'
        WHEN entry IS NOT NULL THEN CASE WHEN metric IS NULL THEN 'not available: not measured' WHEN metric < lo THEN 'not available: below the band' WHEN metric > hi THEN 'not available: above the band' ELSE 'available' END
        WHEN k.crop IS NOT NULL THEN 'not available: other severity only' WHEN g.crop IS NOT NULL THEN 'recorded gap' ELSE 'out of scope' END AS impact_status
        FROM j LEFT JOIN k ON k.crop = j.crop AND k.risk = j.dominant LEFT JOIN g ON g.crop = j.crop AND g.risk = j.dominant)
    SELECT entity_id, crop, target, dominant, severity, round(metric, 4) AS metric, impact_status, CASE WHEN impact_status = 'available' THEN loss::DOUBLE END AS impact FROM s""")
def decision_assessment_impact(spark: SparkSession, sf: str) -> DataFrame:
    """The assessments with the figure of the dominant risk: by the month's mean departure, or the forecast index."""
    targets, scope, drought, crops = assessment_inputs(spark, sf)
    a = decisions.assessed(targets, scope, drought, heat_signals(spark, sf), crops)
    c = heat.monthly_counts(climate.hot_days(spark, sf))
    hot = c.select("entity_id", F.col("month").alias("target"), F.lit("heat").alias("risk"), F.round("mean_departure", 8).alias("metric"))
    dry = drought_forecasts(spark, sf).select("entity_id", F.col("horizon").alias("target"), F.lit("drought").alias("risk"), F.col("predicted").alias("metric"))
    t = spark.sql(f"SELECT entry, crop, risk, severity, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(impact AS DOUBLE) AS impact FROM ({LOSSES}) AS v(entry, crop, risk, severity, lo, hi, impact)")
    out = decisions.with_impact(a, hot.unionByName(dry), t, spark.sql(f"SELECT * FROM ({NO_LOSSES}) AS v(crop, risk)"))
    return out.select("entity_id", "crop", "target", "dominant", "severity", F.round("metric", 4).alias("metric"), "impact_status", "impact")


@query("""WITH c AS (SELECT c_custkey AS entity_id, date_trunc('month', max(o_orderdate))::DATE AS anchor FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    k AS (SELECT * FROM (VALUES ('wheat', [1, 2, 3]), ('millet', [7, 8])) AS v(crop, sm)),
    o AS (SELECT entity_id, crop, anchor, (anchor + to_months(s))::DATE AS target, s AS horizon, CASE WHEN s > 0 THEN s ELSE 10 - s END AS pref FROM c, k, (SELECT unnest(range(-11, 4)) AS s) WHERE list_contains(sm, month((anchor + to_months(s))::DATE)))
    SELECT entity_id, crop, anchor, target, horizon::INT AS horizon FROM o QUALIFY row_number() OVER (PARTITION BY entity_id, crop ORDER BY pref) = 1""")
def decision_target_month(spark: SparkSession, sf: str) -> DataFrame:
    anchors = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.trunc(F.max("o_orderdate"), "MM").alias("anchor"))
    return decisions.target_month(anchors, spark.sql("SELECT * FROM (VALUES ('wheat', array(1, 2, 3)), ('millet', array(7, 8))) AS v(crop, sensitive_months)"))


@query(f"""WITH {SIGNALS}, {ZM}, {DS} SELECT entity_id, 'drought forecast' AS what, coalesce(drought_reason, 'forecast without skill') AS reason FROM ds WHERE drought_reason IS NOT NULL OR no_skill
    UNION ALL SELECT z.entity_id, 'heat', 'month ' || strftime(z.month, '%Y-%m') || ' was not observed' FROM z ANTI JOIN hs ON hs.entity_id = z.entity_id AND hs.month = z.month
    UNION ALL SELECT c_name, 'orders', 'customer without orders' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def decision_missing_data(spark: SparkSession, sf: str) -> DataFrame:
    z = drought_forecasts(spark, sf)
    d = decisions.drought_signal(z).withColumn("reason", F.coalesce("drought_reason", F.when(F.col("no_skill"), "forecast without skill")))
    unseen = z.withColumnRenamed("horizon", "month").join(heat_signals(spark, sf), ["entity_id", "month"], "left_anti").withColumn("reason", F.concat(F.lit("month "), F.date_format("month", "yyyy-MM"), F.lit(" was not observed")))
    idle = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_name").alias("entity_id"), F.lit("customer without orders").alias("reason"))
    return decisions.missing((d, F.col("reason").isNotNull(), "drought forecast"), (unseen, F.lit(True), "heat"), (idle, F.lit(True), "orders"))


DAYS = "SELECT event_type AS entity_id, ts::DATE AS day, value, event_id AS seq FROM events"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("entity_id"), F.to_date("ts").alias("day"), F.round("value", 4).alias("value"), F.col("event_id").alias("seq"))


def event_layers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An archive up to 2024-01-20 and a recent layer from 2024-01-18 on; every event is in one of them or in both."""
    e = events(spark, sf)
    return e.where("day <= date'2024-01-20'"), e.where("day >= date'2024-01-18'")


@query(f"""WITH b AS (SELECT *, CASE WHEN day >= DATE '2024-01-18' THEN 1 ELSE 0 END AS layer FROM ({DAYS}))
    SELECT entity_id, day, round(value, 4) AS value, seq FROM b QUALIFY row_number() OVER (PARTITION BY entity_id, day ORDER BY layer DESC, seq DESC) = 1""")
def source_live_union(spark: SparkSession, sf: str) -> DataFrame:
    return layers.live(*event_layers(spark, sf), ["entity_id", "day"], ["seq"])


@query(SQL["source_live_union"].replace("day >= DATE '2024-01-18' THEN 1 ELSE 0", "seq % 3 = 0 AND day < DATE '2024-01-20' THEN 0 ELSE 1"))
def source_live_union_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is in one of the layers: what the archive lacks is in the recent one."""
    e = events(spark, sf)
    archived = F.coalesce((F.col("seq") % 3 == 0) & (F.col("day") < F.lit("2024-01-20").cast("date")), F.lit(False))
    return layers.live(e.where(archived), e.where(~archived), ["entity_id", "day"], ["seq"])


@query("""WITH d AS (SELECT 'all' AS entity_id, o_orderdate::DATE AS day, max(o_orderkey) AS seq, max(o_totalprice) AS value FROM orders GROUP BY 1, 2),
    m AS (SELECT entity_id, date_trunc('month', day)::DATE AS month, round(avg(value), 6) AS mean, count(value) AS n_days FROM d GROUP BY 1, 2)
    SELECT entity_id, month, mean, n_days FROM m WHERE month > DATE '1999-06-01' AND n_days >= day(last_day(month))""")
def source_refreshed_months(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").groupBy(F.lit("all").alias("entity_id"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_orderkey").alias("seq"), F.max("o_totalprice").alias("value"))
    return rounded(layers.refreshed_months(d.where("day <= date'1999-06-10'"), d.where("day > date'1999-05-01'")), 6)


@query("SELECT event_type AS entity_id, 'k' AS parameter, date_trunc('month', ts)::DATE AS month, round(avg((props->>'k')::DOUBLE) FILTER ((props->>'k')::DOUBLE <> 50), 2) AS value, count(*) FILTER ((props->>'k')::DOUBLE <> 50) AS days_used, count(*) AS days_returned FROM events GROUP BY 1, 2, 3")
def source_parameter_months(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's property as a payload of one parameter and day; 50 stands for the fill value."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("entity_id"), F.concat(F.lit('{"k": {"'), F.date_format("ts", "yyyyMMdd"), F.lit('": '), F.get_json_object("props", "$.k"), F.lit("}}")).alias("payload"))
    return payloads.parameter_months(payloads.parameter_maps(e, "payload"), [], 50.0)


@query("SELECT o_custkey AS entity_id, o_orderdate::DATE AS day, o_totalprice AS price FROM orders")
def source_parallel_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as a payload of parallel arrays, taken apart again."""
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.to_json(F.struct(F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("time"), F.collect_list("o_totalprice").alias("price"))).alias("payload"))
    return payloads.parallel_arrays(g, "payload", "time", ["price"])
