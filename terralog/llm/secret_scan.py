"""Secret scan with a random forest against false positives (operator 3). DataFrame functions only.

Candidates are long tokens with a digit, longer ones of capitals alone, and what is assigned to the name of a secret. Each is
described by its length, the changes between kinds of characters along it, how much of it common words cover, whether it
lies in a path, and its neighbouring words; a random forest trained on labelled findings tells secrets from ids, numbers,
names and paths. The findings are the caller's, or those planted by :mod:`terralog.llm.findings`. Candidates are few, so
they are written once.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base, findings

PER_CLASS = 3000
TREES, DEPTH = 30, 8
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/-])(?:(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}={0,2}|[A-Z]{16,}(?![A-Za-z0-9_+/-]))"
    r"|(?<=[\"' =:>])(?<=(?i:passw(?:or)?d|pwd|passphrase|secret|token|api_?key)(?:[\"']?[ ]?[=:][ ]?[\"']?|>))[^\s\"'<>,;&]{6,}"
)
CONTEXT = 80
NEIGHBOURS = 7
MASK = "[SECRET]"

# Words whose presence in or beside a candidate tells something.
SECRET_WORDS = "key|token|secret|passw|passwd|pwd|auth|credential|bearer|private|apikey|access"
PLAIN_WORDS = "commit|sha|hash|md5|checksum|digest|uuid|guid|version|revision|build|order|invoice|card|isbn|phone|page|figure"
COMMON_WORDS = "about|account|admin|after|also|and|are|base|been|before|build|can|class|client|code|com|config|content|could|data|date|default|demo|dev|doc|error|example|false|file|first|for|from|get|has|have|home|html|http|image|index|info|int|item|key|lib|line|link|list|local|log|main|model|name|new|not|null|object|org|page|part|path|project|public|query|report|result|sample|section|server|set|site|source|string|system|table|temp|test|text|that|the|this|time|title|true|type|url|user|value|version|view|was|web|were|will|with|word|work|www|year|you"
PROVIDER = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$|^sk_live_[A-Za-z0-9]{16,}$"
ASSIGNED = rf"(?i)({SECRET_WORDS})[a-z_-]*[\"']?\s*[=:]\s*[\"']?$"
FEATURES = [
    "length", "transitions", "case_transitions", "digit_share", "upper_share", "hex_only", "digits_only", "distinct_share", "word_share", "path_marks", "other_marks", "hyphens", "provider", "in_path", "in_url", "secret_words", "secret_beside", "plain_words", "plain_beside", "assigned",
    "assigned_secret", "bearer", "tagged", "quoted",
]


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, candidate, start, before, after``: every occurrence of a candidate in each row, at its place (from 0).

    The pieces of text between matches tell the places and, with the matches, the characters around each. A match has 12
    characters at least, so ``NEIGHBOURS`` of them hold ``CONTEXT``. Texts leave the row before the windows, which order
    a row's own matches.
    """
    d = base.documents(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    pieces = F.split("text", CANDIDATE, -1)
    d = d.where(F.size("found") > 0).select("row", "doc_id", F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("found").alias("candidate"))).alias("nth", "part"))
    piece, match = F.col("part.piece"), F.col("part.candidate")
    none, size = F.lit(""), F.lit(CONTEXT)
    d = d.select(
        "row", "doc_id", "nth", match.alias("candidate"), F.length(piece).cast("long").alias("gap"), F.right(piece, size).alias("tail"),
        F.right(F.concat(F.right(piece, size), F.coalesce(match, none)), size).alias("left_part"), F.left(F.concat(F.left(piece, size), F.coalesce(match, none)), size).alias("right_part"),
    )
    w = Window.partitionBy("row").orderBy("nth")
    through = F.sum(F.col("gap") + F.coalesce(F.length("candidate"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    left = F.array_join(F.collect_list("left_part").over(w.rowsBetween(-NEIGHBOURS, -1)), "")
    right = F.array_join(F.collect_list("right_part").over(w.rowsBetween(1, NEIGHBOURS)), "")
    d = d.select("doc_id", "candidate", (through - F.length("candidate")).alias("start"), F.right(F.concat(left, "tail"), size).alias("before"), F.left(right, size).alias("after"))
    return d.where(F.col("candidate").isNotNull())


def _share(text: Column, pattern: str, of: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(of, F.lit(1))


def described(found: DataFrame) -> DataFrame:
    """``found`` with a column for each of ``FEATURES``."""
    c, n = F.col("candidate"), F.length("candidate")
    low = F.lower(c)
    values = {
        "length": n,
        "transitions": _share(c, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", n - 1),
        "case_transitions": _share(c, "[A-Z](?=[a-z])|[a-z](?=[A-Z])", n - 1),
        "digit_share": _share(c, "[0-9]", n),
        "upper_share": _share(c, "[A-Z]", n),
        "hex_only": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("int"),
        "digits_only": c.rlike("^[0-9-]+$").cast("int"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
        "word_share": 1 - F.length(F.regexp_replace(low, COMMON_WORDS, "")) / n,
        "path_marks": F.regexp_count(c, F.lit("[/_]")),
        "other_marks": F.regexp_count(c, F.lit("[^A-Za-z0-9/_-]")),
        "hyphens": F.regexp_count(c, F.lit("-")),
        "provider": c.rlike(PROVIDER).cast("int"),
        "in_path": (F.col("before").rlike(r"[/\\.@]$") | F.col("after").rlike(r"^[/\\.@][A-Za-z0-9]")).cast("int"),
        "in_url": F.col("before").rlike(r"(?i)(https?:|data:)[^\s]*$").cast("int"),
        "secret_words": F.regexp_count(F.lower("before"), F.lit(SECRET_WORDS)),
        "secret_beside": F.col("before").rlike(rf"(?i)({SECRET_WORDS})[a-z]*[^A-Za-z0-9]*([a-z]+[^A-Za-z0-9]+)?$").cast("int"),
        "plain_words": F.regexp_count(F.lower("before"), F.lit(PLAIN_WORDS)),
        "plain_beside": F.col("before").rlike(rf"(?i)({PLAIN_WORDS})[a-z]*[^A-Za-z0-9]*([a-z]+[^A-Za-z0-9]+)?$").cast("int"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("int"),
        "assigned_secret": F.col("before").rlike(ASSIGNED).cast("int"),
        "bearer": F.col("before").rlike(r"(?i)\b(bearer|basic)\s+$").cast("int"),
        "tagged": F.col("before").rlike(rf"(?i)<[a-z_]*({SECRET_WORDS})[a-z_]*>$").cast("int"),
        "quoted": (F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).cast("int"),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()})


def by_rule() -> Column:
    """What a list of patterns would call a secret: providers' formats and assignments to a secret's name."""
    return F.col("candidate").rlike(PROVIDER) | F.col("before").rlike(ASSIGNED)


def labelled_findings(spark: SparkSession, templates: list[tuple[int, str, str, str]] = findings.TRAINING) -> DataFrame:
    """``candidate, before, after, is_secret, template`` of the values planted by ``templates``, found like any candidate."""
    texts = base.stored(findings.planted(spark, templates))
    found = candidates(texts).join(texts.select("doc_id", "value", "is_secret", "template"), "doc_id")
    return found.where(F.contains("candidate", "value") | F.contains("value", "candidate")).select("candidate", "before", "after", "is_secret", "template")


def train(labelled: DataFrame, per_class: int = PER_CLASS, seed: int = 7):
    """A forest on at most ``per_class`` labelled findings a class, by hash order; a number, the share of 1, with one class only.

    ``labelled``: columns ``candidate, before, after, is_secret``.
    """
    place = (F.xxhash64("candidate", "before", "after"), "candidate")
    parts = [labelled.where(F.col("is_secret") == c).orderBy(*place).limit(per_class) for c in (0, 1)]
    rows = base.stored(described(parts[0].unionByName(parts[1])).select(*FEATURES, F.col("is_secret").cast("double").alias("label")))
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return 1.0 if seen.get(1.0) else 0.0
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(vectors.select("features", "label"))


def score(found: DataFrame, forest) -> DataFrame:
    """``found`` with ``score``, the forest's share for a secret."""
    if isinstance(forest, float):
        return found.withColumn("score", F.lit(forest))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(found))
    return forest.transform(vectors).select(*found.columns, vector_to_array("probability")[1].alias("score"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, candidate, start, score, is_secret`` for each distinct candidate of each document.

    ``labelled``: findings to train on; without it those of ``labelled_findings``. Null and empty texts and empty tables
    give no rows. Every occurrence is scored; those of the same id and candidate give one row, with the
    least start and the highest score.
    """
    found = base.stored(candidates(docs))
    scored = score(found, train(labelled if labelled is not None else labelled_findings(docs.sparkSession)))
    one = scored.groupBy("doc_id", "candidate").agg(F.min("start").alias("start"), F.max("score").alias("score"))
    return one.withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs``, all columns and rows, with each secret in ``text`` replaced by ``MASK`` wherever the document has it."""
    doc, secrets = base.unused("secret_doc", docs), base.unused("found_secrets", docs)
    longest = F.array_sort(F.collect_set("candidate"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    found = scan(docs, labelled).where("is_secret and doc_id is not null").groupBy(F.col("doc_id").alias(doc)).agg(longest.alias(secrets))
    joined = docs.join(found, docs["doc_id"] == F.col(doc), "left")
    masked = F.aggregate(F.coalesce(secrets, F.array().cast("array<string>")), docs["text"], lambda text, s: F.replace(text, s, F.lit(MASK)))
    return joined.select(*(masked.alias(c) if c == "text" else docs[c] for c in docs.columns))
