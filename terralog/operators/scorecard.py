"""Markdown reports that cite their sources by section, and JSON of any shape as a source: each number is held against what its section cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.operators import grounding
from terralog.sources import files

# A section's line of sources, a name in it, and references to other places, which state no value.
SOURCE_LINE = r"(?ms)^\*Source:\s*(.+?)\*\s*$"
NAMED = r"`([^`]+)`"
REFERENCES = (r"(?i)\bPhases?\s+[\d.]+(?:\s*(?:-|–|and|,)\s*[\d.]+)*", r"§\s*\d+", r"^\s*\d{1,2}\.\s")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section, heading, body, cited`` of each section that has a line of sources.

    A section begins with a line of ``##``; what stands before the first is section 0. ``cited`` are the names in back
    quotes on its line of sources that have a slash or end in .md. The body is without its heading, that line, and
    references to phases and other sections.
    """
    parts = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"(?m)^## ")
    s = docs.select(key, F.posexplode(parts).alias("section", "part")).where(F.regexp_like("part", F.lit(SOURCE_LINE)))
    first = F.substring_index("part", "\n", 1)
    heading = F.when(F.col("section") == 0, "").otherwise(F.trim(first))
    rest = F.when(F.col("section") == 0, F.col("part")).otherwise(F.substring("part", F.length(first) + 2, F.length("part")))
    line = F.regexp_extract("part", SOURCE_LINE, 1)
    cited = F.array_distinct(F.filter(F.regexp_extract_all(line, F.lit(NAMED), F.lit(1)), lambda c: F.contains(c, F.lit("/")) | F.endswith(c, F.lit(".md"))))
    body = F.regexp_replace(rest, SOURCE_LINE, " ")
    for p in REFERENCES:
        body = F.regexp_replace(body, p, " ")
    return s.select(key, "section", heading.alias("heading"), body.alias("body"), cited.alias("cited"))


def _nested(v: Column) -> Column:
    return F.regexp_like(F.schema_of_variant(v), F.lit("^(OBJECT|ARRAY)"))


def leaves(rows: DataFrame, value: str) -> DataFrame:
    """Every scalar of a VARIANT column, whatever its shape: the other columns, ``path``, ``last_key`` and ``scalar``.

    Paths are written as ``$.a.b[0]``. Each level of nesting is one step, so as many steps as the deepest value has;
    nulls of JSON are left out, and a null value has no scalars.
    """
    kept = [c for c in rows.columns if c != value]
    level = rows.select(*kept, F.lit("$").alias("path"), F.lit(None).cast("string").alias("last_key"), F.col(value).alias("v"))
    done, spark = None, rows.sparkSession
    while True:
        level = files.stored(level.where(F.col("v").isNotNull() & ~F.is_variant_null("v")))  # each level is made once, from the one before
        flat = level.where(~_nested(F.col("v"))).select(*kept, "path", "last_key", F.col("v").cast("string").alias("scalar"))
        done = flat if done is None else done.unionByName(flat)
        deep = level.where(_nested(F.col("v")))
        if deep.isEmpty():
            return done
        step = deep.withColumnRenamed("v", "parent").lateralJoin(spark.tvf.variant_explode(F.col("parent").outer()))
        path = F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))
        level = step.select(*kept, path.alias("path"), F.coalesce("key", "last_key").alias("last_key"), F.col("value").alias("v"))


def readable(rows: DataFrame, value: str) -> DataFrame:
    """A line a scalar: its name and value, as a source of numbers (column ``text``)."""
    out = leaves(rows, value)
    return out.select(*[c for c in rows.columns if c != value], F.concat_ws(" ", "last_key", "scalar").alias("text"))


def check(found: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``key, section, heading, n_cited, missing, n_checked, unverified, status`` of each section of ``sections``.

    ``sources``: rows ``name, text``, any number of them a name. A section is ``uncited`` without a name, ``unchecked``
    where none of its sources exists (nothing is then verified), else ``clean`` or ``warning`` by the numbers that occur
    in none of them.
    """
    one, sources = found.withColumn("id", F.struct(key, "section").cast("string")), files.stored(sources.select("name", "text"))
    pairs = one.select("id", F.explode("cited").alias("name"))
    have = pairs.join(sources.select("name").distinct().withColumn("there", F.lit(True)), "name", "left")
    cited = have.groupBy("id").agg(F.count(F.lit(1)).alias("n_cited"), F.count("there").alias("n_there"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("name")))), " ").alias("missing"))
    # a source is read once, however many sections cite it: the numbers of a section meet the keys of each name that it cites
    claims = one.select("id", "body", F.explode_outer("cited").alias("name"))
    hit = grounding.matched(claims, sources.select("name", F.col("name").alias("id"), F.col("text").alias("body")), "id", "body", "name")
    bad = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("place", "token")))), lambda x: x["token"]), " ")
    total = hit.groupBy("id").agg(F.count(F.lit(1)).alias("n_checked"), bad.alias("unverified"))
    j = one.join(cited, "id", "left").join(total, "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    verified = n("n_there") > 0
    status = F.when(n("n_cited") == 0, "uncited").when(~verified, "unchecked").when(F.coalesce("unverified", F.lit("")) == "", "clean").otherwise("warning")
    return j.select(key, "section", "heading", n("n_cited").alias("n_cited"), F.coalesce("missing", F.lit("")).alias("missing"), n("n_checked").alias("n_checked"), F.when(verified, F.coalesce("unverified", F.lit(""))).otherwise("").alias("unverified"), status.alias("status"))
