"""Mechanical check that every number of a report occurs in its sources.

One scanner reads each text once and gives its numbers: of a claim those that state a value, of a source all that can be
read in it, in overlapping groups of digits too. Claims and source numbers become keys that meet by equality: the number as
it is written, its value rounded to the claim's decimals, and cells of the tolerance's width. No claim is compared with all
numbers of its sources. Sources may be given to a group of reports; their keys are put together before they meet the
claims, so a group of any size costs its distinct keys only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions import slices

# What is a number, what names things and states no value, which whole numbers are years, and the tolerance.
NUMBER = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?%?"
STRUCTURAL = (
    r"(?i)\bt\s*\+\s*\d\b",
    r"(?i)\bSPI-?3\b",
    r"(?i)\bgemini-embedding-\d+\b",
    r"(?i)\bgemini-[\d.]+-flash\b",
    r"(?i)\bMcKee et al\.?,? \d{4}\b",
    r"(?m)^\s*\d{1,2}[.)]\s",
    r"(?i)\bERSST[ .]?v?\d*\b",
    r"(?i)\bHadISST[\d.]*\b",
    r"\b\d{4}-\d{1,2}(?:-\d{1,2})?\b",
)
YEARS = (1900, 2100)
TOLERANCE = 5e-5

CELL = 1e-4
#: Rounding to more decimals than these is finer than the tolerance.
DECIMALS = 4
#: Digit groups of a written number at most: 24 digits and more are a list of numbers.
GROUPS = 8
_NUMBER, _STRUCTURAL = re.compile(NUMBER, re.A), [re.compile(p, re.A) for p in STRUCTURAL]
_RUN = re.compile(r"\d[\d.,]*", re.A)
_PART = re.compile(r"(\d+)([.,]*)", re.A)
_NUMBERS = pa.list_(pa.struct([("place", pa.int32()), ("token", pa.string()), ("value", pa.float64()), ("decimals", pa.int32()), ("is_percent", pa.bool_())]))
_SOURCE = pa.struct([("written", pa.list_(pa.string())), ("given", pa.list_(pa.float64()))])


def _value(token: str) -> float:
    return float(token.rstrip("%").replace(",", ""))


def claimed(text: str) -> list[dict]:
    """The numbers of a claim in order, without names and years: ``place, token, value, decimals, is_percent``."""
    for p in _STRUCTURAL:
        text = p.sub(" ", text)
    out = []
    for place, m in enumerate(_NUMBER.finditer(text)):
        token = m[0]
        value, percent, point = _value(token), token.endswith("%"), token.find(".")
        decimals = 0 if point < 0 else len(token) - point - 1 - percent
        if percent or decimals or not YEARS[0] <= abs(value) <= YEARS[1]:
            out.append({"place": place, "token": token, "value": value, "decimals": decimals, "is_percent": percent})
    return out


def written(text: str) -> set[str]:
    """All numbers that can be read in a source: whole groups of digits, not after a digit or a point, with their sign or without.

    In 1,234,567.8 these are 1; 1,234; 1,234,567; 1,234,567.8; 234; 234,567; and so on.
    """
    out = set()
    for run in _RUN.finditer(text):
        at = run.start()
        before, sign = text[at - 1 : at], ""
        if before in ("-", "+") and (at < 2 or text[at - 2] not in "0123456789."):
            sign = before
        parts = _PART.findall(run[0])
        for k in range(len(parts)):
            if (before if k == 0 else parts[k - 1][1][-1]) == ".":
                continue
            number, j = parts[k][0], k
            while True:
                more = [number]
                if parts[j][1] == "." and j + 1 < len(parts):
                    more.append(f"{number}.{parts[j + 1][0]}")
                out.update(more)
                if k == 0 and sign:
                    out.update(sign + x for x in more)
                if parts[j][1] != "," or j + 1 >= len(parts) or len(parts[j + 1][0]) != 3 or j - k + 2 > GROUPS:
                    break
                j += 1
                number = f"{number},{parts[j][0]}"
    return out


def given_values(text: str) -> set[float]:
    """The values of a source's numbers; a percentage is also its hundredth."""
    out = set()
    for m in _NUMBER.finditer(text):
        v = _value(m[0]) + 0.0
        out.add(v)
        if m[0].endswith("%"):
            out.add(v / 100)
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("place", T.IntegerType()), ("token", T.StringType()), ("value", T.DoubleType()), ("decimals", T.IntegerType()), ("is_percent", T.BooleanType()))])))
def _claimed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return slices.each(batches, lambda t: claimed(t or ""), _NUMBERS)


@F.arrow_udf(T.StructType([T.StructField("written", T.ArrayType(T.StringType())), T.StructField("given", T.ArrayType(T.DoubleType()))]))
def _scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return slices.each(batches, lambda t: {"written": sorted(written(t or "")), "given": sorted(given_values(t or ""))}, _SOURCE)


def numbers(claims: DataFrame, key: str, text: str) -> DataFrame:
    """``key, place, token, value, decimals, is_percent`` of each number of the claims; other columns stay, the text does not."""
    return claims.withColumn("numbers", _claimed(F.col(text).cast("string"))).drop(text).select("*", F.inline("numbers")).drop("numbers")


def _key(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (number + F.lit(0.0)).cast("string"))  # adding 0 makes one zero of both


def _cell(value: Column) -> Column:
    return F.round(value / CELL)


def _source_keys(scan: Column) -> Column:
    """Array of ``key, v`` of all numbers of a source: v is the value for keys of cells and of the values themselves, else null."""
    none = F.lit(None).cast("double")
    verbatim = F.transform(scan["written"], lambda t: F.struct(F.concat(F.lit("v:"), t).alias("key"), none.alias("v")))
    each = lambda v: F.array(F.struct(_key(VALUE, v).alias("key"), v.alias("v")), *(F.struct(_key(f"r{d}", F.bround(v, d)).alias("key"), none.alias("v")) for d in range(DECIMALS + 1)), *(F.struct(_key("t", _cell(v) + k).alias("key"), v.alias("v")) for k in (-1.0, 0.0, 1.0)))
    return F.concat(verbatim, F.flatten(F.transform(scan["given"], each)))


def _claim_keys() -> Column:
    """Array of ``key, v`` under which a number of a claim may meet a source."""
    none = F.lit(None).cast("double")
    verbatim = F.struct(F.concat(F.lit("v:"), F.rtrim(F.col("token"), F.lit("%"))).alias("key"), none.alias("v"))
    rounded = lambda v: F.coalesce(*(F.when(F.col("decimals") == d, _key(f"r{d}", F.bround(v, d))) for d in range(DECIMALS + 1)))
    both = lambda v: [F.struct(rounded(v).alias("key"), none.alias("v")), F.struct(_key("t", _cell(v)).alias("key"), v.alias("v"))]
    plain, percent = F.array(verbatim, *both(F.col("value"))), F.array(*both(F.col("value") / 100))
    return F.filter(F.when(F.col("is_percent"), F.concat(plain, percent)).otherwise(plain), lambda x: x["key"].isNotNull())


#: Kind of the keys that only count a source's values.
VALUE = "n"


def source_keys(sources: DataFrame, by: str, origin: str, text: str) -> DataFrame:
    """``by, key_, w, lo, hi``: the distinct keys of each group of sources, with the least and the largest origin."""
    k = sources.select(by, F.col(origin).alias("origin"), F.explode(_source_keys(_scanned(F.col(text).cast("string")))).alias("k"))
    return k.groupBy(by, F.col("k.key").alias("key_"), F.col("k.v").alias("w")).agg(F.min("origin").alias("lo"), F.max("origin").alias("hi"))


def found_in(claims: DataFrame, keys: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """As ``matched``, by keys of ``source_keys``."""
    by = group or key
    n = numbers(claims.select(*dict.fromkeys([key, by, text])), key, text).select(*dict.fromkeys([key, by]), "place", "token", F.explode(_claim_keys()).alias("k"))
    n = n.select(*dict.fromkeys([key, by]), "place", "token", F.col("k.key").alias("key_"), F.col("k.v").alias("v"))
    near = F.col("v").isNull() | (F.abs(F.col("v") - F.col("w")) <= TOLERANCE)
    others = (F.col("lo") != F.col(key)) | (F.col("hi") != F.col(key)) if group else F.lit(True)
    hit = F.col("lo").isNotNull() & near & others
    return n.join(keys, [by, "key_"], "left").groupBy(key, "place", "token").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))


def matched(claims: DataFrame, sources: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """``key, place, token, found`` of each number of the claims: whether a source has it.

    It has it if it is written there, or has a value equal at the claim's decimals (ties to even) or within the
    tolerance; a percentage also counts as its hundredth. Sources are those of the same ``key``. With ``group``, a column
    of both, they are those of the same group and another ``key``. Claims with one ``key`` are one report.
    """
    return found_in(claims, source_keys(sources, group or key, key, text), key, text, group)


def check(claims: DataFrame, sources: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """Per report: numbers checked, unverified tokens in order, and its status; an empty one is never grounded.

    Without ``group`` also how many different values its sources have.
    """
    bad = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("place", "token")))), lambda x: x["token"]), " ")
    keys = source_keys(sources, group or key, key, text)
    total = found_in(claims, keys, key, text, group).groupBy(key).agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(~F.col("found")).alias("n_unverified"), bad.alias("unverified"))
    out = claims.select(key, (F.trim(F.coalesce(text, F.lit(""))) == "").alias("empty")).join(total, key, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    status = F.when(F.col("empty"), "not_generated").when(F.coalesce("n_unverified", F.lit(0)) == 0, "clean").otherwise("warning")
    columns = [key, n("n_checked"), n("n_unverified"), F.coalesce("unverified", F.lit("")).alias("unverified"), status.alias("status")]
    if not group:
        given = keys.where(F.startswith("key_", F.lit(f"{VALUE}:"))).groupBy(key).agg(F.count_distinct("w").alias("n_source_numbers"))
        out, columns = out.join(given, key, "left"), [*columns, n("n_source_numbers")]
    return out.select(*columns)


def confusion(flagged: Column, fabricated: Column, grounded: Column) -> dict[str, Column]:
    """Counts of a case from its sets of tokens; a token that was extracted but has no label is an error of the case."""
    return {
        "tp": F.size(F.array_intersect(flagged, fabricated)),
        "fp": F.size(F.array_except(flagged, fabricated)),
        "fn": F.size(F.array_except(fabricated, flagged)),
        "tn": F.size(F.array_except(grounded, flagged)),
    }


def case_scores(cases: DataFrame, sources: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tp, fp, fn, tn, unlabelled, passed`` of labelled reports (columns ``fabricated`` and ``grounded``, arrays of tokens)."""
    tokens = matched(cases, sources, key, text).groupBy(key).agg(F.collect_set(F.when(~F.col("found"), F.col("token"))).alias("flagged"), F.collect_set("token").alias("extracted"))
    none = F.array().cast("array<string>")
    joined = cases.join(tokens, key, "left").withColumns({c: F.coalesce(c, none) for c in ("flagged", "extracted")})
    counts = confusion(F.col("flagged"), F.array_distinct("fabricated"), F.array_distinct("grounded"))
    out = joined.withColumns({**counts, "unlabelled": F.array_sort(F.array_except("extracted", F.array_union("fabricated", "grounded")))})
    return out.select(key, "tp", "fp", "fn", "tn", "unlabelled", ((F.col("fp") == 0) & (F.col("fn") == 0)).alias("passed"))


def ratios(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision and recall (1 without cases) and F1 (0 if both are 0)."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
