"""Documents: text of web pages, usability gate, sections and chunks with overlap, manifest."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions import markup, slices

# Characters of a chunk, and of what it shares with the one before; where paragraphs and sentences end.
LEAST_CHUNK, MOST_CHUNK, OVERLAP = 120, 2000, 200
JOINT = "\n\n"
PARAGRAPH, UNIT = r"\n\s*\n", r"(?<=[.!?])\s+|\n"


_PAGE = pa.struct([("title", pa.string()), ("text", pa.string())])


@F.arrow_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def page(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``title`` and visible ``text`` of web pages, by a tokenizer; both are empty for a null page."""
    return slices.each(batches, lambda p: dict(zip(("title", "text"), markup.page(p), strict=True)), _PAGE)


def gate(docs: DataFrame, text: str = "text", least: int = 500, least_alpha: float = 0.5) -> DataFrame:
    """Adds ``chars, alpha_ratio, usable, reason``."""
    n = F.length(text)
    alpha = F.round(F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.nullif(n, F.lit(0)), 3)
    missing = F.contains(F.lower(F.substring(text, 1, 400)), F.lit("page not found"))
    why = F.when(n < least, "too short").when(missing, "page not found").when(F.coalesce(alpha, F.lit(0.0)) < least_alpha, "not text")
    return docs.withColumns({"chars": n, "alpha_ratio": alpha, "reason": why}).withColumn("usable", F.col("reason").isNull())


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, section, heading, body``: lines belong to the latest heading of level 1 to 3."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    is_heading = F.col("line").rlike(r"^#{1,3}\s")
    w = Window.partitionBy(key).orderBy("pos")
    numbered = lines.withColumn("section", F.sum(is_heading.cast("int")).over(w)).withColumn("heading_line", F.when(is_heading, F.trim(F.regexp_replace("line", "^#+", ""))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy(key, "section").agg(F.max("heading_line").alias("heading"), F.trim(body).alias("body"))


def fitting(sizes: list[int], gap: int) -> list[int]:
    """Places (from 0) at which a new group of consecutive parts begins, so that a group has at most ``MOST_CHUNK`` characters.

    ``gap`` characters stand between parts. A part that is larger is a group of its own.
    """
    starts, held = [], 0
    for k, n in enumerate(sizes):
        if not starts or held + gap + n > MOST_CHUNK:
            starts.append(k)
            held = n
        else:
            held += gap + n
    return starts


def _pieces(unit: str) -> list[str]:
    """A sentence in consecutive pieces of at most ``MOST_CHUNK`` characters; the last of several has ``LEAST_CHUNK``."""
    out = []
    while len(unit) > MOST_CHUNK:
        cut = min(MOST_CHUNK, len(unit) - LEAST_CHUNK)
        out.append(unit[:cut])
        unit = unit[cut:]
    return [*out, unit]


def split_long(text: str) -> list[str]:
    """A text over the limit by sentences and lines; a sentence over it in consecutive pieces, so that nothing is lost.

    (The reference keeps the start of such a sentence only.) Pieces under ``LEAST_CHUNK`` are left out.
    """
    if len(text) <= MOST_CHUNK:
        return [text]
    units = [piece for u in re.split(UNIT, text) if u for piece in _pieces(u)]
    cuts = [*fitting([len(u) for u in units], 1), len(units)]
    joined = (" ".join(units[a:b]).strip() for a, b in zip(cuts, cuts[1:], strict=False))
    return [p for p in joined if len(p) >= LEAST_CHUNK]


def spans(lengths: list[int], tail) -> list[tuple[int, int, str]]:
    """Runs of paragraphs that make a chunk each (first, end) with the overlap before it, from the paragraphs' lengths alone.

    A run takes as many paragraphs as fit behind the overlap, found in the running sum of lengths, and one at least.
    ``tail(first, end, overlap)`` gives the overlap for the run after it: of a single paragraph that is too long and has
    none before it, which is cut by itself, that is nothing.
    """
    ends = [0, *accumulate(n + len(JOINT) for n in lengths)]
    out, at, overlap = [], 0, ""
    while at < len(lengths):
        room = MOST_CHUNK + len(JOINT) - (len(overlap) + len(JOINT) if overlap else 0)
        end = max(at + 1, bisect_right(ends, ends[at] + room) - 1)
        out.append((at, end, overlap))
        overlap = "" if not overlap and lengths[at] > MOST_CHUNK else tail(at, end, overlap)
        at = end
    return out


def pack(text: str | None) -> list[str]:
    """Chunks of whole paragraphs, each with the end of the one before; a first or lone paragraph over the limit is cut.

    Paragraphs end at blank lines. A long one behind an overlap stays whole. The last chunk needs ``LEAST_CHUNK`` characters.
    """
    pars = [p for p in map(str.strip, re.split(PARAGRAPH, text or "")) if p]
    whole = lambda first, end, overlap: JOINT.join([overlap, *pars[first:end]] if overlap else pars[first:end])
    runs = spans([len(p) for p in pars], lambda *run: whole(*run)[-OVERLAP:].lstrip())
    made = [[whole(*run)] if run[2] or len(pars[run[0]]) <= MOST_CHUNK else split_long(pars[run[0]]) for run in runs]
    if runs and len(made[-1]) == 1 and len(made[-1][0]) < LEAST_CHUNK:
        made.pop()
    return [chunk for chunks in made for chunk in chunks]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return slices.each(batches, pack, pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return slices.each(batches, lambda t: split_long(t) if t is not None and len(t) >= LEAST_CHUNK else [], pa.list_(pa.string()))


def section_chunks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, section, heading, chunk, body, chars``: sections of at least ``LEAST_CHUNK`` characters, long ones cut; each keeps its heading."""
    c = sections(docs, key, text).select(key, "section", "heading", F.posexplode(_cut(F.trim("body"))).alias("chunk", "body"))
    return c.withColumn("chars", F.length("body"))


def chunk_id(key: str, body: str) -> Column:
    """Of the document's key and a hash of the chunk's text."""
    return F.concat(F.col(key).cast("string"), F.lit("::"), F.substring(F.sha2(body, 256), 1, 12))


def chunks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, chunk, chunk_id, body, chars``; the id is of the key and a hash of the text."""
    c = docs.select(key, F.posexplode(_packed(F.col(text))).alias("chunk", "body"))
    return c.withColumns({"chunk_id": chunk_id(key, "body"), "chars": F.length("body")})


def excerpts(docs: DataFrame, key: str, text: str, keywords: str) -> DataFrame:
    """``key, opening, excerpt, available``: the first 1,500 characters with single spaces, and the lines that tell something.

    Those are lines of over 40 characters with one of ``keywords`` (a pattern), or else the first two of over 120. A text
    whose opening has under 100 characters is not available.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: (F.length(x) > 40) & x.rlike(rf"(?i)(^|[^\p{{L}}])({keywords})($|[^\p{{L}}])"))
    longer = F.slice(F.filter(lines, lambda x: F.length(x) > 120), 1, 2)
    opening = F.substring(F.trim(F.regexp_replace(text, "[ \t\r\n]+", " ")), 1, 1500)
    out = docs.select(key, opening.alias("opening"), F.coalesce(F.array_join(F.when(F.size(marked) > 0, marked).otherwise(longer), " "), F.lit("")).alias("excerpt"))
    return out.withColumn("available", F.length("opening") >= 100)


def recovered_json(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """Adds ``value``, the JSON object that stands somewhere in a text, and ``parse_failed``."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    read = rows.withColumn("read", F.from_json(found, f"{schema}, broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    failed = F.col("read").isNull() | F.col("read.broken").isNotNull()
    return read.withColumn("value", F.when(~failed, F.col("read").dropFields("broken"))).withColumn("parse_failed", failed).drop("read")


def invariants(chunked: DataFrame, key: str, kind: str) -> DataFrame:
    """By ``kind``: chunks, different ids, the shortest and longest, and how many begin with the end of the one before."""
    before = F.lag("body").over(Window.partitionBy(key).orderBy("chunk"))
    c = chunked.withColumn("overlaps", F.startswith("body", F.trim(F.right(before, F.lit(OVERLAP)))))
    a = c.groupBy(kind).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("chunk_id").alias("n_ids"), F.min("chars").alias("shortest"), F.max("chars").alias("longest"), F.count_if("overlaps").alias("n_overlaps"))
    return a.withColumn("long_enough", F.col("shortest") >= LEAST_CHUNK)


def manifest(docs: DataFrame, chunked: DataFrame, key: str) -> DataFrame:
    """Each document's gate verdict and number of chunks."""
    n = chunked.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
    return docs.select(key, "usable", "reason", "chars").join(n, key, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
