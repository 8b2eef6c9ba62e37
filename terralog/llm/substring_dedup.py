"""Exact removal of repeated passages by FM-index shards (operator 12).

A passage is a window of words that also starts earlier: in a document before, or before in its own. Equal windows have the
same least hash of their five-word sequences; the windows of a document that share it one after the other are a piece, and
pieces of a key are indexed together, so a shard holds every place of its windows. Keys of a single piece hold no repeat,
unless it repeats itself, and go no further. A shard joins its pieces in order of document and place, builds a compressed
FM-index over the words, and streams the pieces through it: backward search on the wavelet matrix gives the matching
statistics of each place, and intervals of windows whose match reaches the threshold and has an earlier place are reported.

Copies of a whole text are removed by their digest alone, copies of a piece meet before it is indexed, and a key of very
many different pieces (the edges of a passage in many documents) is dealt anew window by window, so no shard is hot.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .fm_index import repeated_windows
from .hashing import mix, steps, words, words_of

WINDOW = 20
#: Words of the sequence whose least hash is a window's key.
SEED = 5
#: Windows of a piece at most; a longer run of one key is cut, and its pieces stay under the key.
PIECE = 64
#: Bytes of the pieces of a shard, and of a bucket of texts; pieces from which a key is dealt by windows.
SHARD_BYTES, BUCKET_BYTES, HOT = 8_000_000, 64_000_000, 1000
#: Bytes of pieces that a task remembers to give each of them once.
SEEN_BYTES = 64_000_000
_PLACE = np.random.default_rng(20250301).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
DOC = ["at", "d1", "d2"]
PIECES = "at long, d1 long, d2 long, key long, first int, n int, b int, e int"
CONTENT = "key long, at long, d1 long, d2 long, first int, n int, words binary"
INTERVALS = "at long, d1 long, d2 long, a int, b int"
EMPTY = hashlib.sha256(b"").hexdigest()


def pieces(texts: list[str], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of a few texts: each piece's text, key, whether it may repeat itself (a sequence of its words comes again within a
    window's reach), first word and number of windows, and its first and last byte in its text."""
    w = words(texts, None)
    n, k = len(w.hashes), min(SEED, window)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    g = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        g += w.hashes[j : n - k + 1 + j] * _PLACE[j]
    again = np.zeros(len(g) + 1, np.int64)  # of a run of one key, places of its least hash are at most so far apart
    for p in range(1, min(window - k + 1, len(g) - 1) + 1):
        again[p + 1 :] |= g[p:] == g[:-p]
    again = np.cumsum(again)
    least, span = mix(g), 1
    while 2 * span <= window - k + 1:
        least, span = np.minimum(least[: len(least) - span], least[span:]), 2 * span
    rest = window - k + 1 - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    doc = np.repeat(np.arange(len(texts)), np.diff(w.starts))
    whole = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    key, of = least[whole], doc[whole]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(whole) else whole
    length = np.diff(np.r_[new, len(whole)])
    parts = -(-length // PIECE)
    first = np.repeat(new, parts) + PIECE * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    count = np.diff(np.r_[first, len(whole)])
    word, of = whole[first], of[first]
    return of, key[first].view(np.int64), again[word + count + window - k] > again[word], word - w.starts[of], count, w.begin[word] - w.offset[of], w.end[word + count + window - 2] - w.offset[of]


def _bucketed(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Writes ``df`` to the shared folder in ``n`` buckets by hash of ``keys``: joins by them do not shuffle it again."""
    spark, name = df.sparkSession, f"terralog_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", base.work_dir(spark)).format("parquet").saveAsTable(name)
    return spark.table(name)


def _key_counts(texts: DataFrame, window: int) -> DataFrame:
    """``key, n``: keys of more than one piece, and those of a single piece that may repeat itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(0).to_pylist()
            for a, b in steps(t):
                _, key, again, *_ = pieces(t[a:b], window)
                key, n = np.unique(np.repeat(key, 1 + again), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(3).to_pylist()
            for a, b in steps(t):
                of, key, _, *rest = pieces(t[a:b], window)
                doc = pa.array(of + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(doc) for c in range(3)), pa.array(key), *(pa.array(c, pa.int32()) for c in rest)], [c.split()[0] for c in PIECES.split(", ")])

    return texts.select(*DOC, "text").mapInArrow(run, PIECES)


def _content(texts: DataFrame, lists: DataFrame, window: int) -> DataFrame:
    """The words of each listed piece; of copies that a task meets, the later ones come without words, as repeats.

    ``lists``: a document's pieces as ``p`` (``first, n, b, e, key, hot``). A hot piece comes as windows, each with a key
    of its own content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        size = 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]

            def add(key: int, doc: tuple, first: int, n: int, content: bytes | None) -> None:
                for column, v in zip(out, (key, *doc, first, n, content), strict=True):
                    column.append(v)

            def known(content: bytes, doc: tuple, first: int, n: int) -> bool:
                """Whether an earlier place has the same words: then the piece is a repeat as a whole."""
                nonlocal size
                before = seen.get(content)
                if before is not None and before < (doc, first):
                    add(doc[1] ^ first, doc, first, n, None)
                    return True
                if before is None:
                    size += len(content)
                    if size > SEEN_BYTES:
                        seen.clear()
                        size = len(content)
                seen[content] = (doc, first)
                return False

            for i in range(len(batch)):
                at, d1, d2, text, listed = (batch.column(c)[i].as_py() for c in range(5))
                doc, raw = (at, d1, d2), text.encode("utf-8", "surrogatepass")
                for p in sorted(listed, key=lambda p: p["first"]):
                    first, n, content = p["first"], p["n"], raw[p["b"] : p["e"]]
                    if known(content, doc, first, n):
                        continue
                    if not p["hot"]:
                        add(p["key"], doc, first, n, content)
                        continue
                    w = content.split()
                    for j in range(n):
                        one = b" ".join(w[j : j + window])
                        if n == 1 or not known(one, doc, first + j, 1):
                            add(int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little", signed=True), doc, first + j, 1, one)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in CONTENT.split(", ")])

    return texts.join(lists.hint("shuffle_hash"), DOC).select(*DOC, "text", "p").mapInArrow(run, CONTENT)


def shard_intervals(rows: list[tuple], window: int) -> list[tuple]:
    """Intervals of repeats (``at, d1, d2, a, b``: words from a up to b) among pieces (``at, d1, d2, first, n, words``)."""
    rows.sort(key=lambda r: r[:4])
    first_of: dict[bytes, tuple] = {}
    out, kept = [], []
    for r in rows:
        before = first_of.setdefault(r[5], r)
        if before is r:
            kept.append(r)
        elif before[:4] != r[:4]:
            out.append((*r[:3], r[3], r[3] + r[4] + window - 1))
    raw, hashes = [r[5] for r in kept], []
    lengths = []
    for a, b in steps(raw):
        w = words_of(raw[a:b], None)
        hashes.append(w.hashes)
        lengths.append(np.diff(w.starts))
    length = np.concatenate(lengths)
    first = np.cumsum(length + 1) - length - 1
    symbols = np.zeros(int(length.sum()) + len(length), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[first + length] = False
    symbols[inside] = np.unique(np.concatenate(hashes), return_inverse=True)[1] + 1
    found = repeated_windows(symbols, first, np.array([r[4] for r in kept]), window)
    if len(found):
        piece = np.searchsorted(first, found, side="right") - 1
        begin = np.flatnonzero(np.r_[True, (np.diff(found) > 1) | (np.diff(piece) > 0)])
        end = np.r_[begin[1:], len(found)] - 1
        for s, t, p in zip(found[begin].tolist(), found[end].tolist(), piece[begin].tolist(), strict=True):
            r, at = kept[p], int(first[p])
            out.append((*r[:3], r[3] + s - at, r[3] + t - at + window))
    return out


def _intervals(content: DataFrame, window: int) -> DataFrame:
    """The repeats of all pieces: a task reads its keys in order and indexes them in shards of ``SHARD_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.int32()] * 2, strict=True)], [c.split()[0] for c in INTERVALS.split(", ")])

        for batch in batches:
            ready = []
            for key, at, d1, d2, first, n, content in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if content is None:
                    ready.append((at, d1, d2, first, first + n + window - 1))
                    continue
                if size >= SHARD_BYTES and key != last:
                    ready += shard_intervals(held, window)
                    held, size = [], 0
                held.append((at, d1, d2, first, n, content))
                size, last = size + len(content), key
            yield batch_of(ready)
        if held:
            yield batch_of(shard_intervals(held, window))

    return content.repartition("key").sortWithinPartitions("key").mapInArrow(run, INTERVALS)


def _cut(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``at, d1, d2, n_words, n_removed, kept_sha256`` of each text without the words of its intervals ``s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest = [], [], []
            for i in range(len(batch)):
                w = batch.column(3)[i].as_py().encode("utf-8", "surrogatepass").split()
                spans = batch.column(4)[i].as_py() or []
                keep = np.ones(len(w), bool)
                for s in spans:
                    keep[s["a"] : s["b"]] = False
                kept = list(compress(w, keep.tolist())) if spans else w
                total.append(len(w))
                removed.append(len(w) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], [*DOC, "n_words", "n_removed", "kept_sha256"])

    return texts.join(spans.hint("shuffle_hash"), DOC, "left").select(*DOC, "text", "s").mapInArrow(run, "at long, d1 long, d2 long, n_words long, n_removed long, kept_sha256 string")


def intervals(texts: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``at, d1, d2, s``: of each text (``at, d1, d2, text``, bucketed by the first three) the intervals ``a, b`` of words
    that windows cover which also start earlier. Texts are in order of ``at``, ``d1`` and ``d2``."""
    shared = base.stored(_key_counts(texts, window))
    rows = _pieces(texts, window).withColumnRenamed("n", "windows").join(shared.hint("shuffle_hash"), "key")
    lists = rows.groupBy(*DOC).agg(F.collect_list(F.struct("first", F.col("windows").alias("n"), "b", "e", "key", (F.col("n") > hot).alias("hot"))).alias("p"))
    found = _intervals(_content(texts, lists, window), window)
    return base.stored(found.groupBy(*DOC).agg(F.collect_list(F.struct("a", "b")).alias("s")))


def deduplicate(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: one row per row of ``docs``.

    A word is removed if a window that covers it also starts earlier in the table: in a document of smaller id, or before
    in its own. Null and empty texts have no words. Rows with one id and one text are the same document; rows of one id
    and different texts are in order of the texts' hashes; rows without an id come after all others. Texts of fewer words
    than ``window`` keep all. ``kept_sha256`` is of the words kept, one space between them; of no words, that of nothing.
    """
    rows = base.documents(docs).withColumns({"at": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")})
    size = F.octet_length("text").cast("long")
    first = base.stored(rows.groupBy("d1", "d2").agg(F.min("at").alias("at"), F.min(size).alias("size")))  # of copies of a text the first
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(first.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))
    texts = _bucketed(rows.select(*DOC, "text").repartition(n, *DOC).join(first.select(*DOC).hint("shuffle_hash"), DOC, "left_semi"), n, DOC)
    cut = _cut(texts, intervals(texts, window, hot))
    cut = base.stored(cut.groupBy("d1", "d2").agg(F.min(F.struct("at", "n_words", "n_removed", "kept_sha256")).alias("c")).select("d1", "d2", "c.*"))
    joined = rows.select("doc_id", "at", "d1", "d2").join(cut.withColumnRenamed("at", "first_at"), ["d1", "d2"])
    copy = (F.col("at") != F.col("first_at")) & (F.col("n_words") >= window)
    return joined.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
