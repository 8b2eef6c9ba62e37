"""Benchmark decontamination by size-partitioned MinHash containment search (operator 8).

Items are parted into bands by the number of their distinct shingles. An item's sketch is its shingles of least hash
(bottom-k MinHash), as many as a band needs so that a document with the wanted share of the item must hold one of them:
a share of 0.8 leaves at most a fifth out, so a fifth and one suffice. Looking up all shingles of a whole document in the
sketches thus finds every item, however long the document is. Candidates are verified on the words themselves.

A shingle is five words, lower-cased A-Z; an item of fewer words is one shingle of all its words, at any place of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .hashing import steps, words

SHINGLE = 5
PERCENT = 80
#: Characters of all items up to which their sketches are sent to all tasks; beyond, sketches are joined by hash.
BROADCAST_CHARS = 16_000_000
RESULT = "doc_id long, item_id long, n_shared long, n_shingles long"


def shingles_of(text: str, k: int = SHINGLE) -> set[bytes]:
    """Distinct shingles as text, each word between spaces."""
    w = words([text]).bytes_of(0)
    k = min(k, len(w))
    return {b" " + b" ".join(w[i : i + k]) + b" " for i in range(len(w) - k + 1)} if w else set()


def sketch_size(n: int, percent: int) -> int:
    """Shingles that an item of the band of ``n`` needs in its sketch: one more than the band's largest may lack."""
    most = (1 << n.bit_length()) - 1
    return most - -(-percent * most // 100) + 1


def item_sketch(text: str, percent: int) -> tuple[int, int, np.ndarray]:
    """Words a shingle, number of distinct shingles, and the sketch: the least hashes of the item."""
    w = words([text])
    k = min(SHINGLE, int(w.starts[1]))
    if not k:
        return 0, 0, np.zeros(0, np.uint64)
    h = np.unique(w.ngrams(k)[0])
    return k, len(h), h[: sketch_size(len(h), percent)]


class Sketches:
    """Lookup of hashes in all items' sketches, by words a shingle."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items, self.percent = items, percent
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, (_, text) in enumerate(items):
            k, _, h = item_sketch(text, percent)
            if k:
                by.setdefault(k, []).append((h, i))
        self.by = {}
        for k, found in by.items():
            h = np.concatenate([x for x, _ in found])
            owner = np.repeat([i for _, i in found], [len(x) for x, _ in found])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.by[k] = (h[order], owner[order], seen)
        self.shingles: dict[int, list[bytes]] = {}

    def candidates(self, w) -> set[tuple[int, int]]:
        """Pairs (text of the batch, item) that share a sketch hash."""
        out: set[tuple[int, int]] = set()
        for k, (hashes, owner, seen) in self.by.items():
            h, first = w.ngrams(k)
            maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, h[maybe], side="left"), np.searchsorted(hashes, h[maybe], side="right")
            hit = np.flatnonzero(hi > lo)
            doc = np.searchsorted(first, maybe[hit], side="right") - 1
            for d, a, b in zip(doc.tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True):
                out.update((d, int(i)) for i in owner[a:b])
        return out

    def verify(self, text: bytes, item: int) -> tuple[int, int]:
        """Shared and all distinct shingles of the item; ``text``: all words of a document with spaces around."""
        if item not in self.shingles:
            self.shingles[item] = sorted(shingles_of(self.items[item][1]))
        s = self.shingles[item]
        return sum(x in text for x in s), len(s)


def _batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, ["doc_id", "item_id", "n_shared", "n_shingles"])


def _by_broadcast(docs: DataFrame, items: list[tuple[int, str]], percent: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Sketches(sent.value, percent)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for a, b in steps(texts):
                w = words(texts[a:b])
                found: dict[int, list[int]] = {}
                for d, i in index.candidates(w):
                    found.setdefault(d, []).append(i)
                for d, its in found.items():
                    text = b" " + b" ".join(w.bytes_of(d)) + b" "
                    for i in its:
                        shared, n = index.verify(text, i)
                        if 100 * shared >= percent * n:
                            rows.append((ids[a + d], index.items[i][0], shared, n))
            yield _batch(rows)

    return docs.mapInArrow(run, RESULT)


def _by_join(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """For benchmarks of any size: sketches and shingles of documents meet by hash, then candidates by their ids."""

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t in zip(b["item_id"], b["text"], strict=True):
                k, _, h = item_sketch(t, percent)
                yield pd.DataFrame({"item_id": i, "k": k, "hash": h.view(np.int64)})

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in steps(texts):
                w = words(texts[lo:hi])
                for k in range(1, SHINGLE + 1):
                    h, first = w.ngrams(k)
                    yield pd.DataFrame({"doc_id": np.repeat(b["doc_id"].to_numpy()[lo:hi], np.diff(first)), "k": k, "hash": h.view(np.int64)}).drop_duplicates()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, i, t, item in b[["doc_id", "item_id", "text", "item"]].itertuples(index=False):
                text, s = b" " + b" ".join(words([t]).bytes_of(0)) + b" ", shingles_of(item)
                if 100 * (shared := sum(x in text for x in s)) >= percent * len(s):
                    rows.append((d, i, shared, len(s)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shared", "n_shingles"])

    index = items.mapInPandas(sketches, "item_id long, k int, hash long")
    pairs = docs.mapInPandas(shingles, "doc_id long, k int, hash long").join(index, ["k", "hash"]).select("doc_id", "item_id").distinct()
    return pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").mapInPandas(verify, RESULT)


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment``: a row for each document that holds the share of an item.

    Null and empty texts hold nothing, items without words are nowhere found, and rows without an id are left out.
    Repeated rows give one row. ``percent`` is a whole number from 1 to 100.
    """
    docs = base.documents(docs).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null").distinct()
    chars = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    found = _by_broadcast(docs, [tuple(r) for r in items.collect()], percent) if chars <= broadcast_chars else _by_join(docs, items, percent)
    found = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_shingles")).alias("m"))
    return found.select("doc_id", "item_id", "m.n_shared", "m.n_shingles", (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of documents that hold no benchmark item. Rows without an id stay."""
    leaked = base.unused("leaked_doc", docs)
    return docs.join(matches(docs, benchmark, percent).select(F.col("doc_id").alias(leaked)).distinct(), docs["doc_id"] == F.col(leaked), "left_anti")
