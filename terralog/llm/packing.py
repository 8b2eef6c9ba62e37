"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences (operator 10).

Pieces are written once, counted, and dealt by hash over groups of about ``GROUP_SEQUENCES`` full sequences, or fewer
where pieces are so short that a group would have over ``GROUP_PIECES``. Within a group each piece goes, longest first,
to the open sequence with the least room that still holds it. A segment tree over the remaining capacities finds that
sequence in logarithmic time. A group leaves one or two sequences partly filled at its end.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .tokens import encoder

GROUP_SEQUENCES, GROUP_PIECES = 500, 200_000
#: Different pieces counted before a task counts anew.
COUNTED = 10_000


class Capacities:
    """Segment tree: which remaining capacities, of 0 to ``most``, have an open sequence; ``fit`` finds the smallest that suffices."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.open = [0] * (2 * self.width)
        self.bins: dict[int, list[int]] = {}

    def add(self, capacity: int, sequence: int) -> None:
        self.bins.setdefault(capacity, []).append(sequence)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        i = capacity + self.width
        while i:
            self.open[i] += by
            i >>= 1

    def fit(self, need: int) -> tuple[int, int] | None:
        """Takes out the tightest open sequence with room for ``need``: its capacity and number, or None."""
        i = need + self.width
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        capacity = i - self.width
        self._count(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length; longer first, equal ones in the order given."""
    tree, used = Capacities(size), 0
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.fit(n) if n < size else None
        if found is None:
            found, used = (size, used), used + 1
        room, number = found
        sequence[i], offset[i] = number, size - room
        if room > n:
            tree.add(room - n, number)
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, nth``: each document's ids and the end id, cut after every ``size`` ids.

    ``nth`` numbers pieces that are the same in the first five, of some ``COUNTED`` pieces in a task, so that repeated rows can
    be dealt apart. At its end a task gives back what its worker remembers of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        again: Counter = Counter()
        for batch in batches:
            out = [[], [], [], [], [], []]
            if len(again) > COUNTED:
                again.clear()
            for doc, ids in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    one = (doc, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part))
                    for column, v in zip(out, (*one, again[one]), strict=True):
                        column.append(v)
                    again[one] += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])
            pa.default_memory_pool().release_unused()
        enc.forget()
        pa.default_memory_pool().release_unused()

    return base.documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096, group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Every row of ``docs`` is packed, repeated ones too; null and empty texts are one piece of the end id. Only documents
    of over ``size`` ids are cut. Memory is bounded by the pieces of one group; the number of groups grows with the ids.
    Rows that repeat an id, or have none, are dealt over all groups like others.
    """
    p = base.stored_in_small_batches(pieces(docs, tokenizer, end_id, size))
    ids, count = p.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-ids // (group_sequences * size)), -(-count // GROUP_PIECES))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        number, rows["offset"] = best_fit_decreasing(rows["length"].to_numpy(), size)
        rows["sequence_id"] = number * groups + int(key[0])
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    p = p.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), F.lit(groups)))
    return p.groupBy("packing_group").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, each of at most ``size`` ids; every row of ``docs`` is in them.

    A piece is known by its ids' checksum and length; two different pieces with both in common raise an error, so pieces that have these in common have the same ids, so each
    different piece is kept once and looked up by the packed ones. A task gathers at most ``size`` ids for each sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: dict[tuple[int, int], bytes] = {}
            for ids in enc.ids(batch.column(0).to_pylist()):
                for k in range(0, len(ids) + 4, 4 * size):
                    part = (ids + end)[k : k + 4 * size]
                    out[zlib.crc32(part), len(part) // 4] = part
            columns = [pa.array([c for c, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64()), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out.values()], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["ids_crc32", "length", "ids"])

    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = docs.select("text").distinct().mapInArrow(run, "ids_crc32 long, length long, ids array<int>").groupBy("ids_crc32", "length").agg(F.min("ids").alias("ids"), F.count_distinct("ids").alias("n"))
    ids = found.withColumn("ids", F.when(F.col("n") == 1, F.col("ids")).otherwise(F.raise_error(F.lit("two pieces have one checksum"))))
    parts = pack(docs, tokenizer, end_id, size).join(ids, ["ids_crc32", "length"]).select("sequence_id", "offset", "ids")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
