"""Token ids in wavelet-matrix shards (operator 5).

A shard file holds the ids of consecutive documents. Its ids are renumbered densely and split into bit-planes, from the
highest bit to the lowest; after each plane the sequence is parted stably by that bit. Rank and select on the planes give
any token, how often a token occurs before a place, and where its k-th occurrence is, without restoring the sequence.

File format, all integers little-endian: the magic bytes, the lengths of the header and the body (8 bytes each), the
header as JSON, and the body in zstandard: sorted distinct ids (uint32), document ids and lengths (int64), the planes, and of each plane the rank directory: the ones
before each block of ``BLOCK_BITS`` (uint32).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .tokens import encoder

MAGIC = b"TLWM0001"
SHARD_IDS = 2_000_000
BLOCK_BITS = 512
#: Places of files kept for each writing task; reading tasks for each core, where there are so many files.
PLACES, READERS = 1_000_000, 32


class WaveletMatrix:
    """Succinct sequence of ids: ``access``, ``rank``, ``select``, ``count`` and ``occurrences``."""

    def __init__(self, alphabet: np.ndarray, planes: list[np.ndarray], n: int, ranks: list[np.ndarray] | None = None):
        self.alphabet, self.planes, self.n = alphabet, planes, n
        self._ranks = ranks

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(ids) > 0 if len(ids) else np.zeros(0, bool)
        alphabet = np.flatnonzero(seen).astype("<u4")
        kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        seq = (np.cumsum(seen) - 1).astype(kind)[ids] if len(ids) else np.zeros(0, kind)
        planes = []
        for level in reversed(range(max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1)):
            bit = (seq & kind(1 << level)).astype(bool)
            planes.append(np.packbits(bit))
            parted, zeros = np.empty_like(seq), len(seq) - int(np.count_nonzero(bit))
            np.compress(~bit, seq, out=parted[:zeros])
            np.compress(bit, seq, out=parted[zeros:])
            seq = parted
        return WaveletMatrix(alphabet, planes, len(ids))

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n).view(bool)

    def to_ids(self) -> np.ndarray:
        """The whole sequence, by undoing the partings from the last plane up."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        seq = np.zeros(self.n, dtype=kind)
        for level in reversed(range(len(self.planes))):
            bit = self._bits(level)
            zeros = self.n - int(np.count_nonzero(bit))
            before = np.empty_like(seq)
            before[np.flatnonzero(~bit)] = seq[:zeros]
            before[np.flatnonzero(bit)] = seq[zeros:] | kind(1 << (len(self.planes) - 1 - level))
            seq = before
        return self.alphabet[seq]

    def rank_index(self) -> list[np.ndarray]:
        """Ones before each block of ``BLOCK_BITS``, a plane: the file has it; a matrix just built counts it."""
        if self._ranks is None:
            step = BLOCK_BITS // 8
            ones = [np.bitwise_count(np.pad(p, (0, -len(p) % step))).reshape(-1, step).sum(1, dtype=np.uint32) for p in self.planes]
            self._ranks = [np.r_[np.uint32(0), np.cumsum(o, dtype=np.uint32)].astype("<u4") for o in ones]
        return self._ranks

    def _rank1(self, level: int, at: int) -> int:
        block, p = at // BLOCK_BITS, self.planes[level]
        lo = block * BLOCK_BITS // 8
        full = int(np.bitwise_count(p[lo : at // 8]).sum())
        rest = int(p[at // 8] >> (8 - at % 8)).bit_count() if at % 8 else 0
        return int(self.rank_index()[level][block]) + full + rest

    def _select(self, level: int, k: int, one: bool) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        ranks = self.rank_index()[level]
        counts = ranks if one else np.arange(len(ranks)) * BLOCK_BITS - ranks.astype(np.int64)
        block = int(np.searchsorted(counts, k, side="right")) - 1
        lo = block * BLOCK_BITS // 8
        bits = np.unpackbits(self.planes[level][lo : lo + BLOCK_BITS // 8])
        return block * BLOCK_BITS + int(np.flatnonzero(bits == one)[k - int(counts[block])])

    def _ones(self, level: int) -> int:
        return int(self.rank_index()[level][-1])

    def access(self, i: int) -> int:
        value = 0
        for level, p in enumerate(self.planes):
            bit = p[i // 8] >> (7 - i % 8) & 1
            ones = self._rank1(level, i)
            i = self.n - self._ones(level) + ones if bit else i - ones
            value = value << 1 | int(bit)
        return int(self.alphabet[value])

    def _symbol(self, token: int) -> int | None:
        s = int(np.searchsorted(self.alphabet, token))
        return s if s < len(self.alphabet) and self.alphabet[s] == token else None

    def _narrow(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                zeros = self.n - self._ones(level)
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` occurs before place ``end``."""
        s = self._symbol(token)
        if s is None:
            return 0
        lo, hi = self._narrow(s, 0, end)
        return hi - lo

    def ranks(self, token: int, ends: np.ndarray) -> np.ndarray:
        """``rank`` of many places at once."""
        s = self._symbol(token)
        if s is None:
            return np.zeros(len(ends), np.int64)
        at, first = ends.astype(np.int64), 0
        for level, plane in enumerate(self.planes):
            ones = np.r_[0, np.cumsum(np.bitwise_count(plane), dtype=np.int64)]
            rest = np.r_[plane, np.uint8(0)][at // 8] >> (8 - at % 8).astype(np.uint16)
            one = ones[at // 8] + np.bitwise_count(rest)
            before = self._rank1(level, first)
            if s >> (len(self.planes) - 1 - level) & 1:
                at, first = self.n - self._ones(level) + one, self.n - self._ones(level) + before
            else:
                at, first = at - one, first - before
        return at - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence; IndexError if there are not so many."""
        s = self._symbol(token)
        lo, hi = self._narrow(s, 0, self.n) if s is not None else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(len(self.planes))):
            one = bool(s >> (len(self.planes) - 1 - level) & 1)
            at = self._select(level, at - (self.n - self._ones(level)) if one else at, one)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def to_file(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    m = WaveletMatrix.build(ids)
    nulls = [i for i, d in enumerate(doc_ids) if d is None]
    docs = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    body = zs.ZstdCompressor(level=1).compress(b"".join([m.alphabet.tobytes(), docs.tobytes(), np.array(lengths, dtype="<i8").tobytes(), *(p.tobytes() for p in m.planes), *(r.tobytes() for r in m.rank_index())]))
    head = json.dumps({"ids": m.n, "alphabet": len(m.alphabet), "docs": len(docs), "planes": len(m.planes), "null_docs": nulls}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + len(body).to_bytes(8, "little") + head + body


def from_file(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths, and the matrix. ValueError if the file is not whole."""
    size, body = int.from_bytes(raw[8:16], "little"), int.from_bytes(raw[16:24], "little")
    if raw[:8] != MAGIC or len(raw) != 24 + size + body:
        raise ValueError("not a whole shard file")
    h = json.loads(raw[24 : 24 + size])
    data = zs.ZstdDecompressor().decompress(raw[24 + size :])
    plane, k = -(-h["ids"] // 8), h["planes"]
    blocks = -(-plane // (BLOCK_BITS // 8)) + 1
    cuts = np.cumsum([0, 4 * h["alphabet"], 8 * h["docs"], 8 * h["docs"], *[plane] * k, *[4 * blocks] * k]).tolist()
    part = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    docs = np.frombuffer(part[1], "<i8").tolist()
    for i in h["null_docs"]:
        docs[i] = None
    return docs, np.frombuffer(part[2], "<i8"), WaveletMatrix(np.frombuffer(part[0], "<u4"), [np.frombuffer(p, np.uint8) for p in part[3 : 3 + k]], h["ids"], [np.frombuffer(p, "<u4") for p in part[3 + k :]])


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes shard files under ``path`` in ascending ``doc_id`` order, nulls first; returns the manifest, itself stored.

    Manifest: ``file, place`` (order of the file), ``first_doc, n_docs, n_ids``. Every attempt of a task writes under
    its own file name, and the manifest has those of the attempts that succeeded. A shard ends with the document that
    brings it to ``shard_ids``. Rows of equal ids are in order of a hash of their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        where, folder = _open(path)
        where.create_dir(folder, recursive=True)
        task, k = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, k
            name = f"{folder}/shard-{task:06d}-{k:06d}-{uuid.uuid4().hex}.wm"
            with where.open_output_stream(name) as f:
                f.write(to_file([d for d, _ in held], [len(i) // 4 for _, i in held], np.frombuffer(b"".join(i for _, i in held), "<u4")))
            row = [[name], [task * PLACES + k], [held[0][0]], [len(held)], [size]]
            held, size, k = [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), *(pa.array(c, pa.int64()) for c in row[1:])], ["file", "place", "first_doc", "n_docs", "n_ids"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1).to_pylist()), strict=True):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    place = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]  # rows of one id are parted by their texts
    ordered = base.documents(docs).withColumn("text_hash", F.xxhash64("text")).repartitionByRange(*place).sortWithinPartitions(*place).drop("text_hash")
    return base.stored(ordered.mapInArrow(run, "file string, place long, first_doc long, n_docs long, n_ids long"))


def read_back(manifest: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, n_end_ids`` of each document, from the files alone.

    ``start`` counts ids of all files before. ``n_end_ids``, how often the end id is in the document, is the difference of
    its ranks at the document's bounds; a document that does not end with it raises an error.
    """
    m = manifest.withColumn("task", F.floor(F.col("place") / PLACES))
    total = m.groupBy("task").agg(F.sum("n_ids").alias("n_ids"))
    sums = lambda of: F.coalesce(F.sum("n_ids").over(of), F.lit(0))
    tasks = total.select("task", sums(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row a writing task
    starts = m.join(F.broadcast(tasks), "task").withColumn("start", F.col("before") + sums(Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
    files = max(1, min(manifest.count(), READERS * manifest.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _open(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_stream(name) as f:
                    docs, lengths, matrix = from_file(f.read())
                raw = memoryview(matrix.to_ids().astype("<u4", copy=False)).cast("B")
                at = np.r_[0, np.cumsum(lengths)]
                ends = matrix.ranks(end_id, at)
                if (ends[1:] - matrix.ranks(end_id, at[1:] - 1) != 1).any():
                    raise ValueError(f"a document of {name} does not end with the end id")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), *(pa.array(c, pa.int64()) for c in (start + at[:-1], lengths, crc, np.diff(ends)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "n_end_ids"])

    return starts.select("file", "start").repartition(files, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long")


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes all of ``docs`` to shard files in the shared folder and reads them back; one row per row of ``docs``.

    Null and empty texts have the end id alone. An empty table gives no files and no rows.
    """
    path = base.work_dir(docs.sparkSession) + "-shards"
    return read_back(write(docs, tokenizer, path, end_id), path, end_id)
