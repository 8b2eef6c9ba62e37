"""Exact vector search by cosine that skips what cannot be near, and its scores against labelled queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralog.sources import files

#: Rows of a block of queries or vectors at most, about; a task holds two blocks and their products at a time.
BLOCK = 1024
#: Vectors on which centres are fitted, and cells, at most.
SAMPLE, MOST_CELLS = 20_000, 1024


def of_types(vectors: DataFrame, column: str, wanted: list) -> DataFrame:
    """The vectors of these types; a type that no vector has is an error, as it would only give an empty answer."""
    have = {r[0] for r in vectors.where(F.col(column).isin(wanted)).select(column).distinct().collect()}
    if unknown := [t for t in wanted if t not in have]:
        raise ValueError(f"no vector has the type {unknown}")
    return vectors.where(F.col(column).isin(wanted))


@dataclass
class Cells:
    """Centres (k-means of a bounded sample) by which vectors lie in cells, and of each cell its radius and parts."""

    centres: np.ndarray
    radius: np.ndarray
    parts: np.ndarray


def centres(vectors: DataFrame, sample: int = SAMPLE, most: int = MOST_CELLS, rounds: int = 8) -> np.ndarray:
    """Centres of about the square root of the vectors' number, ``most`` at most, fitted on ``sample`` unit vectors by hash order.

    Any centres give exact results; good ones let more be skipped.
    """
    n = vectors.count()
    rows = vectors.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    x = _unit(rows.column("embedding").combine_chunks())
    k = min(most, len(x), max(1, round(n**0.5)))
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        nearest = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        total, size = np.zeros_like(c), np.bincount(nearest, minlength=len(c))
        np.add.at(total, nearest, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def _placed(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """``vec_id, embedding, cell, distance``: the nearest centre of each vector, and how far off it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, BLOCK):
            x = _unit(batch.column(1))
            cell = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
            d = np.linalg.norm(x - c[cell], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(d)], ["vec_id", "embedding", "cell", "distance"])

    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    kind = vectors.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, embedding {kind}, cell int, distance double")


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """``cell, part, ids, vectors, radius``: cells, and of those of over ``block`` vectors parts by hash of the id."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("n_parts")).cast("int").alias("part")
    rows = placed.join(sizes, "cell").select("cell", part, F.struct("vec_id", "embedding").alias("v"), "distance")
    lists = rows.groupBy("cell", "part").agg(F.collect_list("v").alias("v"), F.max("distance").alias("radius"))
    return files.stored(lists.select("cell", "part", F.col("v.vec_id").alias("ids"), F.col("v.embedding").alias("vectors"), "radius"))


#: Rows with the vectors of a whole block that are sent to Python at a time.
BLOCK_ROWS = 16


def _stored_in_small_batches(df: DataFrame) -> DataFrame:
    """``files.stored``, with ``BLOCK_ROWS`` rows a batch meanwhile: a row holds blocks of vectors, and the usual 10,000 would fill a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(name)
    conf.set(name, BLOCK_ROWS)
    try:
        return files.stored(df)
    finally:
        conf.set(name, usual)


def _slack(score: np.ndarray) -> np.ndarray:
    """Distance within which unit vectors of this rounded cosine, or a better one, must lie."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (score - 1.5e-6)))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each row's ``k`` best, ties by id; the rest of a shorter row is minus infinity."""
    few = min(k, scores.shape[1])
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :few]
    return np.take_along_axis(scores, order, 1), ids[order]


def _products(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
    s = np.round(a @ b.T, 6)
    s[a_ids[:, None] == b_ids[None, :]] = -np.inf
    return s


def _few(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in consecutive parts of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _block_rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    at = [batch.schema.get_field_index(n) for n in names]
    for i in range(len(batch)):
        yield tuple(batch.column(c)[i] for c in at)


@dataclass
class Search:
    """Query blocks with bounds of their k-th best distance, vector blocks, and the pairs of blocks that are not skipped."""

    queries: DataFrame
    blocks: DataFrame
    pairs: DataFrame
    cells: Cells

    def report(self) -> DataFrame:
        """``n_query_blocks, n_blocks, n_visited, skipped``: of all pairs of blocks the share that is not looked at."""
        n = self.queries.agg(F.count(F.lit(1)).alias("n_query_blocks")).crossJoin(self.blocks.agg(F.count(F.lit(1)).alias("n_blocks"))).crossJoin(self.pairs.agg(F.count(F.lit(1)).alias("n_visited")))
        return n.withColumn("skipped", F.round(1 - F.col("n_visited") / (F.col("n_query_blocks") * F.col("n_blocks")), 4))


def plan(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> Search | None:
    """Which blocks of vectors each block of queries must visit; None without vectors.

    Both are dealt into cells; a query first meets one block of its own cell, whose k-th best bounds the distance of its
    k best of all. By the triangle inequality a cell, or a block of it, cannot hold one of them where its centre is further
    off than that bound and both radii together.
    """
    vectors = vectors.where("vec_id is not null and embedding is not null")
    c = centres(vectors)
    if not len(c):
        return None
    blocks = _blocks(_placed(vectors, c), block)
    sizes = blocks.groupBy("cell").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    cells = Cells(c, np.full(len(c), -np.inf), np.zeros(len(c), int))
    for r in sizes:
        cells.radius[r["cell"]], cells.parts[r["cell"]] = r["radius"], r["n"]
    kind = vectors.schema["embedding"].dataType.simpleString()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = []
            for q_ids, q, ids, v in _block_rows(batch, ["q_ids", "q_vectors", "ids", "vectors"]):
                a = _unit(q.values)
                bound.append(np.full(len(a), np.inf))
                if v.is_valid:
                    b, b_ids = _unit(v.values), ids.values.to_numpy(zero_copy_only=False)
                    s, _ = _best(_products(a, q_ids.values.to_numpy(zero_copy_only=False), b, b_ids), b_ids, k)
                    if s.shape[1] == k:
                        bound[-1] = np.where(np.isfinite(s[:, -1]), _slack(np.where(np.isfinite(s[:, -1]), s[:, -1], 0.0)), np.inf)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("q_cell", "q_part", "q_ids", "q_vectors", "q_radius")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tolist() for x in bound], pa.list_(pa.float64()))], ["q_cell", "q_part", "q_ids", "q_vectors", "q_radius", "bound"])

    q = _blocks(_placed(queries, c), block)
    q = q.select(*(F.col(n).alias(f"q_{n}") for n in ("cell", "part", "ids", "vectors", "radius")))
    first = q.join(blocks.where("part = 0").select("cell", "ids", "vectors"), F.col("q_cell") == F.col("cell"), "left")
    q = _stored_in_small_batches(first.mapInArrow(bounded, f"q_cell int, q_part int, q_ids array<long>, q_vectors array<{kind}>, q_radius double, bound array<double>"))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, BLOCK_ROWS):  # each row meets all centres
            cell, part, radius, far = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            gap = np.linalg.norm(c[cell][:, None, :] - c[None, :, :], axis=2)
            row, to = np.nonzero(gap <= (radius + far)[:, None] + cells.radius[None, :] + 1e-9)
            columns = [cell[row], part[row], radius[row] + far[row], to, gap[row, to]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64()), strict=True)], ["q_cell", "q_part", "reach", "cell", "gap"])

    few = q.select("q_cell", "q_part", "q_radius", F.array_max("bound").alias("far")).repartition(files.tasks(q.sparkSession), "q_cell", "q_part")
    pairs = few.mapInArrow(reached, "q_cell int, q_part int, reach double, cell int, gap double")
    pairs = pairs.join(blocks.select("cell", "part", "radius"), "cell").where(F.col("gap") <= F.col("reach") + F.col("radius") + 1e-9)
    return Search(q, blocks, files.stored(pairs.select("q_cell", "q_part", "cell", "part")), cells)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``query_id, vec_id, score, rank``: the k nearest by cosine, ties by id. A vector is not its own neighbour.

    Exact: of all pairs of blocks only those are looked at that ``plan`` cannot rule out, and in a pair only the queries
    that the block can serve. A pair is one matrix product; a query's few best of each block meet by query.
    """
    search = plan(queries, vectors, k, block)
    schema = "query_id long, vec_id long, score double"
    if search is None:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    both = search.pairs.join(search.blocks, ["cell", "part"]).join(search.queries, ["q_cell", "q_part"]).select("cell", "radius", "ids", "vectors", "q_ids", "q_vectors", "bound")
    middle = search.cells.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, radius, ids, v, q_ids, q, bound in _block_rows(batch, batch.schema.names):
                a, far = _unit(q.values), bound.values.to_numpy(zero_copy_only=False)
                near = np.linalg.norm(a - middle[cell.as_py()], axis=1) <= far + radius.as_py() + 1e-9
                if not near.any():
                    continue
                a_ids, b_ids = q_ids.values.to_numpy(zero_copy_only=False)[near], ids.values.to_numpy(zero_copy_only=False)
                score, of = _best(_products(a[near], a_ids, _unit(v.values), b_ids), b_ids, k)
                ok = np.isfinite(score) & (_slack(score) <= far[near][:, None] + 1e-5)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(a_ids[:, None], score.shape)[ok]), pa.array(of[ok]), pa.array(score[ok])], ["query_id", "vec_id", "score"])

    found = _stored_in_small_batches(both.mapInArrow(run, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def scores(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, group: str, k: int) -> DataFrame:
    """Hit rate in the top k and mean reciprocal rank, by ``group`` and over all (null). ``relevant``: ``query_id, vec_id`` pairs."""
    first = ranked.join(relevant, ["query_id", "vec_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    q = queries.join(first, "query_id", "left")
    return q.rollup(group).agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6).alias("precision_at_k"), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


def pending(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(vectors, key, "left_anti")
