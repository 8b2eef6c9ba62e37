"""Shared helpers: input columns, the shared work folder, labelled samples, and logistic calibration."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string); a null text is empty, other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a temporary folder in local mode, as in tests; ValueError on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terralog-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/terralog-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that are sent to Python at a time, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def stored_in_small_batches(df: DataFrame) -> DataFrame:
    """``stored``, with ``BATCH_BYTES`` a batch meanwhile: the usual 10,000 rows, of up to 64 MB, fill an executor's buffers and its workers."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = conf.get(name, None)
    conf.set(name, BATCH_BYTES)
    try:
        return stored(df)
    finally:
        if usual is None:
            conf.unset(name)
        else:
            conf.set(name, usual)


def fold(column: str = "doc_id", parts: int = 5):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no column of the frames has it (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Share of the id hashes, of 2 ** 30, below which a labelled id is looked up among the documents.
_HASHES = 1 << 30


def _hash_place(column: str = "doc_id"):
    return F.pmod(F.xxhash64(column), F.lit(_HASHES))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int, max_chars: int) -> tuple[list, dict[int, int]]:
    """Up to ``per_class`` labelled texts of each class, by hash order of the id, and the count of all labelled rows a class.

    ``train`` is a condition on ``doc_id`` of rows whose labels may be used. The bounds are parameters of the caller;
    texts over ``max_chars`` are not sampled (they are still scored). A document with both labels counts as 1, and of
    rows with one id the first text is taken.

    One scan of the documents: ids of a hash below a bound, three times as many as are wanted, are broadcast to it. Where
    too few of them have a document, the bound is raised and the scan repeated, until all labels have been looked up.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    lab = lab.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    bound = {y: min(_HASHES, -(-3 * per_class * _HASHES // n)) for y, n in counts.items()}
    place, text = _hash_place(), F.length("text") <= max_chars
    first = Window.partitionBy("y").orderBy(place, "doc_id")
    found: dict[int, list] = {}
    while todo := [y for y in sorted(counts) if y not in found]:
        wanted = lab.where(reduce(lambda a, b: a | b, ((F.col("y") == y) & (place < bound[y]) for y in todo)))
        rows = documents(docs).where(text).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        rows = rows.withColumn("nth", F.row_number().over(first))
        got: dict[int, list] = {y: [] for y in todo}
        for r in rows.where(F.col("nth") <= per_class).orderBy("y", "nth").collect():
            got[r["y"]].append((r["doc_id"], r["text"], r["y"]))
        for y in todo:
            if len(got[y]) >= per_class or bound[y] == _HASHES:
                found[y] = got[y]
            bound[y] = min(_HASHES, 8 * bound[y])
    return [r for y in sorted(found) for r in found[y]], counts


def logistic(x: np.ndarray, y: np.ndarray, prior: float | None = None, ridge: float = 1.0) -> np.ndarray:
    """Intercept and weights by Newton steps; with ``prior`` the intercept is moved from the sample's share of 1 to that."""
    a = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(a.shape[1]), np.r_[1e-6, np.full(a.shape[1] - 1, ridge)]
    for _ in range(30):
        p = sigmoid(a @ w)
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(h, a.T @ (y - p) - pen * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    if prior is not None:
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        prior = np.clip(prior, 1e-6, 1 - 1e-6)
        w[0] += np.log(prior / (1 - prior)) - np.log(rate / (1 - rate))
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
