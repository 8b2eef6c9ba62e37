"""Compression classifier of text quality (operator 7).

zstandard dictionaries are trained on labelled good and on labelled bad text. Each whole text is compressed with both,
block by block; the normalised difference of the compressed sizes, (bad - good) / (bad + good), becomes a calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .compression import blocks, compressor, sizes, trained

PER_CLASS = 1500
MAX_CHARS = 40_000
DICT_BYTES = 65_536
BLOCK = 1024


def features(text: str, good, bad) -> list[float]:
    """Normalised size difference over the text, in its worst block, and over its blocks' lower quarter; 0 for an empty text."""
    w = blocks(text, BLOCK)
    if not w:
        return [0.0, 0.0, 0.0]
    g, b = sizes(good, w), sizes(bad, w)
    d = (b - g) / (b + g)
    return [float((b.sum() - g.sum()) / (b.sum() + g.sum())), float(d.min()), float(np.quantile(d, 0.25))]


def _pair(rows: list) -> tuple[bytes, bytes]:
    return tuple(trained([w for _, t, y in rows if y == c for w in blocks(t, BLOCK)], DICT_BYTES) for c in (1, 0))


def fit(rows: list, counts: dict[int, int]) -> dict:
    """Dictionaries of all rows, and a calibration on rows scored by dictionaries of the other half.

    ``rows``: (id, text, label). With one class only, or none, the score is that class's share (0.5 without labels).
    """
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.5
    if len({y for *_, y in rows}) < 2:
        return {"good": b"\n", "bad": b"\n", "w": [float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), 0.0, 0.0, 0.0]}
    half = [[r for i, r in enumerate(rows) if i % 2 == h] for h in (0, 1)]
    x, y = [], []
    for h in (0, 1):
        g, b = (compressor(c) for c in _pair(half[1 - h]))
        x += [features(t, g, b) for _, t, _ in half[h]]
        y += [c for *_, c in half[h]]
    g, b = _pair(rows)
    scale = 50.0
    return {"good": g, "bad": b, "w": list(base.logistic(np.array(x) * scale, np.array(y), prior) * np.r_[1, np.full(3, scale)])}


def scorer(model: dict):
    """Arrow UDF from text to score: only texts go to Python and only numbers come back; null and empty texts have the features 0."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        good, bad, w = compressor(model["good"]), compressor(model["bad"]), np.array(model["w"])
        for texts in batches:
            x = np.array([features(t.as_py() or "", good, bad) for t in texts]).reshape(-1, 3)
            yield pa.array(base.sigmoid(w[0] + x @ w[1:]))

    return score


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, threshold: float = 0.7, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Labels of rows with crc32(doc_id as text) mod ``parts`` = ``held`` are not read. Fitted on at most ``per_class``
    labelled texts a class, each of at most ``max_chars``. Repeated rows are scored alike; a null id is never held out.
    """
    rows, counts = base.labelled_sample(docs, labels, label, base.fold(parts=parts) != held, per_class, max_chars)
    out = base.documents(docs).select("doc_id", scorer(fit(rows, counts))("text").alias("score"))
    return out.select("doc_id", F.coalesce(base.fold(parts=parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, threshold: float = 0.7, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` predicts as 1; they stay where they are, nothing is shuffled."""
    model = fit(*base.labelled_sample(docs, labels, label, base.fold(parts=parts) != held, per_class, max_chars))
    return docs.where(scorer(model)(docs["text"].cast("string")) >= threshold)
