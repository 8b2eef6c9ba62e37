"""Compression-distance toxicity (operator 4).

Two zstandard dictionaries are trained: one on windows of ordinary text, one on toxic passages, which are the places of words
that far more toxic than ordinary texts have. A text's words are cut into short windows; each window is compressed with the
ordinary dictionary alone and with the toxic one put to it, so that the difference in length is what the toxic dictionary
saves. How often each saving occurs in toxic and in ordinary texts weighs it; the sum of the weights over a text's windows,
their mean and the number of windows are calibrated to a score from 0 to 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .compression import compressor, sizes, trained

PER_CLASS = 2000
MAX_CHARS = 40_000
WINDOW_WORDS = 6
ORDINARY_BYTES = 32_768
#: Sizes of the toxic dictionary that are tried in fitting.
TOXIC_BYTES = (512, 1024, 2048)
#: Bytes of a segment and of a match in training dictionaries, and the shortest match in compressing windows: about a word.
SEGMENT, MATCH, MIN_MATCH = 16, 6, 6
#: A word marks toxic passages if so many texts have it, so many times the share of toxic as of ordinary ones, and if its
#: log-likelihood is at least this share of the highest.
LEAST_TEXTS, LEAST_RATIO, LEAST_SHARE = 3, 5, 0.05
#: Bytes saved by the toxic dictionary in a window are counted from the least to the most; others as these.
SAVED = (-2, 9)
MARKS = b".,;:!?\"'()[]{}*#$%&|"


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def windows(text: str) -> list[bytes]:
    """The whole text, ``WINDOW_WORDS`` words each, in lower case with single spaces around words."""
    w = _words(text)
    return [b" " + b" ".join(w[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(w), WINDOW_WORDS)]


def marking_words(rows: list) -> set[bytes]:
    """Words, without the punctuation around them, that far more toxic than ordinary texts have."""
    of, n = {0: Counter(), 1: Counter()}, Counter(y for *_, y in rows)
    for _, text, y in rows:
        of[y].update({w.strip(MARKS) for w in _words(text)} - {b""})
    weight = {}
    for w, c in of[1].items():
        toxic, other = c / n[1], (of[0][w] + 0.5) / max(1, n[0])
        if c >= LEAST_TEXTS and toxic > LEAST_RATIO * other:
            weight[w] = c * math.log(toxic / other)
    return {w for w, x in weight.items() if x >= LEAST_SHARE * max(weight.values())}


def toxic_passages(rows: list) -> list[bytes]:
    """Every place of a marking word in toxic texts, with the punctuation that it has there."""
    marks = marking_words(rows)
    return [b" " + w + b" " for _, t, y in rows if y for w in _words(t) if w.strip(MARKS) in marks]


def dictionaries(rows: list, sizes_tried: tuple[int, ...]) -> tuple[bytes, list[bytes]]:
    """The ordinary dictionary, from all windows of ordinary rows, and the toxic ones of these sizes."""
    ordinary = trained([w for _, t, y in rows if not y for w in windows(t)], ORDINARY_BYTES, k=SEGMENT, d=MATCH)
    found = toxic_passages(rows)
    return ordinary, [trained(found, size, k=SEGMENT, d=MATCH) for size in sizes_tried]


def _pair(ordinary: bytes, toxic: bytes):
    """Compressors with the toxic dictionary put to the ordinary one, and with the latter alone."""
    p = {"min_match": MIN_MATCH, "strategy": 1}
    return compressor(ordinary + toxic, **p), compressor(ordinary, **p)


def savings(text: str, toxic, ordinary) -> np.ndarray:
    """How many windows of the whole text the toxic dictionary saves each number of bytes of ``SAVED`` in."""
    w, (lo, hi) = windows(text), SAVED
    d = np.clip(sizes(ordinary, w) - sizes(toxic, w), lo, hi).astype(int) - lo
    return np.bincount(d, minlength=hi - lo + 1)


def weights(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log ratio of each saving's share among windows of toxic and of ordinary texts."""
    toxic, ordinary = (counts[y == c].sum(0) + 1 for c in (1, 0))
    return np.log(toxic / toxic.sum()) - np.log(ordinary / ordinary.sum())


def features(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum and mean of the windows' weights and the log of their number, for each text; 0 for an empty one."""
    n = counts.sum(1)
    return np.column_stack([counts @ weight, counts @ weight / np.maximum(1, n), np.log1p(n)])


def _loss(x: np.ndarray, y: np.ndarray) -> float:
    """Log loss over five folds."""
    p = np.zeros(len(y))
    for k in range(5):
        out = np.arange(len(y)) % 5 == k
        w = base.logistic(x[~out], y[~out])
        p[out] = base.sigmoid(w[0] + x[out] @ w[1:])
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(rows: list, counts: dict[int, int]) -> dict:
    """Dictionaries, the size of the toxic one by log loss on the other half of the sample, and the calibration.

    ``rows``: (id, text, label). With one class only, or none, the score is that class's share (0.5 without labels).
    """
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.5
    if len({y for *_, y in rows}) < 2:
        flat = [math.log((prior + 1e-3) / (1 - prior + 1e-3)), 0.0, 0.0, 0.0]
        return {"ordinary": b"\n", "toxic": b"\n", "weight": [0.0] * (SAVED[1] - SAVED[0] + 1), "w": flat}
    half = [[r for i, r in enumerate(rows) if i % 2 == h] for h in (0, 1)]
    y = np.array([c for h in (0, 1) for *_, c in half[h]], dtype=float)
    tried = [dictionaries(half[1 - h], TOXIC_BYTES) for h in (0, 1)]
    best = None
    for k, size in enumerate(TOXIC_BYTES):
        counts = np.array([savings(t, *pair) for h, (o, toxic) in enumerate(tried) for pair in [_pair(o, toxic[k])] for _, t, _ in half[h]])
        weight = weights(counts, y)
        x = features(counts, weight)
        loss = _loss(x, y)
        if best is None or loss < best[0]:
            best = (loss, size, weight, list(base.logistic(x, y, prior)))
    ordinary, (toxic,) = dictionaries(rows, best[1:2])
    return {"ordinary": ordinary, "toxic": toxic, "weight": list(best[2]), "w": best[3]}


def scorer(model: dict):
    """Arrow UDF from text to score; null and empty texts have the features 0."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair, weight, w = _pair(model["ordinary"], model["toxic"]), np.array(model["weight"]), np.array(model["w"])
        for texts in batches:
            counts = np.array([savings(t.as_py() or "", *pair) for t in texts], dtype=np.int64).reshape(-1, len(weight))
            yield pa.array(base.sigmoid(w[0] + features(counts, weight) @ w[1:]))

    return score


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0, threshold: float = 0.5, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Labels of rows with crc32(doc_id as text) mod ``parts`` = ``held`` are not read. Fitted on at most ``per_class``
    labelled texts a class, each of at most ``max_chars``. Repeated rows are scored alike; a null id is never held out.
    """
    rows, counts = base.labelled_sample(docs, labels, label, base.fold(parts=parts) != held, per_class, max_chars)
    out = base.documents(docs).select("doc_id", scorer(fit(rows, counts))("text").alias("score"))
    return out.select("doc_id", F.coalesce(base.fold(parts=parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
