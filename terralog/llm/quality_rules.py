"""Quality rules (operator 1): counts over whole texts, two fixed rules, and boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents, flattened into node arrays and scored for a batch at
once. Symbols, repeated lines, repeated words and capitals may only lower the score (monotonic constraints).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, boosting

PER_CLASS = 3000
MAX_CHARS = 40_000
#: Fixed values of the contract: symbol characters, least words, most repeated words in percent.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistic: what it may do to the score (-1: only lower it).
STATISTICS = {"symbols_a_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "capital_share": -1, "word_length": 0, "distinct_word_share": 0, "log_words": 0, "end_mark_share": 0, "exclaims_a_word": -1, "digit_share": 0, "line_words": 0}


def repeated_words(words: list[bytes]) -> int:
    """Words inside any three-word window that occurs at least twice, its first occurrence too."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    many = {w for w, n in Counter(windows).items() if n > 1}
    n, covered = 0, 0
    for i, w in enumerate(windows):
        if w in many:
            n += i + 3 - max(covered, i)
            covered = i + 3
    return n


def count(text: str) -> tuple[list[int], list[float]]:
    """The contract's counts, and the statistics that the trees use."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at just these: space, tab to carriage return
    n = len(words)
    word_chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen: set[str] = set()
    dup = filled = ended = 0
    for line in lines:
        if line in seen:
            dup += 1
            filled += 1
        elif bare := line.strip(WHITE):
            seen.add(line)
            filled += 1
            ended += bare[-1] in ".!?\"'"
    repeat = repeated_words(words)
    size = max(1, len(raw))
    stats = [
        symbols / max(1, n), dup / max(1, filled), repeat / max(1, n), (len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size, word_chars / max(1, n), len(set(words)) / max(1, n),
        float(np.log1p(n)), ended / max(1, filled - dup), raw.count(b"!") / max(1, n), (len(raw) - len(raw.translate(None, b"0123456789"))) / size, float(np.log1p(n / max(1, filled))),
    ]
    return [n, word_chars, symbols, dup, repeat], stats


def fit(rows: list, counts: dict[int, int]) -> boosting.Forest:
    """``rows``: (id, text, label). Without labels of both kinds the trees keep every document."""
    x = np.array([count(t)[1] for _, t, _ in rows]).reshape(-1, len(STATISTICS))
    y = np.array([c for *_, c in rows], dtype=float)
    if len(np.unique(y)) < 2:
        return boosting.fit(np.zeros((0, len(STATISTICS))), np.zeros(0), list(STATISTICS.values()), prior=0.9)
    return boosting.fit(x, y, list(STATISTICS.values()), prior=counts.get(1, 0) / max(1, sum(counts.values())))


def apply(docs: DataFrame, forest: boosting.Forest, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts, ``base_failed``, ``kept`` and ``score``.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [count(t.as_py()) for t in batch.column(1)]
            c = np.array([b[0] for b in both], dtype=np.int64).reshape(-1, len(COUNTS))
            score = forest.predict(np.array([b[1] for b in both]).reshape(-1, len(STATISTICS)))
            failed = (c[:, 0] < LEAST_WORDS) | (100 * c[:, 4] > MOST_REPEATED * c[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in c.T), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return base.documents(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Fits on at most ``per_class`` labelled documents a class, each of at most ``max_chars``, and applies to all."""
    return apply(docs, fit(*base.labelled_sample(docs, labels, label, F.lit(True), per_class, max_chars)), threshold)
