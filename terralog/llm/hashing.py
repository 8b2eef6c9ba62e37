"""Words of whole texts and hashes of their n-grams, for a batch of texts at once in numpy.

A word's hash is a polynomial over its bytes, taken from running sums of the batch; an n-gram's hash combines those of its
words. Both have 64 bits. Words are runs of bytes other than space and tab to carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

STEP_BYTES = 500_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Also takes all ASCII other than letters, digits and line ends for spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b == 10 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Of a batch: word hashes, the first word of each text (and one past the last), each word's bytes, each text's first byte."""

    hashes: np.ndarray
    starts: np.ndarray
    text: bytes
    begin: np.ndarray
    end: np.ndarray
    offset: np.ndarray

    def ngrams(self, k: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams in order, repeated ones too, and the first of each text (and one past the last).

        ``whole_if_short``: a text of 1 to ``k`` - 1 words has its whole sequence as its only n-gram.
        """
        n = np.diff(self.starts)
        count = np.maximum(0, n - k + 1)
        if whole_if_short:
            count = np.where((n > 0) & (n < k), 1, count)
        first = np.r_[0, np.cumsum(count)]
        doc = np.repeat(np.arange(len(n)), count)
        at = self.starts[doc] + np.arange(len(doc)) - first[doc]
        size = np.minimum(n[doc], k)
        h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        padded = np.r_[self.hashes, np.zeros(k, np.uint64)]
        short = bool((size < k).any())
        for j in range(k):
            w = padded[at + j] * _PLACE[j]
            h += np.where(j < size, w, np.uint64(0)) if short else w
        return mix(h), first

    def bytes_of(self, text: int) -> list[bytes]:
        return [self.text[a:b] for a, b in zip(self.begin[self.starts[text] : self.starts[text + 1]].tolist(), self.end[self.starts[text] : self.starts[text + 1]].tolist(), strict=True)]


def words(texts: list[str], table: bytes | None = LOWER) -> Words:
    return words_of([t.encode("utf-8", "surrogatepass") for t in texts], table)


def words_of(raw: list[bytes], table: bytes | None = LOWER) -> Words:
    """The words of texts in UTF-8; without a ``table`` they stay as they are."""
    text = b"\n".join(raw)
    text = text.translate(table) if table else text
    buf = np.frombuffer(text + b"\n", np.uint8)
    inside = ~_SPACE[buf]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), dtype=np.uint64)]
    hashes = mix((sums[end] - sums[begin]) * _power(_UNBASE, len(buf))[begin])
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return Words(hashes, np.searchsorted(begin, at), text, begin, end, at)


def steps(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``STEP_BYTES`` characters; a longer text is a range of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= STEP_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end
