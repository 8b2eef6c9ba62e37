"""Texts of an Arrow batch in slices of bounded size, so that a Python worker holds the objects of one slice only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a slice, about; a longer text is a slice of its own.
BYTES = 1 << 20


def slices(texts: pa.Array, most: int = BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of ``texts`` that begin within ``most`` bytes of each other, in order; none of an empty array."""
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 16)[:-1]]) if len(texts) else np.zeros(0)
    starts = [*np.flatnonzero(np.diff(before // most, prepend=-1)).tolist(), len(texts)]
    for a, b in zip(starts, starts[1:], strict=False):
        yield texts.slice(a, b - a)


def each(batches: Iterator[pa.Array], of: Callable[[str | None], object], kind: pa.DataType, most: int = BYTES) -> Iterator[pa.Array]:
    """``of`` each text as arrays of ``kind``; a slice is done and handed on before the next one is read."""
    for texts in batches:
        for part in slices(texts, most):
            yield pa.array(map(of, part.to_pylist()), kind)
