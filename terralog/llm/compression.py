"""zstandard with dictionaries as a measure of likeness to labelled text."""

from __future__ import annotations

import numpy as np
import zstandard as zs


def compressor(content: bytes, level: int = 3, **params) -> zs.ZstdCompressor:
    """Compressor with a raw-content dictionary and the smallest frames: no magic number, size, checksum or dictionary id."""
    p = zs.ZstdCompressionParameters.from_level(level, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, **params)
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


def trained(samples: list[bytes], size: int, **params: int) -> bytes:
    """Content of a zstandard dictionary trained on ``samples``; the end of the samples where there are too few to train on.

    ``params``: ``k`` and ``d``, the bytes of a segment and of a match, where the trainer shall not look for them itself.
    """
    samples = [s for s in samples if s]
    try:
        return zs.train_dictionary(size, samples, **({"level": 3} | params)).as_bytes()[-size:]
    except (zs.ZstdError, ValueError):
        return b"\n".join(samples)[-size:] or b"\n"


def blocks(text: str, size: int) -> list[bytes]:
    """The whole text in UTF-8, in pieces of ``size`` bytes; the last piece takes a rest of under half of it."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, round(len(raw) / size))
    return [raw[i * size : (i + 1) * size if i < n - 1 else len(raw)] for i in range(n)] if raw else []


def sizes(c: zs.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    return np.array([len(c.compress(w)) for w in windows], dtype=np.float64)
