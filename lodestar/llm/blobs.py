"""Numbers and words of a whole block of documents as one compressed value.

A row per word would cost a shuffle far more than the word; a row per block and
bucket, with its words or numbers in one column, costs about what they hold.
"""

from __future__ import annotations

import numpy as np
import zstandard


_KINDS = {"u1": b"1", "u2": b"2", "u4": b"4", "u8": b"8", "f8": b"f"}


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them all, or floats, compressed byte by byte place."""
    values = np.asarray(values)
    if values.dtype.kind != "f":
        top = int(values.max()) if len(values) else 0
        values = values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
    else:
        values = values.astype("<f8")
    places = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return _KINDS[values.dtype.str[1:]] + zstandard.compress(places.tobytes(), 3)


def unpack_numbers(blob: bytes) -> np.ndarray:
    dtype = np.dtype({b: f"<{k}" for k, b in _KINDS.items()}[blob[:1]])
    places = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(places.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as their steps."""
    values = values.astype(np.uint64)
    return pack_numbers(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(blob), dtype=np.uint64)


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack_numbers(np.fromiter(map(len, words), np.int64, len(words)))
    return len(lengths).to_bytes(8, "little") + lengths + zstandard.compress(b"".join(words), 3)


def unpack_words(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:8], "little")
    ends = np.cumsum(unpack_numbers(blob[8 : 8 + n]).astype(np.int64)).tolist()
    joined = zstandard.decompress(blob[8 + n :])
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the runs [start, start + length), one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
