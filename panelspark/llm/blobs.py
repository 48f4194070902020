"""Columns of numbers as compressed bytes, for shuffles whose rows are groups of texts rather than single keys."""

from __future__ import annotations

from functools import cache

import numpy as np
import zstandard

#: One for each worker: blobs are small and many, and making a compressor costs more than using it.
@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _planes(x: np.ndarray) -> bytes:
    """Byte 0 of all numbers, then byte 1 of all, and so on: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers as bytes; ascending unsigned 64-bit numbers are stored by their differences."""
    x = np.ascontiguousarray(x)
    if ascending and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return _compressor(1).compress(_planes(x)) if len(x) else b""


def unpack(blob: bytes, dtype, ascending: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not blob:
        return np.zeros(0, dtype)
    raw = np.frombuffer(_decompressor().decompress(blob), np.uint8)
    x = np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)
    return np.cumsum(x, dtype=dtype) if ascending else x


def pack_bytes(raw: bytes, level: int = 3) -> bytes:
    return _compressor(level).compress(raw)


def unpack_bytes(blob: bytes) -> bytes:
    return _decompressor().decompress(blob)
