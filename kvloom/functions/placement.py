"""Hashes that place keys on nodes: MurmurHash3 (32 bit), jump hash; vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_M32 = np.uint64(0xFFFFFFFF)
#: Keys up to this length are hashed as one array.
SHORT = 256
#: Fixed value: seed of the second half of a 64-bit key.
SECOND_SEED = 0x9747B28C


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & _M32


def murmur3(rows: list[bytes], seed: np.ndarray | int = 0) -> np.ndarray:
    """MurmurHash3 x86-32 of each byte string; seed: one number, or one for each. Strings are padded to like-sized ones only."""
    n = len(rows)
    size = np.array([len(r) for r in rows], np.int64)
    if size.max(initial=0) > SHORT:
        # Lengths of one power of two together: padding at most doubles what there is.
        out, scale = np.zeros(n, np.uint64), np.frexp(np.maximum(size, SHORT))[1]
        seeds = np.broadcast_to(np.asarray(seed, np.uint64), (n,))
        for k in np.unique(scale):
            at = np.flatnonzero(scale == k)
            out[at] = _murmur3([rows[i] for i in at], size[at], seeds[at])
        return out
    return _murmur3(rows, size, seed)


def _murmur3(rows: list[bytes], size: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    n = len(rows)
    width = (int(size.max(initial=0)) + 4) // 4 * 4
    flat = np.zeros((n, width), np.uint8)
    for i, r in enumerate(rows):
        flat[i, : len(r)] = np.frombuffer(r, np.uint8)
    words = flat.view("<u4").astype(np.uint64)
    h = np.broadcast_to(np.asarray(seed, np.uint64), (n,)).copy()

    def scramble(k: np.ndarray) -> np.ndarray:
        return (_rotl((k * np.uint64(0xCC9E2D51)) & _M32, 15) * np.uint64(0x1B873593)) & _M32

    for w in range(width // 4):
        full = size >= 4 * w + 4
        mixed = (_rotl(h ^ scramble(words[:, w]), 13) * np.uint64(5) + np.uint64(0xE6546B64)) & _M32
        h = np.where(full, mixed, h)
        tail = (size > 4 * w) & ~full
        h = np.where(tail, h ^ scramble(words[:, w]), h)
    h ^= size.astype(np.uint64)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & _M32
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & _M32
    return h ^ (h >> np.uint64(16))


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys."""
    k = keys.astype(np.uint64).copy()
    b, j = np.full(k.size, -1, np.int64), np.zeros(k.size, np.int64)
    alive = j < buckets
    while alive.any():
        b[alive] = j[alive]
        k[alive] = k[alive] * np.uint64(2862933555777941757) + np.uint64(1)
        j[alive] = ((b[alive] + 1) * (float(1 << 31) / ((k[alive] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        alive = j < buckets
    return b


def _bytes(texts: pd.Series) -> list[bytes]:
    return [b"" if t is None else t if isinstance(t, bytes) else str(t).encode() for t in texts]


def seeded_murmur3(seed: int):
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(murmur3(_bytes(texts), seed).astype(np.int64), index=texts.index)

    return hashed


def murmur3_col(text) -> Column:
    return seeded_murmur3(0)(text)


def jump_col(buckets: int):
    """Bucket by jump hash of the 64-bit key made of two murmurs."""

    @F.pandas_udf("int")
    def placed(texts: pd.Series) -> pd.Series:
        rows = _bytes(texts)
        key = (murmur3(rows, 0) << np.uint64(32)) | murmur3(rows, SECOND_SEED)
        return pd.Series(jump(key, buckets).astype(np.int32), index=texts.index)

    return placed
