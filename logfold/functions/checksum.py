"""The write-ahead log's chained checksum, in closed form.

One step maps (s1, s2) to (s1 + x + s2, s2 + y + s1') modulo 2**32, an affine map with a fixed matrix. So n steps are one
matrix power on the seed plus a weighted sum of the words, and the weights depend on n only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MASK = 0xFFFFFFFF


@lru_cache(64)
def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step's matrix [[1, 1], [1, 2]] from n - 1 down to 0 as (a, b, d), and the n-th."""
    out = np.empty((n, 3), np.uint64)
    a, b, d = 1, 0, 1
    for k in range(n - 1, -1, -1):
        out[k] = a, b, d
        a, b, d = (a + b) & MASK, (b + d) & MASK, (b + 2 * d) & MASK
    return out, np.array([a, b, d], np.uint64)


def checksum(data: bytes, seed: tuple[int, int] = (0, 0), big_endian: bool = False) -> tuple[int, int]:
    """The checksum pair after data, whose length must be a multiple of eight."""
    if len(data) % 8:
        raise ValueError("a checksum needs whole pairs of words")
    words = np.frombuffer(data, ">u4" if big_endian else "<u4").astype(np.uint64)
    w, last = _weights(len(words) // 2)
    x, y = words[0::2], words[0::2] + words[1::2]  # what a step adds to s1 and to s2
    m = np.uint64(MASK)
    s1 = ((w[:, 0] * x & m) + (w[:, 1] * (y & m) & m)).sum() + last[0] * np.uint64(seed[0]) % (m + np.uint64(1)) + last[1] * np.uint64(seed[1]) % (m + np.uint64(1))
    s2 = ((w[:, 1] * x & m) + (w[:, 2] * (y & m) & m)).sum() + last[1] * np.uint64(seed[0]) % (m + np.uint64(1)) + last[2] * np.uint64(seed[1]) % (m + np.uint64(1))
    return int(s1) & MASK, int(s2) & MASK
