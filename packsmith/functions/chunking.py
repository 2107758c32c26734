"""Content-defined chunks.

compat is the recurrence h = rotl(h, 5) ^ byte with a cut where the low bits of h are zero. As rotation and exclusive or are linear,
h over bytes s..i is rotl(R[i] ^ R[s-1], 5 i) with R[i] the exclusive or of rotl(byte[j], -5 j) up to i: one prefix scan per
item, and a cut is the first zero in a window. That state depends on every byte since the last cut, so chunks do not line up again
soon after an insertion. gear keeps a windowed hash of the last 32 bytes instead, and does.
"""

from __future__ import annotations

import numpy as np

MIN_CHUNK, AVG_CHUNK, MAX_CHUNK = 64 << 10, 256 << 10, 1 << 20
WINDOW = 32


def _rotl(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint32) & np.uint32(31)
    return (x << by) | (x >> ((np.uint32(32) - by) & np.uint32(31)))


def _gear_table() -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = _gear_table()


def boundaries(data: bytes, least: int = MIN_CHUNK, average: int = AVG_CHUNK, most: int = MAX_CHUNK, mode: str = "compat") -> list[int]:
    """The ends of the chunks of data; average must be a power of two."""
    if average & (average - 1) or not 0 < least <= most:
        raise ValueError("average must be a power of two, and least at most most")
    n = len(data)
    v, mask = np.frombuffer(data, np.uint8), np.uint32(average - 1)
    if mode == "compat":
        place = (np.arange(n, dtype=np.int64) * 5 % 32).astype(np.uint32)
        prefix = np.concatenate([np.zeros(1, np.uint32), np.bitwise_xor.accumulate(_rotl(v.astype(np.uint32), np.uint32(32) - place))]) if n else np.zeros(1, np.uint32)
    elif mode == "gear":
        state = np.zeros(n, np.uint32)
        for back in range(min(WINDOW, n)):
            state[back:] += GEAR[v[: n - back]] << np.uint32(back)
        zero = np.flatnonzero((state >> np.uint32(32 - int(average).bit_length() + 1)) == 0) if average > 1 else np.arange(n)
    else:
        raise ValueError(f"unknown chunking mode: {mode}")
    ends, start = [], 0
    while start < n:
        first, last = start + least - 1, min(start + most, n)
        cut = last
        if mode == "gear":
            at = int(np.searchsorted(zero, first))
            if at < len(zero) and zero[at] < last:
                cut = int(zero[at]) + 1
        else:
            step = max(4 * average, 1024)
            for a in range(first, last, step):
                b = min(a + step, last)
                hit = np.flatnonzero((_rotl(prefix[a + 1 : b + 1] ^ prefix[start], place[a:b]) & mask) == 0)
                if len(hit):
                    cut = a + int(hit[0]) + 1
                    break
        ends.append(cut)
        start = cut
    return ends
