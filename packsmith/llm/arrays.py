"""Vectorised helpers over the text buffers of Arrow batches.

Words are found on UTF-8 bytes: the word classes used here treat every byte of a non-ASCII character alike,
so byte positions decide and no text is decoded.

Edge cases: a null text counts as an empty one; empty columns, and texts without a word, give empty arrays; a text of any length is one
row, whatever the sizes that batches are cut to.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Places whose powers are kept.
BLOCK = 1 << 16
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, ASCII letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: All but space and the ASCII controls from tab to carriage return.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most limit bytes in the text column; one row may exceed it alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    _give_back()


@cache
def _allocator():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def _give_back() -> None:
    """Return freed memory to the system at the end of a task: a worker lives on and may next serve another operator."""
    _allocator()(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and the n + 1 offsets of the rows in them; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of a class; none crosses a row's border."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = inside[data]
    begins, stops = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    stops[:-1] &= ~mask[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    begins[borders] = mask[borders]
    stops[borders - 1] = mask[borders - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of base modulo 2**64."""
    out = np.ones(n, U64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * U64(pow(base, k, 1 << 64))
        k *= 2
    return out


@cache
def _first_powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse within a block of places; those of whole blocks are few and made as needed."""
    return _powers(int(BASE), BLOCK), _powers(int(BASE_INVERSE), BLOCK)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = (h ^ (h >> U64(30))) * MIX_A
    h = (h ^ (h >> U64(27))) * MIX_B
    return h ^ (h >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of prefix sums, so that overlapping spans cost nothing more.

    Different spans with equal hashes can be made on purpose, so equal hashes only propose equal spans: see grouped_spans.
    """
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _first_powers()
    blocks = len(data) // BLOCK + 1
    sums = np.zeros(len(data) + 1, U64)
    weighted = sums[1:]
    np.add(data, U64(1), out=weighted)
    for k, power in enumerate(_powers(pow(int(BASE), BLOCK, 1 << 64), blocks)):
        own = weighted[k * BLOCK : (k + 1) * BLOCK]
        own *= up[: len(own)]
        own *= power
    np.cumsum(weighted, out=weighted)
    back = down[starts % BLOCK] * _powers(pow(int(BASE_INVERSE), BLOCK, 1 << 64), blocks)[starts // BLOCK]
    return mixed((sums[ends] - sums[starts]) * back + (ends - starts).astype(U64))


#: Masks of the first 0 to 8 of eight bytes, little-endian.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Spans are compared by steps of eight bytes up to this length, and beyond it one by one.
_STEPPED = 64


def _windows(data: np.ndarray, spare: bool = False) -> np.ndarray:
    """The eight bytes from each place of data, as numbers; spare: data has eight more bytes than are used."""
    padded = data if spare else np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray, spare: bool = False) -> np.ndarray:
    """Whether the span of each size in a is the one in b, byte by byte; spare: b has eight more bytes than are used."""
    out = np.ones(len(sizes), bool)
    left = _windows(a)
    right = left if b is a else _windows(b, spare)
    open_ = np.flatnonzero(sizes)
    for at in range(0, _STEPPED, 8):
        if not len(open_):
            return out
        mask = _FIRST[np.minimum(sizes[open_] - at, 8)]
        same = ((left[a_starts[open_] + at] ^ right[b_starts[open_] + at]) & mask) == 0
        out[open_[~same]] = False
        open_ = open_[same & (sizes[open_] > at + 8)]
    for k in open_.tolist():
        out[k] = a[a_starts[k] : a_starts[k] + sizes[k]].tobytes() == b[b_starts[k] : b_starts[k] + sizes[k]].tobytes()
    return out


def grouped_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans in groups of equal bytes: their places group by group, ascending in each; where each group begins; and its hash."""
    hashes = span_hashes(data, starts, ends)
    order, sizes = np.argsort(hashes, kind="stable"), ends - starts
    ranked = hashes[order]
    begins = np.r_[True, ranked[1:] != ranked[:-1]][: len(order)]
    first = np.flatnonzero(begins)
    if not len(first):
        return order, first, ranked
    head = np.repeat(order[first], np.diff(np.r_[first, len(order)]))
    same = sizes[order] == sizes[head]
    own = np.flatnonzero(same & (head != order))
    same[own] = equal_spans(data, starts[order[own]], data, starts[head[own]], sizes[order[own]])
    if not same.all():
        # Different spans of one hash: their group is put in the order of the bytes and cut where these change.
        for g in np.unique(np.searchsorted(first, np.flatnonzero(~same), side="right") - 1).tolist():
            a, b = first[g], first[g + 1] if g + 1 < len(first) else len(order)
            mixed_up = sorted((data[starts[k] : ends[k]].tobytes(), k) for k in order[a:b].tolist())
            order[a:b] = [k for _, k in mixed_up]
            begins[a + 1 : b] = [x[0] != y[0] for x, y in zip(mixed_up, mixed_up[1:])]
        first = np.flatnonzero(begins)
    return order, first, ranked[first]


def pair_places(high: np.ndarray, low: np.ndarray, wanted_high: np.ndarray, wanted_low: np.ndarray) -> np.ndarray:
    """The place of each wanted 128-bit number among sorted ones, given as halves; -1 if it isn't there."""
    out = np.full(len(wanted_high), -1)
    at, open_ = np.searchsorted(high, wanted_high), np.arange(len(wanted_high))
    while len(open_):
        inside = at < len(high)
        at, open_ = at[inside], open_[inside]
        equal = high[at] == wanted_high[open_]
        at, open_ = at[equal], open_[equal]
        hit = low[at] == wanted_low[open_]
        out[open_[hit]] = at[hit]
        at, open_ = at[~hit] + 1, open_[~hit]
    return out


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of values, of the given sizes; an empty group has 0."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every group, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted starts lie in each row."""
    return np.diff(np.searchsorted(starts, offsets, side="left"))
