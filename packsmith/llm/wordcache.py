"""A bounded per-worker memory of encoded words, looked up for whole batches.

Words are found by a hash and told apart by their bytes, which are kept besides the ids: a word gets another one's ids never, whatever
their hashes. Of words with one hash the first is remembered and the others are encoded each time. No words give no ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from packsmith.llm.arrays import equal_spans, grouped_spans, ragged, row_sums


def _grown(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """x with room for more entries behind the used ones."""
    return x if used + more <= len(x) else np.concatenate([x[:used], np.zeros(used // 2 + more, x.dtype)])


class WordCache:
    """Encodes the words of a batch: each distinct word once, and not again while it is remembered.

    encode takes distinct words as bytes and returns their ids one after the other, and how many each has. The hashes are kept in
    two sorted arrays, a large one and one of recent words that is merged into it from time to time. All is forgotten when there are
    more than `most` words or their bytes and ids take more than most_bytes.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, most_bytes: int = 64 << 20) -> None:
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.starts, self.counts, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32)
        self.places, self.sizes, self.bytes = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(8192, np.uint8)
        self.used = self.size = self.held = 0

    def _find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word, -1 where it isn't known; and whether its hash is taken."""
        slots, taken = np.full(len(hashes), -1, np.int32), np.zeros(len(hashes), bool)
        for known, own in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == hashes)
                taken[hit] = True
                slot = own[at[hit]]
                same = self.sizes[slot] == sizes[hit]
                hit, slot = hit[same], slot[same]
                same = equal_spans(data, starts[hit], self.bytes, self.places[slot], sizes[hit], spare=True)
                slots[hit[same]] = slot[same]
        return slots, taken

    def _add(self, hashes: np.ndarray, words: list[bytes], remembered: np.ndarray) -> np.ndarray:
        ids, counts = self.encode(words)
        slots, sizes = np.arange(self.size, self.size + len(words), dtype=np.int32), np.array([len(w) for w in words], np.int32)
        raw = np.frombuffer(b"".join(words), np.uint8)
        self.starts, self.counts, self.places, self.sizes = (_grown(x, self.size, len(words)) for x in (self.starts, self.counts, self.places, self.sizes))
        self.ids, self.bytes = _grown(self.ids, self.used, len(ids)), _grown(self.bytes, self.held, len(raw) + 8)
        self.ids[self.used : self.used + len(ids)] = ids
        self.bytes[self.held : self.held + len(raw)] = raw
        self.counts[slots], self.sizes[slots] = counts, sizes
        self.starts[slots], self.places[slots] = self.used + np.cumsum(counts) - counts, self.held + np.cumsum(sizes, dtype=np.int64) - sizes
        self.size, self.used, self.held = self.size + len(words), self.used + len(ids), self.held + len(raw)
        large, recent = self.tables
        recent = self._joined(recent, (hashes[remembered], slots[remembered]))
        if len(recent[0]) > max(1 << 15, len(large[0]) // 4):
            large, recent = self._joined(large, recent), (recent[0][:0], recent[1][:0])
        self.tables = [large, recent]
        return slots

    @staticmethod
    def _joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys)
        return keys[order], np.concatenate([a[1], b[1]])[order]

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each row has; n_words: words by row."""
        if self.size > self.most or 4 * self.used + self.held > self.most_bytes:
            self.clear()
        order, first, hashes = grouped_spans(data, starts, ends)
        heads = order[first]
        slots, taken = self._find(hashes, data, starts[heads], (ends - starts)[heads])
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw, at = data.tobytes(), heads[new]
            # Groups come in the order of their hashes, so those of one hash stand side by side.
            remembered = ~taken[new] & np.r_[True, hashes[new][1:] != hashes[new][:-1]]
            slots[new] = self._add(hashes[new], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], remembered)
        by_word = np.empty(len(order), np.int32)
        by_word[order] = np.repeat(slots, np.diff(np.r_[first, len(order)]))
        counts = self.counts[by_word].astype(np.int64)
        return self.ids[ragged(self.starts[by_word], counts)], row_sums(counts, n_words)
