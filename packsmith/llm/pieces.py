"""SentencePiece encoding and decoding by suffix-array matching.

Distinct words of a batch are concatenated and indexed by a suffix array, as deep as the longest piece. A binary search of every
piece in the array gives the range of its occurrences; these are the edges (start, length, piece), which are sorted by position.
The model in use is a byte-pair model, whose right segmentation is not the one of the highest total score: it joins, again and
again, the two neighbours whose joint piece has the best score, leftmost first. So the relaxation over the sorted edges takes
each word's best edge that spans two neighbouring symbols until no such edge is left; all words of a batch do their next
step at once. The result equals the sentencepiece library's. Long stretches without a border are relaxed with a heap, for which
n symbols take n log n steps.

Words can be taken apart since no piece of the model has a space after another character, and characters that are in no piece
stand alone. Texts take a leading space, spaces become U+2581, and nothing else is normalised; characters that are no piece are
spelled as bytes. The library is used only to read the vocabulary.

Edge cases: a null or empty text has no ids and decodes to empty text; U+2581 itself decodes to a space, as in the library (the
row's exact is false); repeated rows are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsmith.llm.arrays import U64, bounded, per_row, ragged, row_sums, text_bytes
from packsmith.llm.wordcache import WordCache

PIECE_BYTES = 2 << 20
#: Bytes of distinct words in one suffix array, about, and the size from which a word is relaxed with a heap.
ARRAY_BYTES, LONG_WORD = 1 << 19, 200
BORDER, SPACE, NONE = 0xFF, 0x20, np.int64(1 << 30)
DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, exact boolean"

_models: dict[str, "Model"] = {}


class Model:
    """The vocabulary of a byte-pair SentencePiece model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=path)
        size = read.get_piece_size()
        self.bytes_of, self.byte_ids = [b""] * size, np.full(256, read.unk_id(), np.int64)
        pieces = []
        for i in range(size):
            text = read.id_to_piece(i)
            if read.is_byte(i):
                value = int(text[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (read.is_control(i) or read.is_unknown(i)):
                self.bytes_of[i] = text.replace("▁", " ").encode()
                pieces.append((self.bytes_of[i], i, read.get_score(i)))
        if any(b" " in p.lstrip(b" ") for p, _, _ in pieces):
            raise ValueError("pieces with a space after another character are not supported")
        self.ids = np.array([i for _, i, _ in pieces], np.int64)
        self.rank = np.unique([-s for _, _, s in pieces], return_inverse=True)[1].astype(np.int64)
        self.lengths = np.array([len(p) for p, _, _ in pieces], np.int64)
        self.depth = int(self.lengths.max())
        self.shift = self.depth.bit_length()
        padded = np.zeros((len(pieces), -(-self.depth // 8) * 8), np.uint8)
        filled = np.full_like(padded, 0xFF)
        for k, (p, _, _) in enumerate(pieces):
            padded[k, : len(p)] = filled[k, : len(p)] = np.frombuffer(p, np.uint8)
        self.low, self.high = padded.view(">u8").astype(U64), filled.view(">u8").astype(U64)
        used = np.zeros(256, bool)
        used[np.frombuffer(b"".join(p for p, _, _ in pieces), np.uint8)] = True
        self.alone = ~used
        self.alone[0x80:] = False
        sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.spell_bytes, self.spell_counts, self.spell_first = np.frombuffer(b"".join(self.bytes_of), np.uint8), sizes, np.cumsum(sizes) - sizes
        self.cache = WordCache(self.encode_words)

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces in data: (start << shift) + length in ascending order, and the pieces."""
        order, keys = suffix_array(data, 8 * self.low.shape[1])
        first = keys[0][order]
        lo, hi = np.searchsorted(first, self.low[:, 0], side="left"), np.searchsorted(first, self.high[:, 0], side="right")
        for k in np.flatnonzero((self.lengths > 8) & (hi > lo)).tolist():
            for level in range(1, -(-int(self.lengths[k]) // 8)):
                own = keys[level][order[lo[k] : hi[k]]]
                lo[k], hi[k] = lo[k] + np.searchsorted(own, self.low[k, level], side="left"), lo[k] + np.searchsorted(own, self.high[k, level], side="right")
        n = np.maximum(hi - lo, 0)
        piece = np.repeat(np.arange(len(n)), n)
        at = (order[ragged(lo, n)].astype(np.int64) << self.shift) + self.lengths[piece]
        by_place = np.argsort(at)
        return at[by_place], piece[by_place]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        ids, counts, start = [], [], 0
        sizes = np.cumsum([len(w) + 1 for w in words])
        while start < len(words):
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + ARRAY_BYTES, side="right")))
            own, n = self._encode(words[start:stop])
            ids.append(own)
            counts.append(n)
            start = stop
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(bytes([BORDER]).join(words) + bytes([BORDER]), np.uint8)
        at, piece = self.edges(data)
        border = data == BORDER
        start = np.flatnonzero(((data & 0xC0) != 0x80) & ~border)
        ends = np.flatnonzero(((data & 0xC0) != 0x80) | border)
        length = ends[np.searchsorted(ends, start) + 1] - start
        word = np.searchsorted(np.flatnonzero(border), start)
        long = np.array([len(w) > LONG_WORD for w in words])
        done = [relaxed(start[~long[word]], length[~long[word]], word[~long[word]], self._ranks(at, piece))]
        for k in np.flatnonzero(long):
            own = word == k
            done.append(relaxed_with_heap(start[own], length[own], self._ranks(at, piece)))
        start, length = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(start)
        start, length = start[order], length[order]
        word = np.searchsorted(np.flatnonzero(border), start)
        found = self._find(at, (start << self.shift) + length)
        known = found >= 0
        # A symbol that is no piece is a single character, spelled byte by byte.
        n = np.where(known, 1, length)
        ids = self.byte_ids[data[ragged(start, n)]]
        ids[(np.cumsum(n) - n)[known]] = self.ids[piece[found[known]]]
        return ids.astype(np.int32), np.bincount(word, weights=n, minlength=len(words)).astype(np.int64)

    @staticmethod
    def _find(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(at, keys), len(at) - 1)
        return np.where(at[place] == keys, place, -1)

    def _ranks(self, at: np.ndarray, piece: np.ndarray):
        def ranks(start: np.ndarray, length: np.ndarray) -> np.ndarray:
            """How late the edge over a stretch is taken; NONE if there is none."""
            found = np.where(length <= self.depth, self._find(at, (start << self.shift) + np.minimum(length, self.depth)), -1)
            return np.where(found >= 0, self.rank[piece[found]] if len(piece) else NONE, NONE)

        return ranks

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all rows, how many each row has, and the texts as bytes with leading spaces, with their offsets."""
        if pc.any(pc.match_substring(column, "▁")).as_py():
            column = pc.replace_substring(column, "▁", " ")
        data, offsets = text_bytes(column)
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], SPACE)
        offsets = offsets + np.r_[0, np.cumsum(some)]
        space, alone = data == SPACE, self.alone[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        begins[offsets[:-1][some]] = True
        starts = np.flatnonzero(begins)
        ids, counts = self.cache.rows(data, starts, np.r_[starts[1:], len(data)] if len(starts) else starts, per_row(starts, offsets))
        return ids, counts, data, offsets

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of all rows as bytes with their leading spaces, and their offsets."""
        sizes = self.spell_counts[ids]
        return self.spell_bytes[ragged(self.spell_first[ids], sizes)], np.r_[0, np.cumsum(row_sums(sizes, counts))]


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The positions of data in the order of the depth bytes from each, and those bytes as numbers of eight bytes."""
    n, padded = len(data), np.concatenate([data, np.zeros(depth + 8, np.uint8)]).astype(U64)
    keys = []
    for level in range(0, depth, 8):
        key = np.zeros(n, U64)
        for k in range(level, level + 8):
            key = (key << U64(8)) | padded[k : k + n]
        keys.append(key)
    order = np.argsort(keys[0])
    # Only places whose first bytes are equal need the later ones.
    first = keys[0][order]
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    if len(tied):
        places = order[tied]
        order[tied] = places[np.lexsort([key[places] for key in keys[:0:-1]] + [first[tied]])]
    return order, keys


def relaxed(start: np.ndarray, length: np.ndarray, word: np.ndarray, ranks) -> tuple[np.ndarray, np.ndarray]:
    """Join neighbours until no edge spans two; every round takes the best edge of each word, the leftmost of equals."""
    out_start, out_length = [], []

    def pairs(left: np.ndarray) -> np.ndarray:
        inside = (left + 1 < len(word)) & (word[np.minimum(left + 1, len(word) - 1)] == word[left])
        found = np.full(len(left), NONE)
        left = left[inside]
        found[inside] = ranks(start[left], length[left] + length[left + 1])
        return found

    rank = pairs(np.arange(len(start)))
    while len(start):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(word)])
        best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), first)
        open_ = (best >> 32) < NONE
        rest = np.repeat(open_, size)
        out_start.append(start[~rest])
        out_length.append(length[~rest])
        left = best[open_] & 0xFFFFFFFF
        length[left] += length[left + 1]
        rest[left + 1] = False
        place = np.cumsum(rest) - 1
        start, length, word, rank = start[rest], length[rest], word[rest], rank[rest]
        left = place[left]
        rank[left] = pairs(left)
        before = left[left > 0] - 1
        rank[before] = pairs(before)
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_start, out_length))


def relaxed_with_heap(start: np.ndarray, length: np.ndarray, ranks) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long word."""
    n = len(start)
    length, after, before = length.copy(), list(range(1, n + 1)), list(range(-1, n - 1))
    first = ranks(start[:-1], length[:-1] + length[1:]) if n > 1 else np.zeros(0, np.int64)
    heap = [(int(r), k, int(length[k] + length[k + 1])) for k, r in enumerate(first) if r < NONE]
    heapq.heapify(heap)
    alive = np.ones(n, bool)

    def push(k: int) -> None:
        if k >= 0 and after[k] < n:
            size = length[k] + length[after[k]]
            r = ranks(start[k : k + 1], np.array([size]))[0]
            if r < NONE:
                heapq.heappush(heap, (int(r), k, int(size)))

    while heap:
        _, k, size = heapq.heappop(heap)
        if not alive[k] or after[k] >= n or length[k] + length[after[k]] != size:
            continue
        gone = after[k]
        length[k], alive[gone], after[k] = size, False, after[gone]
        if after[k] < n:
            before[after[k]] = k
        push(k)
        push(before[k])
    return start[alive], length[alive]


def model(path: str) -> Model:
    """This worker's model."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]



def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array), n_tokens, and decoded, the text that the ids give."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in bounded(batches, "text", PIECE_BYTES):
            ids, counts, _, _ = own.encode(batch.column("text"))
            back, at = own.decode(ids, counts)
            raw = back.tobytes()
            texts = [raw[a + 1 : b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(counts, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return docs.mapInArrow(rows, "doc_id bigint, ids array<int>, n_tokens bigint, decoded string")


def encoding_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), decoded_sha256, and whether decoding gives the text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in bounded(batches, "text", PIECE_BYTES):
            ids, counts, _, _ = own.encode(batch.column("text"))
            data, offsets = text_bytes(batch.column("text"))
            back, at = own.decode(ids, counts)
            raw, text, flat = back.tobytes(), data.tobytes(), ids.astype("<u4").tobytes()
            ends = np.cumsum(counts)
            decoded = [raw[a + 1 : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)], pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                    pa.array([d == text[a:b] for d, a, b in zip(decoded, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "exact"],
            )

    return docs.mapInArrow(rows, DIGEST_SCHEMA)
