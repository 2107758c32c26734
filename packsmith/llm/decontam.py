"""Benchmark decontamination with a positional inverted index.

The index is partitioned by document, as search engines do: every segment covers some whole documents and keeps, for each
term, the sorted positions at which it occurs. It is written to the shared folder once and holds every word of every
document, so further test sets need no second pass over the texts. A phrase is looked up by taking the list of its rarest
term, shifting it by the term's offset, and intersecting it with the shifted lists of the other terms, rarest first. For
proximity the lists of an item's terms are intersected, rarest first, within a reach of some words.

A term is the 128-bit BLAKE2b digest of a word, as two numbers: no two different words are known to share one, whereas the fast hash by
which words are grouped is only trusted after their bytes were compared.

The test set is the query side. It is read in blocks of a fixed number of words; one block is broadcast at a time, and its
size is thus bounded whatever the test set has. Documents never leave their segment, so a passage that a third of
all documents share costs no more than any other text of its length.

Edge cases: a null or empty text has no words, hence n_words = 0, no hits, and stays when documents are dropped; a null doc_id is
kept as null; repeated rows are reported row by row; an empty test set marks nothing; items that share an id are one item, and those
with a null id one with an empty name; other columns of the inputs are ignored, whatever their names, and kept by decontaminate.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsmith.llm.arrays import ALNUM, LOWER, U64, bounded, grouped_spans, pair_places, per_row, ragged, runs, text_bytes
from packsmith.llm.texts import text_key, without_texts
from packsmith.session import stored

# Schemas, but for the type of the ids: bigint, or binary where rows go by a key of their text.
INDEX_SCHEMA = "segment string, doc_ids array<{}>, n_words array<int>, terms binary, counts binary, postings binary"
PARTIAL_SCHEMA = "segment string, row int, doc_id {}, n_words bigint, hit_from array<int>, hit_to array<int>, items array<string>"
PROXIMITY_SCHEMA = "doc_id {}, item_id string, position bigint, width bigint"
RESULT_SCHEMA = "doc_id {}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
ID_TYPES = {"bigint": pa.int64(), "binary": pa.binary()}
WINDOW = 13
BLOCK_WORDS = 1_000_000
SEGMENT_BYTES = 4 << 20
#: Candidate positions that are intersected at once.
CHUNK = 1 << 20


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the rows as terms (see above) in ascending order, how often each occurs, the places of its words
    term by term, and the number of words of each row."""
    data, offsets = text_bytes(column)
    starts, ends = runs(data, offsets, ALNUM)
    data = LOWER[data]
    order, first, _ = grouped_spans(data, starts, ends)
    heads, raw, digest = order[first], data.tobytes(), hashlib.blake2b
    digests = b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)])
    terms = np.frombuffer(digests, ">u8").astype(U64).reshape(-1, 2)
    rank, counts = np.lexsort((terms[:, 1], terms[:, 0])), np.diff(np.r_[first, len(order)])
    return terms[rank], counts[rank], order[ragged(first[rank], counts[rank])], per_row(starts, offsets)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all words of the rows in order (see above), and the number of words of each row."""
    terms, counts, places, n_words = _terms(column)
    out = np.empty((len(places), 2), U64)
    out[places] = np.repeat(terms, counts, axis=0)
    return out, n_words


def _segments(batches: Iterator[pa.RecordBatch], id_type: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(ID_TYPES[id_type])), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary())])
    for batch in bounded(batches, "text", SEGMENT_BYTES):
        terms, counts, places, n_words = _terms(batch.column("text"))
        first = np.cumsum(counts) - counts
        gaps = np.diff(places, prepend=0)
        gaps[first] = places[first]
        row = [uuid.uuid4().hex, batch.column("doc_id").to_pylist(), n_words.tolist(), terms.tobytes(), counts.astype(np.uint32).tobytes(), gaps.astype(np.uint32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """The positional index of all words of docs, stored in the shared folder."""
    docs = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).alias("text"))
    return stored(docs.mapInArrow(lambda batches: _segments(batches, id_type), INDEX_SCHEMA.format(id_type)), "postings")


class Segment:
    """One row of the index, decoded for queries."""

    def __init__(self, terms: bytes, counts: bytes, postings: bytes, n_words: np.ndarray) -> None:
        self.terms, self.counts = np.frombuffer(terms, U64).reshape(-1, 2), np.frombuffer(counts, np.uint32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        gaps = np.frombuffer(postings, np.uint32).astype(np.int64)
        sums = np.cumsum(gaps)
        base = np.zeros(len(self.terms), np.int64)
        if len(base):
            base[1:] = sums[self.first[1:] - 1]
        self.positions = sums - np.repeat(base, self.counts)
        self.n = len(gaps)
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * max(1, self.n) + self.positions
        self.row_ends = np.cumsum(n_words)

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in this segment, -1 if it has none."""
        return pair_places(self.terms[:, 0], self.terms[:, 1], terms[:, 0], terms[:, 1])

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        keys = term * max(1, self.n) + position
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys) & (position >= 0) & (position < self.n)

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.row_ends, position, side="right")

    def phrases(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of phrases of one length, given as rows of term places: (phrase, first position), inside one document."""
        width = places.shape[1]
        able = np.flatnonzero((places >= 0).all(axis=1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(able):
            rarity = np.argsort(self.counts[places[able]], axis=1, kind="stable")
            load = np.cumsum(self.counts[places[able, rarity[:, 0]]])
            start = 0
            while start < len(able):
                stop = max(start + 1, int(np.searchsorted(load, (load[start - 1] if start else 0) + CHUNK, side="right")))
                own, order = able[start:stop], rarity[start:stop]
                rare = places[own, order[:, 0]]
                which = np.repeat(np.arange(len(own)), self.counts[rare])
                begin = self.positions[ragged(self.first[rare], self.counts[rare])] - order[which, 0]
                for k in range(1, width):
                    offset = order[which, k]
                    keep = self.has(places[own[which], offset], begin + offset)
                    which, begin = which[keep], begin[keep]
                keep = (begin >= 0) & (begin + width <= self.n)
                which, begin = which[keep], begin[keep]
                keep = self.row_of(begin) == self.row_of(begin + width - 1)
                found.append((own[which[keep]], begin[keep]))
                start = stop
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def stretches(self, places: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last position of the shortest stretches of at most reach words, inside one document, that begin with one of
        the terms and have all of them; places: those of distinct terms."""
        none = np.zeros(0, np.int64)
        if not len(places) or (places < 0).any():
            return none, none
        lists = [self.positions[self.first[p] : self.first[p] + self.counts[p]] for p in places[np.argsort(self.counts[places], kind="stable")]]
        begin = np.sort(np.concatenate(lists))
        end = begin
        for own in lists:  # the rarest term leaves the fewest beginnings
            at = np.searchsorted(own, begin)
            keep = at < len(own)
            begin, end, found = begin[keep], end[keep], own[at[keep]]
            keep = found < begin + reach
            begin, end = begin[keep], np.maximum(end[keep], found[keep])
        keep = self.row_of(begin) == self.row_of(end)
        return begin[keep], end[keep]


def query_blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[dict]:
    """The test set in blocks: distinct windows as rows of term hashes by length, and the items that have each."""
    rows, size = [], 0
    chosen = items.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in chosen.toLocalIterator():
        own, _ = words(pa.array([text]))
        for start in range(0, max(1, len(own) - window + 1), block_words):
            part = own[start : start + block_words + window - 1]
            if len(part):
                rows.append((item, part))
                size += len(part)
        if size >= block_words:
            yield _block(rows, window)
            rows, size = [], 0
    if rows:
        yield _block(rows, window)


def _block(rows: list[tuple[str | None, np.ndarray]], window: int) -> dict:
    by_width: dict[int, list] = {}
    for item, own in rows:
        width = min(window, len(own))
        by_width.setdefault(width, []).append((item, own))
    out = {}
    for width, parts in by_width.items():
        terms, own = np.unique(np.concatenate([w for _, w in parts]), axis=0, return_inverse=True)
        sizes = np.array([len(w) for _, w in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        grams = np.lib.stride_tricks.sliding_window_view(own.ravel(), width)
        inside = owner[: len(grams)] == owner[width - 1 :]
        grams, back = np.unique(grams[inside], axis=0, return_inverse=True)
        pairs = np.unique(np.stack([back.ravel(), owner[: len(inside)][inside]], axis=1), axis=0)
        names = [item or "" for item, _ in parts]
        out[width] = (terms, grams, np.searchsorted(pairs[:, 0], np.arange(pairs[-1, 0] + 2)), pairs[:, 1], names)
    return out


def _matches(segment: Segment, block: dict) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Covered positions as a difference array summed to flags, and the items of each document."""
    cover, items = np.zeros(segment.n + 1, np.int64), [set() for _ in range(len(segment.row_ends))]
    for width, (terms, grams, first, owners, names) in block.items():
        places = segment.lookup(terms)
        able = np.flatnonzero((places >= 0)[grams].all(axis=1))
        which, begin = segment.phrases(places[grams[able]])
        which = able[which]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + width, -1)
        for row, gram in np.unique(np.stack([segment.row_of(begin), which], axis=1), axis=0):
            items[row].update(names[k] for k in owners[first[gram] : first[gram + 1]])
    flags = np.cumsum(cover[:-1]) > 0
    return flags, segment.row_ends, items


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _result(id_type: str, doc_ids: list, n_words: list, n_hit: list, items: list[set[str]]) -> pa.RecordBatch:
    columns = [pa.array(doc_ids, ID_TYPES[id_type]), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items]), pa.array([h > 0 and 20 * h >= w for h, w in zip(n_hit, n_words, strict=True)], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, np.ndarray, Segment]]:
    for batch in batches:
        for row in range(batch.num_rows):
            get = {name: batch.column(name)[row] for name in batch.schema.names}
            n_words = np.array(get["n_words"].values.to_numpy(zero_copy_only=False), np.int64)
            yield get["segment"].as_py(), get["doc_ids"].as_py(), n_words, Segment(get["terms"].as_py(), get["counts"].as_py(), get["postings"].as_py(), n_words)


def _hits(flags: np.ndarray, row_ends: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags)]
    return np.diff(sums[np.r_[0, row_ends]])


def contamination(index: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: words, words inside an occurrence of a window of items, the items and whether a twentieth is hit."""
    spark, id_type = index.sparkSession, index.schema["doc_ids"].dataType.elementType.simpleString()
    blocks = query_blocks(items, window, block_words)
    first, second = next(blocks, {}), next(blocks, None)
    if second is None:
        held = spark.sparkContext.broadcast(first)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, doc_ids, n_words, segment in _segment_rows(batches):
                flags, row_ends, found = _matches(segment, held.value)
                yield _result(id_type, doc_ids, n_words.tolist(), _hits(flags, row_ends).tolist(), found)

        return index.mapInArrow(whole, RESULT_SCHEMA.format(id_type))
    partials = []
    for block in [first, second]:
        partials.append(_partial(spark, index, block, id_type))
    for block in blocks:
        partials.append(_partial(spark, index, block, id_type))
    parts = partials[0]
    for p in partials[1:]:
        parts = parts.unionByName(p)
    merged = parts.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit_from")).alias("hit_from"), F.flatten(F.collect_list("hit_to")).alias("hit_to"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return merged.mapInArrow(lambda batches: _merge(batches, id_type), RESULT_SCHEMA.format(id_type))


def proximity(index: DataFrame, items: DataFrame, reach: int, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, position, width): for each document and item the shortest stretch, of at most reach words, that has every
    word of the item in any order; the first one of equals. position counts the document's words from 0.

    Items are read in blocks as for phrases. An item without words matches nothing; a null item_id is kept; rows of documents with one id
    are reported each.
    """
    spark, id_type = index.sparkSession, index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = PROXIMITY_SCHEMA.format(id_type)

    def part(block: list[tuple[str | None, np.ndarray]]) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, doc_ids, _, segment in _segment_rows(batches):
                found = []
                for item, terms in held.value:
                    begin, end = segment.stretches(segment.lookup(terms), reach)
                    row, width = segment.row_of(begin), end - begin + 1
                    best = np.lexsort((begin, width, row))
                    best = best[np.flatnonzero(np.r_[True, np.diff(row[best]) > 0][: len(best)])]
                    base = np.r_[0, segment.row_ends][row[best]]
                    found += [(doc_ids[r], item, p, w) for r, p, w in zip(row[best].tolist(), (begin[best] - base).tolist(), width[best].tolist(), strict=True)]
                types = ID_TYPES[id_type], pa.string(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(types)], names=["doc_id", "item_id", "position", "width"])

        out = stored(index.mapInArrow(rows, schema), "near")
        held.destroy()
        return out

    parts, block, size = [], [], 0
    for item, text in items.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        terms = np.unique(words(pa.array([text]))[0], axis=0)
        if len(terms):
            block.append((item, terms))
            size += len(terms)
        if size >= block_words:
            parts.append(part(block))
            block, size = [], 0
    if block or not parts:
        parts.append(part(block))
    return reduce(DataFrame.unionByName, parts)


def _partial(spark: SparkSession, index: DataFrame, block: dict, id_type: str) -> DataFrame:
    """One block's hits, stored, so that its broadcast can go before the next block comes."""
    held = spark.sparkContext.broadcast(block)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, doc_ids, n_words, segment in _segment_rows(batches):
            flags, row_ends, found = _matches(segment, held.value)
            spans = []
            for row, end in enumerate(row_ends):
                own = np.diff(np.r_[0, flags[end - n_words[row] : end].astype(np.int8), 0])
                spans.append((np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(doc_ids)), pa.array(range(len(doc_ids)), pa.int32()), pa.array(doc_ids, ID_TYPES[id_type]), pa.array(n_words, pa.int64()), pa.array([a for a, _ in spans], pa.list_(pa.int32())), pa.array([b for _, b in spans], pa.list_(pa.int32())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                names=["segment", "row", "doc_id", "n_words", "hit_from", "hit_to", "items"],
            )

    out = stored(index.mapInArrow(part, PARTIAL_SCHEMA.format(id_type)), "hits")
    held.destroy()
    return out


def _merge(batches: Iterator[pa.RecordBatch], id_type: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = []
        for n, begin, end in zip(*(batch.column(x).to_pylist() for x in ("n_words", "hit_from", "hit_to")), strict=True):
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, np.array(begin, np.int64), 1)
            np.add.at(cover, np.array(end, np.int64), -1)
            hits.append(int((np.cumsum(cover)[:n] > 0).sum()))
        yield _result(id_type, batch.column("doc_id").to_pylist(), batch.column("n_words").to_pylist(), hits, [set(x) for x in batch.column("items").to_pylist()])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of items occurs: one occurrence is a leak, however long the document is.

    This depends on the text alone, so rows go by their text's key, whatever ids they have, null and repeated ones too.
    """
    keyed = docs.select(text_key().alias("doc_id"), "text")
    found = contamination(build_index(keyed, id_type="binary"), items).where("n_hit > 0").select("doc_id")
    return without_texts(docs, stored(found.distinct(), "leaks"))
