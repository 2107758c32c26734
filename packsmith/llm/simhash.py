"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits meet at a variant in the middle. Every fingerprint emits all its
variants at distance 0 and 1; these find all pairs at distance 1 and 2. A pair at distance 3 has one fingerprint of even and
one of odd parity, and of its three bits two lie in the same half of the word: so it is enough that even fingerprints also emit
the variants at distance 2 whose two bits share a half. A shared variant with a member at distance 1 or less proves that this
member is within three bits of all others there, so each variant gives a star of links instead of all pairs.

Equal fingerprints are merged first, so groups of copies count once, and a variant has at most some two thousand members,
whatever the input. Variants are shuffled as sorted, difference-coded blocks by hash bucket, and each bucket is reduced to a
spanning forest before the components are formed.

Edge cases: null and empty texts have no words, and their fingerprint is zero and linked like any other; a null doc_id never is
the smallest unless all of its component are null; repeated rows are reported row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsmith.llm.arrays import LOWER, NONSPACE, U64, bounded, per_row, runs, text_bytes
from packsmith.llm.components import connected_components, forest
from packsmith.llm.texts import row_key, unused
from packsmith.session import stored

SHINGLE = 3
SEED = 42
PIECE_BYTES = 4 << 20
FINGERPRINTS_AT_ONCE = 4096
#: Variants in a hash bucket, and those that one task emits, about.
BUCKET_VARIANTS, TASK_VARIANTS = 1 << 21, 1 << 25
#: Buckets that one task reduces, one at a time, and links that it holds before it passes them on.
TASK_BUCKETS, TASK_LINKS = 64, 1 << 20
#: Keys up to this number are broadcast: some 40 bytes each.
BROADCAST_ROWS = 1_000_000
SPREAD = U64(0x9E3779B97F4A7C15)
GATHER = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BITS = [1 << k for k in range(64)]
NEAR = np.array([0, *_BITS], U64)
FAR = np.array([_BITS[i] | _BITS[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)], U64)
MASKS = np.concatenate([NEAR, FAR])


def fingerprints(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The SimHash of each row: a bit is 1 if more than half of the shingles' hashes have it."""
    data, offsets = text_bytes(column)
    starts, ends = runs(data, offsets, NONSPACE)
    n_words = per_row(starts, offsets)
    lens = ends - starts
    at = np.cumsum(lens + 1) - (lens + 1)
    joined = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[at + lens] = False
    joined[inside] = LOWER[data[NONSPACE[data]]]
    n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    first_word = np.cumsum(n_words) - n_words
    row = np.repeat(np.arange(len(n)), n)
    begin = first_word[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    last = begin + np.minimum(size, n_words[row]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(at[begin].tolist(), (at[last] + lens[last]).tolist(), strict=True) if len(begin) else ()
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in spans), U64, len(row))
    out = np.zeros(len(n), U64)
    own = np.flatnonzero(n)
    if len(own):
        count = n[own].astype(U64)
        width = 16 if count.max() < 1 << 16 else 32
        lanes = U64(sum(1 << (width * k) for k in range(64 // width)))
        first = (np.cumsum(n) - n)[own]
        for bit in range(width):
            sums = np.add.reduceat((hashes >> U64(bit)) & lanes, first)
            for lane in range(64 // width):
                ones = (sums >> U64(width * lane)) & U64((1 << width) - 1)
                out[own] |= (ones * U64(2) > count).astype(U64) << U64(bit + width * lane)
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, fp), stored; with keyed also key, which tells apart the rows that share an id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", PIECE_BYTES):
            own = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(fingerprints(batch.column("text")).view(np.int64))], names=[*own, "fp"])

    key = [row_key(id_col, text_col).alias("key")] if keyed else []
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *key, F.col(text_col).alias("text"))
    return stored(docs.mapInArrow(rows, f"doc_id bigint, {'key binary, ' if keyed else ''}fp bigint"), "fingerprints")


def _ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All emitted variants, spread over the range of hashes and sorted, and the number of each one's mask."""
    even = np.bitwise_count(fps) % 2 == 0
    variants = np.concatenate([(fps[:, None] ^ NEAR).ravel(), (fps[even][:, None] ^ FAR).ravel()])
    codes = np.concatenate([np.tile(np.arange(len(NEAR), dtype=np.uint16), len(fps)), np.tile(np.arange(len(NEAR), len(MASKS), dtype=np.uint16), int(even.sum()))])
    keys = variants * SPREAD
    order = np.argsort(keys)
    return keys[order], codes[order]


def _lists(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive stretches of bytes, up to each of the ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _emit(bits: int):
    """Variants as blocks by hash bucket, the leading bits of the spread variant: its differences, in the bytes that the largest needs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = U64((1 << (64 - bits)) - 1)
        for batch in batches:
            for start in range(0, batch.num_rows, FINGERPRINTS_AT_ONCE):
                keys, codes = _ball(batch.column("fp")[start : start + FINGERPRINTS_AT_ONCE].to_numpy(zero_copy_only=False).view(U64))
                bucket = keys >> U64(64 - bits)
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends, gaps = np.r_[first[1:], len(keys)], np.diff(keys, prepend=U64(0))
                gaps[first] = keys[first] & low
                width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
                packed = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
                columns = [pa.array(bucket[first].astype(np.int64)), pa.array(np.full(len(first), width, np.int32)), _lists(packed, ends * width), _lists(codes, 2 * ends)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "width", "gaps", "codes"])

    return emit


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a column, and the size of each."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], np.diff(at)


def _decoded(block: pa.RecordBatch, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The variants and mask numbers of rows of one bucket and one width."""
    width = block.column("width")[0].as_py()
    packed, sizes = _values(block.column("gaps"))
    wide = np.zeros((len(packed) // width, 8), np.uint8)
    wide[:, :width] = packed.reshape(-1, width)
    sums, n = np.cumsum(wide.view("<u8").ravel()), sizes // width
    before = np.r_[U64(0), sums][np.cumsum(n) - n]
    codes, _ = _values(block.column("codes"))
    return sums - np.repeat(before, n) + (U64(bucket) << U64(64 - bits)), codes.view(np.uint16)


def _stars(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a bucket: each shared variant gives a star around a member that is within one bit of it."""
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    own = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    keys, codes = keys[own], codes[order[own]]
    fps = (keys * GATHER) ^ MASKS[codes]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    if not len(first):
        return np.zeros(0, U64), np.zeros(0, U64)
    near = codes < len(NEAR)
    some = np.repeat(np.logical_or.reduceat(near, first), np.diff(np.r_[first, len(keys)]))
    keys, fps, near = keys[some], fps[some], near[some]
    order = np.lexsort((fps, ~near, keys))
    keys, fps = keys[order], fps[order]
    heads = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    hub = fps[np.flatnonzero(heads)][np.cumsum(heads) - 1]
    true = (hub != fps) & (np.bitwise_count(hub ^ fps) <= 3)
    return hub[true], fps[true]


def _links(bits: int, task_links: int = TASK_LINKS):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, found = None, [], (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def closed() -> tuple[np.ndarray, np.ndarray]:
            a, b = _stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return forest(np.concatenate([found[0], a.view(np.int64)]), np.concatenate([found[1], b.view(np.int64)]))

        for batch in batches:
            buckets, widths = batch.column("bucket").to_numpy(), batch.column("width").to_numpy()
            cut = np.flatnonzero((np.diff(buckets) != 0) | (np.diff(widths) != 0)) + 1
            for start, stop in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if stop == start:
                    continue
                if (own := int(buckets[start])) != bucket and parts:
                    found, parts = closed(), []
                    if len(found[0]) >= task_links:  # a task's forest stays bounded; the rest is done by the components
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])
                        found = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                bucket = own
                parts.append(_decoded(batch.slice(start, stop - start), own, bits))
        if parts:
            found = closed()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return links


def link_forest(fps: DataFrame, bucket_variants: int = BUCKET_VARIANTS, task_links: int = TASK_LINKS) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) with the same components as all links within three bits.

    Buckets and tasks follow from the number of fingerprints, so that a bucket has about bucket_variants at any size.
    """
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    expected = fps.count() * (len(NEAR) + len(FAR) / 2)
    bits = max(4, int(np.ceil(np.log2(max(parts, expected / bucket_variants)))))
    parts = max(parts, (1 << bits) // TASK_BUCKETS)
    # Few bytes of fingerprints become many of variants, so they are first dealt to enough tasks.
    tasks = max(parts, int(expected // TASK_VARIANTS) + 1)
    blocks = fps.select("fp").repartition(tasks).mapInArrow(_emit(bits), "bucket bigint, width int, gaps binary, codes binary")
    dealt = blocks.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(_links(bits, task_links), "a bigint, b bigint").where("a <> b")


def near_duplicates(table: DataFrame) -> DataFrame:
    """(doc_id, fp and maybe key) -> the same with component_id, the smallest doc_id of all fingerprints reachable over links, and,
    where there are keys, first_key, that of the component's first row: by id, nulls last, then by key."""
    keyed = "key" in table.columns
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *(["key"] if keyed else [])))
    reps = stored(table.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = connected_components(stored(link_forest(reps), "links"))
    # Only linked fingerprints need a second look; all others are their own component.
    rooted = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    chosen = [F.col("first.doc_id").alias("component_id"), *([F.col("first.key").alias("first_key")] if keyed else [])]
    classes = rooted.select(F.col("fp").alias("class_fp"), "root").join(least, "root").select("class_fp", *chosen)
    return table.join(classes, table["fp"] == classes["class_fp"], "left").drop("class_fp")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint as 16 hex digits, component_id."""
    found = near_duplicates(fingerprint_table(docs))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """The documents, but of each component only the one with the smallest id; of rows with that id and one text, one.

    It is decided on keys of rows, and texts are filtered by the keys that go. These are broadcast while they are counted to be at
    most `most`, so that no text moves; beyond that the texts are joined once. Only rows that a kept one repeats exactly, in id
    and text, are dealt by key.
    """
    found = stored(near_duplicates(fingerprint_table(docs, id_col, text_col, keyed=True)).select("key", "first_key"), "keys")
    own, key = unused(docs, "__own"), unused(docs, "__key")
    gone = found.where("key <> first_key").select(F.col("key").alias(own)).distinct()
    repeated = stored(found.where("key = first_key").groupBy("key").count().where("count > 1").select(F.col("key").alias(own)), "repeated")

    def side(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys

    docs, columns = docs.withColumn(key, row_key(id_col, text_col)), docs.columns
    if not repeated.limit(1).count():
        return docs.join(side(stored(gone, "gone")), F.col(key) == F.col(own), "left_anti").select(*columns)
    once = docs.join(side(stored(gone.unionByName(repeated), "gone")), F.col(key) == F.col(own), "left_anti")
    again = docs.join(side(repeated), F.col(key) == F.col(own), "left_semi").dropDuplicates([key])
    return once.unionByName(again).select(*columns)
