"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard is a sequence of records in ascending doc_id order, and the shards are in order too. A record is

    u64 length of the payload | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload | line feed

and a payload is

    u8 flags (1: doc_id is null; 2: ids are 32 bits wide, else 16) | i64 doc_id | u32 number of ids | ids

all little-endian. The mask rotates a checksum by 15 bits and adds a constant, so that checksums of data which hold checksums
stay sound. The line feed is the record separator of Spark's text sink, which writes the shards with Spark's commit protocol to
any file system that Spark knows. The index has for each record its shard, offset, length, doc_id, number of ids and first
position in the whole sequence.

The number of shards follows from the bytes of text, and rows go to shards by bounds that approximate quantiles of doc_id give, rows
weighed by their size. An id that fills several shards alone is spread over them
by a hash of the text, which is also the order within equal ids.

Edge cases: a null or empty text gives the end id alone; a null doc_id comes first; other columns are ignored; an empty table
gives no records.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsmith.llm.arrays import LOWER, bounded, per_row, ragged, runs, text_bytes
from packsmith.llm.wordcache import WordCache
from packsmith.session import scratch, stored

END_ID = 1
#: Words that the library gets in one text.
JOINED = 128
#: Characters that the library gets in one call, about.
TEXTS_BYTES = 1 << 18
PIECE_BYTES = 1 << 20
#: Bytes of text for each shard, about; a shard is read as one value, which may have 2 GB.
SHARD_BYTES = 256 << 20
MASK = 0xA282EAD8
HEAD, FOOT, FIELDS = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BqI")
#: Bytes that part words: white space to any tokenizer that drops it.
SOLID = np.ones(256, bool)
SOLID[[0x09, 0x0A, 0x0D, 0x20]] = False
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes by which a word may hold a contraction or the name of a special token.
JOINING = np.zeros(256, bool)
JOINING[[0x27, 0x3C]] = True
INDEX_SCHEMA = "shard string, part int, record bigint, offset bigint, length bigint, doc_id bigint, n_tokens bigint, local_start bigint, ids_crc32 bigint"

_caches: dict[str, WordCache] = {}


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def _cache(path: str) -> WordCache:
    """This worker's cache for a tokenizer that drops white space and normalises within words."""
    if path not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        last = np.zeros(tokenizer.get_vocab_size(), bool)
        last[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

        def ids_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
            step = max(1, TEXTS_BYTES // max(map(len, texts), default=1))
            for k in range(0, len(texts), step):  # the library's results are large, so few live at once
                found = [x.ids for x in tokenizer.encode_batch_fast(texts[k : k + step], add_special_tokens=False)]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                parts.append((np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts))
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """Words of letters go to the library many at once; each has one id that ends a word."""
            texts = [w.decode() for w in words]
            letters = np.fromiter(map(str.isalpha, texts), bool, len(texts))
            own = [t for t, ok in zip(texts, letters.tolist(), strict=True) if ok]
            ids, _ = ids_of([" ".join(own[k : k + JOINED]) for k in range(0, len(own), JOINED)])
            ends = np.flatnonzero(last[ids])
            if len(ends) != len(own):  # some letters became more than one word
                return ids_of(texts)
            counts = np.zeros(len(texts), np.int64)
            counts[letters] = np.diff(ends, prepend=-1)
            others, counts[~letters] = ids_of([t for t, ok in zip(texts, letters.tolist(), strict=True) if not ok])
            out = np.empty(int(counts.sum()), np.int32)
            first = np.cumsum(counts) - counts
            out[ragged(first[letters], counts[letters])] = ids
            out[ragged(first[~letters], counts[~letters])] = others
            return out, counts

        _caches[path] = WordCache(encode)
    return _caches[path]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of text that the tokenizer takes one by one, in lower case where that changes nothing.

    White space parts them, and so does the border between an ASCII letter and another ASCII character, unless the word has
    an apostrophe or an opening bracket.
    """
    starts, ends = runs(data, offsets, SOLID)
    if not len(starts):
        return data, starts, ends
    joining = np.r_[0, np.cumsum(JOINING[data])]
    whole = joining[ends] > joining[starts]
    fixed = np.zeros(len(data) + 1, np.int8)
    fixed[starts[whole]] += 1
    fixed[ends[whole]] -= 1
    free = np.cumsum(fixed[:-1]) == 0
    letter, ascii_ = ASCII_LETTER[data], data < 0x80
    cut = np.flatnonzero((letter[1:] != letter[:-1]) & ascii_[1:] & ascii_[:-1] & SOLID[data[1:]] & SOLID[data[:-1]] & free[1:]) + 1
    cut = cut[~np.isin(cut, offsets, assume_unique=False)] if len(cut) else cut
    return np.where(free, LOWER[data], data), np.sort(np.concatenate([starts, cut]), kind="stable"), np.sort(np.concatenate([ends, cut]), kind="stable")


def encode_texts(column: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after the other, each row ended by end_id, and the number of ids of each row."""
    data, offsets = text_bytes(column)
    data, starts, ends = _words(data, offsets)
    ids, counts = _cache(path).rows(data, starts, ends, per_row(starts, offsets))
    row = np.repeat(np.arange(len(counts)), counts)
    out = np.full(len(ids) + len(counts), end_id, np.int32)
    out[np.arange(len(ids)) + row] = ids
    return out, counts + 1


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = FIELDS.pack((doc_id is None) + 2 * wide, doc_id or 0, len(ids) // (4 if wide else 2)) + ids
    length = struct.pack("<Q", len(payload))
    return length + FOOT.pack(masked(length)) + payload + FOOT.pack(masked(payload))


def records(shard: bytes | memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each record; ValueError where a checksum or a length is wrong."""
    at, end = 0, len(shard)
    while at < end:
        if end - at < HEAD.size:
            raise ValueError(f"cut record at {at}")
        size, check = HEAD.unpack_from(shard, at)
        if masked(shard[at : at + 8]) != check:
            raise ValueError(f"wrong length checksum at {at}")
        stop = at + HEAD.size + size + FOOT.size
        if stop > end or size < FIELDS.size:
            raise ValueError(f"cut record at {at}")
        payload = shard[at + HEAD.size : stop - FOOT.size]
        if masked(payload) != FOOT.unpack_from(shard, stop - FOOT.size)[0]:
            raise ValueError(f"wrong checksum at {at}")
        flags, doc_id, n = FIELDS.unpack_from(payload)
        ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=FIELDS.size)
        if len(ids) != n:
            raise ValueError(f"wrong number of ids at {at}")
        yield at, stop - at, None if flags & 1 else doc_id, ids
        at = stop + 1


def shard_of(ids: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The shard of each row; ids that are a bound several times are spread by the order of their ties."""
    low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    share = (ties.view(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) / 2.0**64
    return np.where(high > low + 1, low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low), high).astype(np.int32)


def shard_bounds(docs: DataFrame, shard_bytes: int) -> np.ndarray:
    """The ids that part docs (doc_id, text) into shards of about shard_bytes of text, and at least as many as shuffle partitions.

    A row weighs as many units as its text has, of the mean size, so that ids with long texts get shards of their own.
    """
    own = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")
    sizes = stored(docs.select(own, F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size")), "sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    if not n or shards == 1:
        return np.zeros(0, np.int64)
    units = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("size") / max(1, total // n)))
    quantiles = sizes.select("doc_id", F.explode(units)).approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.25 / shards)
    return np.clip(np.sort(np.array(quantiles, np.float64)), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def write_records(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode docs and write the shards to path."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tie"), F.col(text_col).alias("text"))
    bounds = shard_bounds(docs, shard_bytes)
    shards = len(bounds) + 1

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=1)
        for batch in bounded(batches, "text", PIECE_BYTES):
            ids, counts = encode_texts(batch.column("text"), tokenizer, end_id)
            wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
            raw, width = ids.astype("<u4" if wide else "<u2").tobytes(), 4 if wide else 2
            ends = np.cumsum(counts)
            packed = [small.compress(raw[width * a : width * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            own = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            shard = shard_of(own, batch.column("tie").to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("doc_id"), batch.column("tie"), pa.array([wide] * len(packed), pa.bool_()), pa.array(packed, pa.binary())], names=["shard", "doc_id", "tie", "wide", "ids"])

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        large = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "wide", "ids")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([frame(i, large.decompress(x), w) for i, w, x in rows], pa.binary())], names=["value"])

    rows = docs.mapInArrow(encoded, "shard int, doc_id bigint, tie bigint, wide boolean, ids binary")
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    dealt.mapInArrow(framed, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the shards, its checksums verified, with its place in its shard."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, shard in zip(batch.column("path"), batch.column("content"), strict=True):
                name = name.as_py().rsplit("/", 1)[-1]
                found, start = [], 0
                for k, (offset, length, doc_id, ids) in enumerate(records(memoryview(shard.as_buffer()))):
                    found.append((name, int(name.split("-")[1]), k, offset, length, doc_id, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                types = [pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 9, types, strict=True)], names=["shard", "part", "record", "offset", "length", "doc_id", "n_tokens", "local_start", "ids_crc32"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, INDEX_SCHEMA)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Write the offset index of the shards in path, and return it: with start, the ids of all documents before each."""
    own = f"{index_path}-parts"
    read_records(spark, path).write.parquet(own)
    parts = spark.read.schema(INDEX_SCHEMA).parquet(own)
    # One row for each shard: their number is a setting and does not grow with the rows.
    totals = parts.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, sums = [], 0
    for part, n in sorted(totals):
        before.append((part, sums))
        sums += n
    starts = F.broadcast(spark.createDataFrame(before, "part int, base bigint"))
    index = parts.join(starts, "part").withColumn("start", F.col("base") + F.col("local_start"))
    index = index.select("shard", "part", "record", "offset", "length", "doc_id", "n_tokens", "start", "ids_crc32")
    index.write.parquet(index_path)
    return spark.read.schema(index.schema).parquet(index_path)


def record_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs' ids, read them back, and return doc_id, start, n_tokens and ids_crc32 from the files."""
    spark = docs.sparkSession
    path = scratch(spark, "records")
    write_records(docs, path, tokenizer)
    return write_index(spark, path, scratch(spark, "offsets")).select("doc_id", "start", "n_tokens", "ids_crc32")
