"""Line dedup over levelled sorted runs of line hashes.

A run is a sorted sequence of 128-bit hashes of line keys with, for each, the number of documents that hold it and the largest
doc_id among them. Every batch of documents adds runs at level 0; when a level has FAN runs they are compacted into one run of
the next level, which sums the counts of equal hashes. Tasks keep such levels in memory and pass their runs on by hash bucket;
in the store (LineRuns) the same is done with tables in the shared folder, so that later batches cost no pass over earlier ones.
A batch is checked by a merge anti-join: its own sorted hashes against the runs.

The rule by which a line goes needs the count over all documents, so documents are read twice: once for the runs and once for
the decision. The hashes of frequent lines go to the second pass by broadcast while they are counted to be at most
BROADCAST_KEYS; beyond that hashes and keys of rows are joined on the hash, of which Spark splits hot keys, and each text meets the
hashes of its own lines in one join.

Edge cases: a null or empty text is one empty line; every row counts as a document; a null doc_id is smaller than any other;
keys shorter than min_chars are never dropped; if all lines go, the text is empty; other columns are kept or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsmith.llm.arrays import LOWER, NONSPACE, U64, bounded, pair_places, text_bytes
from packsmith.llm.texts import row_key, unused
from packsmith.session import remove, scratch, stored

MIN_CHARS, MIN_DOCS = 20, 3
FAN = 8
PIECE_BYTES = 4 << 20
#: Entries that a task holds before it passes its runs on.
TASK_ENTRIES = 1 << 21
BROADCAST_KEYS = 1 << 21
#: Bytes of input for each hash bucket, and the largest count that is kept.
BUCKET_BYTES, MOST_DOCS = 64 << 20, (1 << 32) - 1
NO_ID = -(1 << 63)
RUN_SCHEMA = "bucket int, hashes binary, n_docs binary, last_doc binary"

Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # high and low halves of the hash, documents, largest id
EMPTY: Run = (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))


class Lines:
    """The lines of a batch: where they and their keys begin and end, and the hashes of the keys that are long enough."""

    def __init__(self, column: pa.Array, min_chars: int = MIN_CHARS) -> None:
        self.data, self.offsets = text_bytes(column)
        data = self.data
        breaks = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        self.ends = np.sort(np.concatenate([breaks, self.offsets[1:]]), kind="stable")
        self.n_lines = np.diff(np.searchsorted(breaks, self.offsets)) + 1
        self.row = np.repeat(np.arange(len(self.n_lines)), self.n_lines)
        solid = np.flatnonzero(NONSPACE[data])
        first, last = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends) - 1
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        some = np.flatnonzero(first <= last)
        begin, end = solid[first[some]], solid[last[some]] + 1
        long = points[end] - points[begin] >= min_chars
        self.long = some[long]
        raw, digest = LOWER[data].tobytes(), xxhash.xxh3_128_digest
        hashes = b"".join([digest(raw[a:b]) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
        self.high, self.low = np.frombuffer(hashes, ">u8").astype(U64).reshape(-1, 2).T

    def run(self, ids: np.ndarray) -> Run:
        """The batch's own run."""
        row = self.row[self.long]
        order = np.lexsort((row, self.low, self.high))
        high, low, row = self.high[order], self.low[order], row[order]
        new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (row[1:] != row[:-1])][: len(row)]
        high, low, row = high[new], low[new], row[new]
        return summed(high, low, np.ones(len(row), np.int64), ids[row])

    def texts(self, drop: np.ndarray) -> list[bytes]:
        """Each row's lines but those to drop, joined by line feeds."""
        raw, out = self.data.tobytes(), []
        touched = np.zeros(len(self.n_lines), bool)
        touched[self.row[drop]] = True
        first = np.cumsum(self.n_lines) - self.n_lines
        for k, own in enumerate(touched.tolist()):
            if own:
                at = slice(first[k], first[k] + self.n_lines[k])
                out.append(b"\n".join([raw[a:b] for a, b, gone in zip(self.starts[at].tolist(), self.ends[at].tolist(), drop[at].tolist(), strict=True) if not gone]))
            else:
                out.append(raw[self.offsets[k] : self.offsets[k + 1]])
        return out


def summed(high: np.ndarray, low: np.ndarray, n_docs: np.ndarray, last: np.ndarray) -> Run:
    """One entry for each hash of sorted entries."""
    first = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])][: len(high)])
    if not len(first):
        return EMPTY
    return high[first], low[first], np.add.reduceat(n_docs, first), np.maximum.reduceat(last, first)


def compacted(parts: list[Run]) -> Run:
    """One run of several."""
    if len(parts) == 1:
        return parts[0]
    high, low, n_docs, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((low, high))
    return summed(high[order], low[order], n_docs[order], last[order])


class Levels:
    """Runs in memory by level."""

    def __init__(self) -> None:
        self.levels: list[list[Run]] = []

    def add(self, run: Run) -> None:
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FAN:
                return
            run, self.levels[level] = compacted(self.levels[level]), []
            level += 1

    def size(self) -> int:
        return sum(len(run[0]) for level in self.levels for run in level)

    def flush(self) -> Run:
        runs, self.levels = [run for level in self.levels for run in level], []
        return compacted(runs) if runs else EMPTY


def matches(run: Run, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The place of each hash in the run, -1 if it isn't there: the merge join of sorted hashes."""
    return pair_places(run[0], run[1], high, low)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _lists(data: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Rows of data, cut at the given places, as values of bytes."""
    size = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * size).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _pack(run: Run, buckets: int) -> pa.RecordBatch:
    """The run cut at the borders of the hash buckets. Counts are kept up to the largest of 32 bits, which is far above any bound."""
    bucket = ((run[0] >> U64(32)) * U64(buckets)) >> U64(32)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    cut = np.r_[first, len(bucket)]
    hashes, n_docs = np.stack([run[0], run[1]], axis=1), np.minimum(run[2], MOST_DOCS).astype(np.uint32)
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), _lists(hashes, cut), _lists(n_docs, cut), _lists(run[3], cut)], names=["bucket", "hashes", "n_docs", "last_doc"])


def _unpack(hashes: bytes, n_docs: bytes, last: bytes) -> Run:
    pairs = np.frombuffer(hashes, U64).reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), np.frombuffer(n_docs, np.uint32).astype(np.int64), np.frombuffer(last, np.int64)


def _task_runs(buckets: int, min_chars: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels()
        for batch in bounded(batches, "text", PIECE_BYTES):
            levels.add(Lines(batch.column("text"), min_chars).run(_ids(batch.column("doc_id"))))
            if levels.size() >= TASK_ENTRIES:
                yield _pack(levels.flush(), buckets)
        yield _pack(levels.flush(), buckets)

    return runs


def _bucket_runs(buckets: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, levels = None, Levels()
        for batch in batches:
            for own, *parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if own != bucket and bucket is not None:
                    yield _pack(levels.flush(), buckets)
                bucket = own
                levels.add(_unpack(*parts))
        yield _pack(levels.flush(), buckets)

    return runs


def read_bytes(df: DataFrame) -> int:
    """The bytes that Spark expects df to have, of its files or rows; at most what a 32-bit bucket number allows."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), BUCKET_BYTES << 30)


class LineRuns:
    """The store: for each level, tables of runs by hash bucket in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN, min_chars: int = MIN_CHARS) -> None:
        self.spark, self.fan, self.min_chars = spark, fan, min_chars
        self.buckets = buckets
        self.levels: list[list[str]] = []

    def _merged(self, runs: DataFrame) -> DataFrame:
        dealt = runs.repartition(min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(_bucket_runs(self.buckets), RUN_SCHEMA)

    def _write(self, runs: DataFrame) -> str:
        where = scratch(self.spark, "runs")
        self._merged(runs).write.option("compression", "zstd").parquet(where)
        return where

    def add(self, docs: DataFrame) -> None:
        """Add a batch (doc_id, text), and compact each level that is full."""
        # The first batch's size gives the number of buckets, so that one fits a worker's memory at any size.
        self.buckets = self.buckets or max(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-read_bytes(docs) // BUCKET_BYTES))
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        where = self._write(docs.mapInArrow(_task_runs(self.buckets, self.min_chars), RUN_SCHEMA))
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(where)
            if len(self.levels[level]) < self.fan:
                return
            full, self.levels[level] = self.levels[level], []
            where = self._write(self.spark.read.schema(RUN_SCHEMA).parquet(*full))
            for old in full:
                remove(self.spark, old)
            level += 1

    def runs(self) -> DataFrame:
        """All runs as one, bucket by bucket."""
        paths = [x for level in self.levels for x in level]
        found = self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)
        return found if len(paths) < 2 else self._merged(found)

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """The part of the runs with at least min_docs documents."""

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, *parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    run = _unpack(*parts)
                    often = run[2] >= min_docs
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.stack([run[0][often], run[1][often]], axis=1).tobytes()]), pa.array([run[2][often].astype(np.uint32).tobytes()]), pa.array([run[3][often].tobytes()])], names=["bucket", "hashes", "n_docs", "last_doc"])

        return self.runs().mapInArrow(keep, RUN_SCHEMA).where("length(hashes) > 0")

    def add_new(self, docs: DataFrame) -> DataFrame:
        """First-come dedup: the batch with all lines gone that earlier batches have; then the batch is added."""
        before = self.frequent(1) if any(self.levels) else None
        out = stored(drop_lines(docs, before, first_come=True), "batch") if before is not None else docs
        self.add(docs)
        return out


def _dropped(lines: Lines, ids: np.ndarray, run: Run, first_come: bool = False) -> np.ndarray:
    drop = np.zeros(len(lines.row), bool)
    at = matches(run, lines.high, lines.low)
    hit = np.flatnonzero(at >= 0)
    own = ids[lines.row[lines.long[hit]]]
    drop[lines.long[hit]] = True if first_come else own != run[3][at[hit]]
    return drop


def _local(lines: Lines, gone: pa.Array) -> np.ndarray:
    """The lines whose hash is in the row's own list of 16-byte hashes."""
    drop = np.zeros(len(lines.row), bool)
    counts = pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False)
    wanted = np.frombuffer(b"".join(gone.flatten().to_pylist()), ">u8").astype(U64).reshape(-1, 2)
    row = lines.row[lines.long]
    # Lines and listed hashes in one order: a stretch of equal (row, hash) goes if something listed is in it.
    rows = np.concatenate([row, np.repeat(np.arange(len(counts)), counts)])
    high, low = np.concatenate([lines.high, wanted[:, 0]]), np.concatenate([lines.low, wanted[:, 1]])
    order = np.lexsort((low, high, rows))
    rows, high, low = rows[order], high[order], low[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])][: len(rows)])
    if len(first):
        listed = np.logical_or.reduceat(order >= len(row), first)
        hit = order[np.repeat(listed, np.diff(np.r_[first, len(rows)]))]
        drop[lines.long[hit[hit < len(row)]]] = True
    return drop


def drop_lines(docs: DataFrame, frequent: DataFrame, digest: bool = False, first_come: bool = False, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs without the lines of frequent runs except in the largest doc_id; with digest, counts and a hash instead of texts.

    first_come: every line that is in the runs goes, as the runs are of earlier batches.
    """
    spark, n_keys = docs.sparkSession, int(frequent.agg(F.coalesce(F.sum(F.length("hashes")), F.lit(0))).first()[0]) // 16
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text") if digest else docs
    gone = unused(base, "__gone")
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string" if digest else docs.schema
    columns, held = docs.columns, None
    if n_keys <= broadcast_keys:
        parts = [_unpack(bytes(r.hashes), bytes(r.n_docs), bytes(r.last_doc)) for r in frequent.orderBy("bucket").collect()]
        held = spark.sparkContext.broadcast(compacted(parts) if parts else EMPTY)
    else:
        key, own = unused(base, "__key"), unused(base, "__own")
        base = base.withColumn(key, row_key()).join(_decisions(docs, frequent, min_chars, first_come).toDF(own, gone), F.col(key) == F.col(own), "left").drop(key, own)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", PIECE_BYTES):
            lines, ids = Lines(batch.column("text"), min_chars), _ids(batch.column("doc_id"))
            drop = _local(lines, batch.column(gone)) if held is None else _dropped(lines, ids, held.value, first_come)
            texts = lines.texts(drop)
            if digest:
                n_dropped = np.bincount(lines.row[drop], minlength=len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines.n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                kept = pa.array([t.decode() for t in texts], mask=batch.column("text").is_null().to_numpy(zero_copy_only=False))
                new = {"text": kept}
                if "n_chars" in columns:
                    new["n_chars"] = pc.utf8_length(kept).cast(batch.column("n_chars").type)
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], names=columns)

    return base.mapInArrow(rows, schema)


def _decisions(docs: DataFrame, frequent: DataFrame, min_chars: int, first_come: bool) -> DataFrame:
    """(key of a row, hashes of the lines that it loses), by a join on the hash. Hashes and keys of rows move, texts do not."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", PIECE_BYTES):
            lines, ids = Lines(batch.column("text"), min_chars), _ids(batch.column("doc_id"))
            row = lines.row[lines.long]
            order = np.lexsort((lines.low, lines.high, row))
            new = order[np.r_[True, (np.diff(row[order]) != 0) | (np.diff(lines.high[order]) != 0) | (np.diff(lines.low[order]) != 0)][: len(order)]]
            pairs = np.stack([lines.high[new], lines.low[new]], axis=1).astype(">u8")
            yield pa.RecordBatch.from_arrays([batch.column("row_key").take(pa.array(row[new])), pa.array(ids[row[new]]), _lists(pairs, np.arange(len(new) + 1))], names=["row_key", "own", "hash"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, last in zip(batch.column("hashes").to_pylist(), batch.column("last_doc").to_pylist(), strict=True):
                pairs = np.frombuffer(hashes, U64).reshape(-1, 2).astype(">u8")
                yield pa.RecordBatch.from_arrays([_lists(pairs, np.arange(len(pairs) + 1)), pa.array(np.frombuffer(last, np.int64))], names=["key", "last"])

    own = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(keys, "row_key binary, own bigint, hash binary")
    often = frequent.mapInArrow(entries, "key binary, last bigint")
    hit = own.join(often, F.col("hash") == F.col("key"))
    if not first_come:
        hit = hit.where("own <> last")
    # Rows that are equal in id and text lose the same lines, so a set for each key is all that is needed.
    return hit.select("row_key", "hash").distinct().groupBy("row_key").agg(F.collect_list("hash").alias("hashes"))


def line_digest(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    store = LineRuns(docs.sparkSession)
    store.add(docs)
    return drop_lines(docs, stored(store.frequent(), "frequent"), digest=True, broadcast_keys=broadcast_keys)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines gone; n_chars follows the text where there is such a column."""
    store = LineRuns(docs.sparkSession)
    store.add(docs)
    return drop_lines(docs, stored(store.frequent(), "frequent"))
