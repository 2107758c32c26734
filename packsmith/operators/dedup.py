"""Content dedup of items, lines and chunks; manifests, restore, and a content-addressed blob store.

Only hashes, lengths and places are shuffled where that is enough; bytes travel once, to their final join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packsmith.functions.arrow import in_batches, items_of
from packsmith.functions.chunking import AVG_CHUNK, MAX_CHUNK, MIN_CHUNK, boundaries
from packsmith.functions.scalars import joined_bytes

CHUNK_SCHEMA = "item_id bigint, seq int, pos bigint, len int, data binary"


def chunks(items: DataFrame, least: int = MIN_CHUNK, average: int = AVG_CHUNK, most: int = MAX_CHUNK, mode: str = "compat") -> DataFrame:
    """Content-defined chunks: item_id, seq, pos, len, sha, data. An empty item has none."""

    schema = pa.schema([("item_id", pa.int64()), ("seq", pa.int32()), ("pos", pa.int64()), ("len", pa.int32()), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for item, data in items_of(batches, ["item_id", "content"]):
            start = 0
            for seq, end in enumerate(boundaries(data or b"", least, average, most, mode)):
                yield item, seq, start, end - start, data[start:end]
                start = end

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(cut(batches), schema)

    found = items.select("item_id", "content").mapInArrow(rows, CHUNK_SCHEMA)
    return found.select("item_id", "seq", "pos", "len", F.sha2("data", 256).alias("sha"), "data")


def lines(items: DataFrame) -> DataFrame:
    """Lines as chunks: item_id, seq, sha, len, data."""
    text = F.split(F.col("content").cast("string"), "\n", -1)
    out = items.select("item_id", F.posexplode(text).alias("seq", "line"))
    data = F.encode("line", "UTF-8")
    return out.select("item_id", "seq", F.octet_length(data).alias("len"), F.sha2(data, 256).alias("sha"), data.alias("data"))


def _stats(per_hash: DataFrame) -> list[Column]:
    unique = F.coalesce(F.sum("len"), F.lit(0)).cast("bigint")
    total = F.coalesce(F.sum(F.col("n") * F.col("len")), F.lit(0)).cast("bigint")
    return [F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("chunks"), F.count("*").alias("unique_chunks"), total.alias("total_bytes"), unique.alias("unique_bytes"), F.when(total > 0, F.round(unique / total, 4)).otherwise(1.0).alias("dedup_ratio")]


def dedup_stats(pieces: DataFrame) -> DataFrame:
    """One row over all pieces: chunks, unique_chunks, total_bytes, unique_bytes, dedup_ratio (1 if empty)."""
    per_hash = pieces.groupBy("sha").agg(F.count("*").alias("n"), F.min("len").alias("len"))
    return per_hash.agg(*_stats(per_hash))


def item_dedup_stats(pieces: DataFrame) -> DataFrame:
    """The same within each item."""
    per_hash = pieces.groupBy("item_id", "sha").agg(F.count("*").alias("n"), F.min("len").alias("len"))
    return per_hash.groupBy("item_id").agg(*_stats(per_hash))


def exact_copies(items: DataFrame) -> DataFrame:
    """Per distinct content: sha256, n_copies, first_id."""
    return items.select("item_id", F.sha2("content", 256).alias("sha256")).groupBy("sha256").agg(F.count("*").alias("n_copies"), F.min("item_id").alias("first_id"))


def first_pieces(pieces: DataFrame) -> DataFrame:
    """The first piece of each hash, in the order of item and place. min_by is combined before the shuffle, also for hot hashes."""
    rest = [c for c in pieces.columns if c != "sha"]
    key = F.struct(*[c for c in ("item_id", "seq") if c in rest])
    return pieces.groupBy("sha").agg(F.min_by(F.struct(*rest), key).alias("r")).select("sha", *[F.col(f"r.{c}").alias(c) for c in rest])


def manifest(pieces: DataFrame) -> DataFrame:
    """item_id, seq, sha, len: what to put together, without bytes."""
    return pieces.select("item_id", "seq", "sha", "len")


def restore(order: DataFrame, blobs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Put items together: order ⋈ blobs by sha, then by place. A missing blob gives error_class and null content.

    ids: all item ids, so that empty items come back as empty content.
    """
    found = order.join(blobs.select("sha", F.col("data").alias("blob")), "sha", "left")
    grouped = found.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("seq", "blob"))).alias("parts"), F.bool_or(F.col("blob").isNull()).alias("lost"))
    whole = joined_bytes(F.transform("parts", lambda p: p["blob"]))
    out = grouped.select("item_id", F.when(~F.col("lost"), whole).alias("content"), F.when(F.col("lost"), "CorruptPackageError").alias("error_class"))
    if ids is not None:
        out = ids.select("item_id").distinct().join(out, "item_id", "left")
        out = out.withColumn("content", F.when(F.col("error_class").isNull(), F.coalesce("content", F.encode(F.lit(""), "UTF-8"))))
    return out


BLOB_SCHEMA = "sha string, codec string, data binary, prefix string"


class FolderBackend:
    """Blobs as Parquet files in a folder, by the first digit of the hash."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], BLOB_SCHEMA)
        return self.spark.read.schema(BLOB_SCHEMA).parquet(self.path)

    def append(self, blobs: DataFrame) -> None:
        blobs.write.mode("append").partitionBy("prefix").parquet(self.path)


class TableBackend:
    """Blobs as a table of the session's catalog, by the first digit of the hash."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name

    def read(self) -> DataFrame:
        found = self.spark.table(self.name) if self.spark.catalog.tableExists(self.name) else self.spark.createDataFrame([], BLOB_SCHEMA)
        return found.select("sha", "codec", "data", "prefix")

    def append(self, blobs: DataFrame) -> None:
        blobs.write.mode("append").partitionBy("prefix").saveAsTable(self.name)


class BlobStore:
    """A content-addressed store of (sha, codec, data); the first writer wins. The backend is a path, or anything that has read() and
    append(blobs) on tables of BLOB_SCHEMA."""

    def __init__(self, spark: SparkSession, backend) -> None:
        self.spark = spark
        self.backend = FolderBackend(spark, backend) if isinstance(backend, str) else backend

    def table(self) -> DataFrame:
        return self.backend.read()

    def put(self, blobs: DataFrame, codec: str = "store") -> None:
        """Add the blobs (sha, data) that are not there; of equal ones in the batch, one."""
        own = blobs.select("sha", F.lit(codec).alias("codec"), "data", F.substring("sha", 1, 1).alias("prefix"))
        # Dealt by prefix before it is written, or every task would leave a file in every folder.
        self.backend.append(own.join(self.table().select("sha"), "sha", "left_anti").dropDuplicates(["sha"]).repartition("prefix"))

    def get(self, shas: DataFrame) -> DataFrame:
        """sha, data and found for every asked hash."""
        known = self.table().select("sha", "data", F.lit(True).alias("there"))
        return shas.select("sha").join(known, "sha", "left").select("sha", "data", F.coalesce("there", F.lit(False)).alias("found"))

    def contains(self, shas: DataFrame) -> DataFrame:
        """The asked hashes that are there."""
        return shas.select("sha").join(self.table().select("sha"), "sha", "left_semi")

    def count(self) -> int:
        return self.table().count()


def numbered_first(pieces: DataFrame) -> DataFrame:
    """Pieces with first, whether each is the first of its hash within its item."""
    place = F.row_number().over(Window.partitionBy("item_id", "sha").orderBy("seq"))
    return pieces.withColumn("first", place == 1)
