"""ZIP members as rows, recompression, and comparison of archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBER_SCHEMA = "item_id bigint, seq int, name string, content binary, length bigint, error_class string"
RECOMPRESS_SCHEMA = "item_id bigint, method string, orig bigint, new bigint, content binary, same boolean, error_class string"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    names = ["item_id", "seq", "name", "content", "length", "error_class"]
    for batch in batches:
        for item, data in zip(batch.column("item_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(data or b"")) as archive:
                    rows = [(item, k, info.filename, archive.read(info), info.file_size, None) for k, info in enumerate(archive.infolist())]
            except (zipfile.BadZipFile, RuntimeError, EOFError, OSError, ValueError, NotImplementedError):
                rows = [(item, -1, None, None, None, "CorruptPackageError")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def zip_members(items: DataFrame) -> DataFrame:
    """Every member of every archive, in archive order; a damaged archive gives one row with its error_class."""
    return items.select("item_id", "content").mapInArrow(_members, MEMBER_SCHEMA)


def recompressed(data: bytes) -> bytes:
    """The archive with all members deflated at the highest level, names, dates and attributes kept."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as source, zipfile.ZipFile(out, "w") as target:
        for info in source.infolist():
            own = zipfile.ZipInfo(info.filename, info.date_time)
            own.external_attr = info.external_attr
            own.compress_type = zipfile.ZIP_STORED if info.is_dir() else zipfile.ZIP_DEFLATED
            target.writestr(own, source.read(info), compresslevel=9)
    return out.getvalue()


def _recompress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]
    names = ["item_id", "method", "orig", "new", "content", "same", "error_class"]
    for batch in batches:
        for item, data in zip(batch.column("item_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            data = data or b""
            try:
                new = recompressed(data)
                method = "zip-recompress-max" if len(new) < len(data) else "zip-copy (already optimal)"
                new = new if len(new) < len(data) else data
                with zipfile.ZipFile(io.BytesIO(data)) as a, zipfile.ZipFile(io.BytesIO(new)) as b:
                    same = a.namelist() == b.namelist() and all(a.read(n) == b.read(n) for n in a.namelist())
                row = (item, method, len(data), len(new), new, same, None)
            except (zipfile.BadZipFile, RuntimeError, EOFError, OSError, ValueError, NotImplementedError):
                row = (item, None, len(data), None, None, None, "CorruptPackageError")
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)


def recompress_zips(items: DataFrame) -> DataFrame:
    """Archives recompressed, kept as they are where that is not smaller, with the check that all members are the same."""
    return items.select("item_id", "content").mapInArrow(_recompress, RECOMPRESS_SCHEMA)


def compare_archives(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two member tables: per item_id, whether names, order and contents agree."""
    left = a.select("item_id", "seq", F.col("name").alias("a_name"), F.sha2("content", 256).alias("a_sha"))
    right = b.select("item_id", "seq", F.col("name").alias("b_name"), F.sha2("content", 256).alias("b_sha"))
    both = left.join(right, ["item_id", "seq"], "full_outer")
    return both.groupBy("item_id").agg(F.bool_and(F.col("a_name").eqNullSafe(F.col("b_name")) & F.col("a_sha").eqNullSafe(F.col("b_sha"))).alias("same"))
