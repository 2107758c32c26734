"""Composite operators: routing by kind and request, directories as one package, and delta packages in one value."""

from __future__ import annotations

import hashlib
import io
import tarfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsmith import errors
from packsmith.functions import codecs, packages
from packsmith.functions.chunking import AVG_CHUNK, MAX_CHUNK, MIN_CHUNK, boundaries
from packsmith.functions.scalars import detect_kind
from packsmith.operators.pack import _rowwise, pack, pack_v1
from packsmith.sources.archives import recompress_zips

ROUTED = ["item_id", "route", "orig", "new", "package", "error_class"]
NEEDS_LIBRARY = ["image", "pdf", "audio_wav"]


def pack_auto(items: DataFrame, mode: str = "balanced", target: int | None = None, lossless: bool = True, advanced: bool = False) -> DataFrame:
    """Packages by the first rule that fits: images with a target or lossy need an image library that is not here and get an
    error_class; lossy others go to version 1; all else to version 2. With a target, hit_target says whether it was met."""
    if mode == "micro_800k" and target is None:
        target = 800 * 1024
    kinds = items.withColumn("kind", detect_kind(F.col("path"), F.col("content")))
    lossy_image = (F.col("kind") == "image") & F.lit(target is not None or not lossless)
    refused = kinds.where(lossy_image).select("item_id", F.lit("image").alias("route"), F.col("length").alias("orig"), F.lit(None).cast("bigint").alias("new"), F.lit(None).cast("binary").alias("package"), F.lit("UnsupportedCodecError").alias("error_class"))
    rest = kinds.where(~lossy_image).drop("kind")
    packed = pack(rest, mode, advanced=advanced) if lossless or target is not None else pack_v1(rest, mode)
    out = packed.withColumn("route", F.when(F.col("method") == "v1", "v1").otherwise("v2")).select(*ROUTED).unionByName(refused.select(*ROUTED))
    return out.withColumn("hit_target", F.col("new") <= target) if target is not None else out


def optimise(items: DataFrame) -> DataFrame:
    """Quality-lossless re-encoding by kind: zip-based files are recompressed, other files packed; kinds whose library is not
    here get an error_class."""
    kinds = items.withColumn("kind", detect_kind(F.col("path"), F.col("content")))
    zips = recompress_zips(kinds.where(F.col("kind").isin("office", "archive"))).select("item_id", F.lit("zip").alias("route"), "orig", "new", F.col("content").alias("package"), "error_class")
    none = kinds.where(F.col("kind").isin(NEEDS_LIBRARY)).select("item_id", F.col("kind").alias("route"), F.col("length").alias("orig"), F.lit(None).cast("bigint").alias("new"), F.lit(None).cast("binary").alias("package"), F.lit("UnsupportedCodecError").alias("error_class"))
    rest = pack(kinds.where(~F.col("kind").isin("office", "archive", *NEEDS_LIBRARY)).drop("kind")).withColumn("route", F.lit("v2")).select(*ROUTED)
    return zips.unionByName(none.select(*ROUTED)).unionByName(rest)


def _tar(members: list[dict]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as archive:
        for m in members:
            info = tarfile.TarInfo(m["path"])
            info.size = len(m["content"])
            archive.addfile(info, io.BytesIO(m["content"]))
    return out.getvalue()


def directories(items: DataFrame) -> DataFrame:
    """Each parent directory of bounded size as one item: a tar of its files by name."""
    path = F.regexp_extract("path", "^(.*?)/?([^/]*)$", 1)
    grouped = items.groupBy(path.alias("dir")).agg(F.array_sort(F.collect_list(F.struct("path", "content"))).alias("members"))

    def one(folder, members):
        data = _tar(members)
        return folder, data, len(data)

    made = _rowwise(grouped, "dir string, content binary, length bigint", one, ["dir", "members"])
    return made.select(F.xxhash64("dir").alias("item_id"), F.concat("dir", F.lit(".tar")).alias("path"), "content", "length")


def delta_package(base: bytes, new: bytes, base_name: str = "base", name: str = "new", mode: str = "balanced", sizes: tuple[int, int, int] = (MIN_CHUNK, AVG_CHUNK, MAX_CHUNK)) -> bytes:
    """What new has and base does not, with the whole order of new, as one package."""

    def parts(data: bytes) -> list[tuple[str, bytes]]:
        ends = boundaries(data, *sizes)
        return [(hashlib.sha256(data[a:b]).hexdigest(), data[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=False)]

    known, order, codec = {sha for sha, _ in parts(base)}, parts(new), codecs.available_codecs()[0]
    fresh = {sha: part for sha, part in order if sha not in known}
    body = packages.pack_blobs({"codec": codec, "order": [sha for sha, _ in order]}, [(sha, codecs.compress(part, codec, mode)) for sha, part in fresh.items()])
    meta = {"v": 2, "kind": "delta", "codec": f"delta+{codec}", "method": "delta", "pre": "none", "transform": "none", "tparams": {}, "base_name": base_name, "base_sha256": hashlib.sha256(base).hexdigest(), "orig_name": name, "new_sha": hashlib.sha256(new).hexdigest(), "orig_size": len(new), "new_chunks": len(fresh), "total_chunks": len(order), "mode": mode, "lossless": True}
    return packages.frame(meta, body)


def apply_package(base: bytes, package: bytes, cap: int | None = None, sizes: tuple[int, int, int] = (MIN_CHUNK, AVG_CHUNK, MAX_CHUNK)) -> bytes:
    """The new version; refuses another base, a missing chunk, and a result with another hash."""
    meta, body = packages.parse(package)
    if meta.get("method") != "delta":
        raise errors.CorruptPackageError("not a delta")
    if hashlib.sha256(base).hexdigest() != meta.get("base_sha256"):
        raise errors.BaseMismatchError("the delta was made for another base")
    manifest, blobs = packages.unpack_blobs(body)
    limit, out, size = codecs.resolve_cap(cap, len(body)), [], 0
    ends = boundaries(base, *sizes)
    old = {hashlib.sha256(base[a:b]).hexdigest(): base[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)}
    for sha in manifest.get("order", []):
        if sha in blobs:
            part = codecs.decompress(blobs[sha], manifest.get("codec", "lzma"), limit)
        elif sha in old:
            part = old[sha]
        else:
            raise errors.CorruptPackageError(f"chunk {sha[:16]} is missing")
        size += len(part)
        if size > limit:
            raise errors.OutputLimitError(f"output exceeds {limit} bytes")
        out.append(part)
    whole = b"".join(out)
    if hashlib.sha256(whole).hexdigest() != meta.get("new_sha"):
        raise errors.VerificationError("the result has another hash")
    return whole


def delta_packages(pairs: DataFrame, mode: str = "balanced", sizes: tuple[int, int, int] = (MIN_CHUNK, AVG_CHUNK, MAX_CHUNK)) -> DataFrame:
    """Rows (item_id, base, new) -> item_id, package, new_chunks, total_chunks, reused_chunks."""

    def one(item, base, new):
        package = delta_package(base or b"", new or b"", mode=mode, sizes=sizes)
        meta, _ = packages.parse(package)
        return item, package, meta["new_chunks"], meta["total_chunks"]

    made = _rowwise(pairs, "item_id bigint, package binary, new_chunks int, total_chunks int", one, ["item_id", "base", "new"])
    return made.withColumn("reused_chunks", F.col("total_chunks") - F.col("new_chunks"))


def applied_packages(pairs: DataFrame, cap: int | None = None, sizes: tuple[int, int, int] = (MIN_CHUNK, AVG_CHUNK, MAX_CHUNK)) -> DataFrame:
    """Rows (item_id, base, package) -> item_id, content, error_class."""

    def one(item, base, package):
        try:
            return item, apply_package(base or b"", package or b"", cap, sizes), None
        except errors.PackError as e:
            return item, None, type(e).__name__

    return _rowwise(pairs, "item_id bigint, content binary, error_class string", one, ["item_id", "base", "package"])
