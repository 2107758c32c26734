"""Packing tables of items: pack, unpack, certify, analyse, benchmark, and encrypt.

Each item is raced and encoded inside one call, so that only the winner's bytes leave Python. Errors become an error_class and nulls;
strict=True raises instead.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packsmith import errors
from packsmith.functions import codecs, packages, race, transforms
from packsmith.functions.arrow import in_batches, items_of
from packsmith.functions.scalars import detect_kind, format_size, lenient_mode, ratio_stats, target_for_mode, verdict
from packsmith.operators.profile import with_entropy
from packsmith.session import spread

# Fixed values.
MAGIC_ENCRYPTED, ITERATIONS, SALT_BYTES, NONCE_BYTES = "TQZE", 200_000, 16, 12
PACK_SCHEMA = "item_id bigint, name string, kind string, mode string, codec string, method string, transform string, orig bigint, new bigint, sha256 string, package binary, verified boolean, error_class string"
UNPACK_SCHEMA = "pkg_id bigint, content binary, size bigint, sha256 string, kind string, codec string, verified boolean, error_class string"
CHECKS_TYPE = "array<struct<check:string,ok:boolean,detail:string>>"
BENCH_SCHEMA = "item_id bigint, mode string, codec string, transform string, pipeline string, orig bigint, new bigint, compress_s double, decompress_s double, verified boolean, error string"
META_SCHEMA = "v int, kind string, codec string, method string, pre string, transform string, tparams map<string,int>, orig_name string, orig_size bigint, sha256 string, mode string, lossless boolean, advanced boolean, base_name string, base_sha256 string, new_sha string, new_chunks int, total_chunks int"


def _rowwise(df: DataFrame, schema: str, work: Callable[..., tuple], columns: list[str]) -> DataFrame:
    """df's columns row by row through work; results leave in batches of bounded size."""
    parsed = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(parsed)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches((work(*row) for row in items_of(batches, columns)), arrow)

    return spread(df.select(*columns)).mapInArrow(rows, parsed)


def _error(e: Exception) -> str:
    return type(e).__name__


def _checked(out: DataFrame, strict: bool) -> DataFrame:
    if not strict:
        return out
    failed = F.raise_error(F.concat(F.lit("failed: "), F.col("error_class"))).cast("string")
    return out.withColumn("error_class", F.when(F.col("error_class").isNotNull(), failed))


#: A row of the race: what was tried, on how many bytes, the size that came out, and the settings.
TRIALS = T.ArrayType(T.StructType().add("transform", "string").add("tried", "long").add("size", "long").add("stride", "integer").add("dict_size", "integer"))


def _trials(sample: pa.Array, names: pa.Array) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    rows = [race.trials(s or b"", n or []) for s, n in zip(sample.to_pylist(), names.to_pylist(), strict=True)]
    return pa.array(rows, to_arrow_type(TRIALS))


def with_choice(items: DataFrame, name: str = "chosen") -> DataFrame:
    """items (content, kind, length) with the transform that a pack would try: a struct of entropy (3 places), verdict, transform, codec,
    stride, est_ratio and tests (the ratio of every trial), from the first 128 KiB.

    The race is a list of trials, one for each transform that the kind allows; its winner is the least (ratio, place in the list).
    Items that look random or are too large have no trials.
    """
    allowed = F.create_map(*[x for kind, names in race.CANDIDATES.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))])
    own = with_entropy(items, race.SELECT_SAMPLE, "__h")
    large, h = F.col("length") > packages.ADVANCED_MOST, F.col("__h")
    names = F.when(~large & (verdict(h) != "incompressible"), F.coalesce(allowed[F.col("kind")], allowed["generic"])).otherwise(F.array().cast("array<string>"))
    sample = F.when(F.size("__names") > 0, F.substring("content", 1, race.SELECT_SAMPLE))
    own = own.withColumn("__names", names).withColumn("__trials", F.arrow_udf(_trials, TRIALS)(sample, F.col("__names")))
    best = F.array_min(F.transform("__trials", lambda t, i: F.struct((t["size"] / t["tried"]).alias("ratio"), i.alias("place"))))
    won = F.get("__trials", best["place"])
    codec = F.when(large, "auto").when(verdict(h) == "incompressible", "store").otherwise(race.trial_codec())
    tests = F.map_from_entries(F.transform("__trials", lambda t: F.struct(t["transform"], F.round(t["size"] / t["tried"], 4))))
    chosen = F.struct(F.round(h, 3).alias("entropy"), verdict(h).alias("verdict"), F.coalesce(won["transform"], F.lit("none")).alias("transform"), codec.alias("codec"), won["stride"].alias("stride"), F.coalesce(F.round(best["ratio"], 4), F.lit(1.0)).alias("est_ratio"), tests.alias("tests"))
    return own.withColumn(name, chosen).drop("__h", "__names", "__trials")


def _ready(items: DataFrame, advanced: bool) -> DataFrame:
    """items with their kind, and chosen: what won the race, null unless advanced."""
    out = items.withColumn("kind", detect_kind(F.col("path"), F.col("content")))
    if not advanced:
        return out.withColumn("chosen", F.lit(None).cast("struct<transform:string,codec:string,stride:int>"))
    return with_choice(spread(out)).withColumn("chosen", F.struct("chosen.transform", "chosen.codec", "chosen.stride"))


def pack(items: DataFrame, mode: str | Column = "balanced", allow_dedup: bool = True, advanced: bool = False, verify: bool = True, strict: bool = False, chunk_sizes: tuple[int, int, int] | None = None, dedup_least: int = packages.DEDUP_LEAST) -> DataFrame:
    """Items (item_id, path, content) as packages, each restored and compared if verify."""
    sizes = chunk_sizes or (packages.MIN_CHUNK, packages.AVG_CHUNK, packages.MAX_CHUNK)
    mode = F.lit(mode) if isinstance(mode, str) else mode

    def one(item, name, kind, mode, content, chosen):
        content = content or b""
        try:
            meta, package = packages.encode(content, name or "", kind, mode, allow_dedup, chosen, sizes, dedup_least)
            verified = packages.decode(package, len(content) + 1)[2] if verify else None
            return item, name, kind, mode, meta["codec"], meta["method"], meta["transform"], len(content), len(package), meta["sha256"], package, verified, None if verified in (True, None) else "VerificationError"
        except errors.PackError as e:
            return item, name, kind, mode, None, None, None, len(content), None, None, None, None, _error(e)

    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    ready = _ready(items, advanced).select("item_id", name.alias("name"), "kind", lenient_mode(mode).alias("mode"), "content", "chosen")
    return _checked(_rowwise(ready, PACK_SCHEMA, one, ["item_id", "name", "kind", "mode", "content", "chosen"]), strict)


def pack_stats(packed: DataFrame) -> DataFrame:
    """Sizes for people, ratio, saving and whether the mode's advisory target was met."""
    stats = ratio_stats(F.col("orig"), F.col("new"))
    target = target_for_mode(F.col("orig"), F.col("mode"))
    return packed.select("item_id", "kind", "codec", "method", "transform", stats.alias("s"), format_size(F.col("orig")).alias("orig_h"), format_size(F.col("new")).alias("new_h"), (F.col("new") <= target).alias("hit_target")).select("item_id", "kind", "codec", "method", "transform", "s.*", "orig_h", "new_h", "hit_target")


def _restored(package: bytes, cap: int | None, decode: Callable) -> tuple[dict, bytes | None, bool | None, str | None]:
    """(header, content, verified, error class) of a package, without raising."""
    try:
        meta, content, verified = decode(package, cap)
        return (meta, None, False, "VerificationError") if verified is False else (meta, content, verified, None)
    except errors.PackError as e:
        return {}, None, None, _error(e)


def unpack(packed: DataFrame, cap: int | None = None, strict: bool = False, version: str = "any", id_col: str = "item_id") -> DataFrame:
    """Packages (package) restored: content, size, sha256, verified (null where there is no hash) and error_class."""
    decode = {"any": packages.decode_any, "v2": packages.decode, "v1": packages.decode_v1}[version]

    def one(item, package):
        meta, content, verified, error = _restored(package or b"", cap, decode)
        known = (None, None, None) if content is None else (content, len(content), hashlib.sha256(content).hexdigest())
        return item, *known, meta.get("kind"), meta.get("codec"), verified, error

    return _checked(_rowwise(packed, UNPACK_SCHEMA, one, [id_col, "package"]), strict)


def pack_v1(items: DataFrame, mode: str = "balanced", codec: str = "auto") -> DataFrame:
    """Packages of the first version."""

    def one(item, path, content):
        name, content = (path or "").rsplit("/", 1)[-1], content or b""
        try:
            meta, package = packages.encode_v1(content, name, mode, codec)
            return item, name, None, mode, meta["codec"], "v1", "none", len(content), len(package), None, package, None, None
        except errors.PackError as e:
            return item, name, None, mode, None, None, None, len(content), None, None, None, None, _error(e)

    return _rowwise(items, PACK_SCHEMA, one, ["item_id", "path", "content"])


def pack_to_target(items: DataFrame, target: int) -> DataFrame:
    """item_id, codec, new, package and hit_target: the codec ladder down to a size."""

    def one(item, path, content):
        meta, package, hit = packages.to_target(content or b"", (path or "").rsplit("/", 1)[-1], target)
        return item, meta["codec"], len(package), package, hit

    return _rowwise(items, "item_id bigint, codec string, new bigint, package binary, hit_target boolean", one, ["item_id", "path", "content"])


def header(package: Column) -> Column:
    """A package's header in SQL alone: struct of v, meta, body, error_class. Numbers are big-endian."""
    magic, size = F.substring(package, 1, 4), F.conv(F.hex(F.substring(package, 5, 4)), 16, 10).cast("bigint")
    known = F.hex(magic).isin(packages.MAGIC.hex().upper(), packages.MAGIC_V1.hex().upper())
    v2 = F.hex(magic) == packages.MAGIC.hex().upper()
    sane = (F.octet_length(package) >= 8) & (~v2 | ((size >= 2) & (size <= packages.MAX_HEADER))) & (F.octet_length(package) >= 8 + size)
    text = F.when(known & sane, F.substring(package, F.lit(9), size.cast("int")).cast("string"))
    meta = F.from_json(text, META_SCHEMA)
    good = known & sane & F.get_json_object(text, "$").isNotNull() & F.ltrim(text).startswith("{")
    body = F.substring(package, (9 + size).cast("int"), F.octet_length(package))
    return F.struct(F.when(known, F.when(v2, 2).otherwise(1)).alias("v"), F.when(good, meta).alias("meta"), F.when(good, body).alias("body"), F.when(~F.coalesce(good, F.lit(False)), "CorruptPackageError").alias("error_class"))


def _certificate(package: bytes, content: bytes | None = None, compat: bool = False) -> tuple:
    """(verdict, checks, quality, name, size) of a package; content: what it restored to, where that is known to be right."""
    magic, checks, meta, outcome = package[:4], [], {}, None
    checks.append(("magic", magic in (packages.MAGIC, packages.MAGIC_V1), magic.hex()))
    if magic == packages.MAGIC_V1:
        checks += [("header", True, "version 1, without a hash"), ("sha256", True, "skipped")]
        outcome = "PASS" if compat else "UNVERIFIED"
    elif magic == packages.MAGIC:
        try:
            meta, _ = packages.parse(package)
            checks.append(("header", True, f"v{meta.get('v')} kind={meta.get('kind')} codec={meta.get('codec')}"))
            verified = (True if meta.get("sha256") else None) if content is not None else None
            if content is None:
                _, content, verified = packages.decode(package)
            checks += [("sha256", verified is True, f"size={len(content)}"), ("size", len(content) == meta.get("orig_size"), f"{len(content)}=={meta.get('orig_size')}")]
            outcome = "UNVERIFIED" if verified is None else None
        except errors.PackError as e:
            checks.append(("sha256" if meta else "header", False, str(e)[:160]))
    else:
        checks.append(("header", False, "unknown format"))
    outcome = outcome or ("PASS" if all(ok for _, ok, _ in checks) else "FAIL")
    rows = [{"check": c, "ok": ok, "detail": d} for c, ok, d in checks]
    return outcome, rows, "100% (bit-identical)" if outcome == "PASS" else "unknown", meta.get("orig_name"), meta.get("orig_size")


def certify(packed: DataFrame, id_col: str = "item_id", compat: bool = False) -> DataFrame:
    """A certificate per package: verdict and the list of checks (check, ok, detail).

    Packages without a hash are UNVERIFIED; compat calls them PASS, as the first version's tools do.
    """
    schema = f"pkg_id bigint, verdict string, checks {CHECKS_TYPE}, quality string, orig_name string, orig_size bigint"
    return _rowwise(packed, schema, lambda item, package: (item, *_certificate(package or b"", None, compat)), [id_col, "package"])


def opened(packed: DataFrame, cap: int | None = None, id_col: str = "item_id", compat: bool = False) -> DataFrame:
    """The columns of unpack, and verdict and checks of certify, with each package decoded once."""

    def one(item, package):
        package = package or b""
        meta, content, verified, error = _restored(package, cap, packages.decode_any)
        known = (None, None, None) if content is None else (content, len(content), hashlib.sha256(content).hexdigest())
        outcome, rows, *_ = _certificate(package, content, compat)
        return item, *known, meta.get("kind"), meta.get("codec"), verified, error, outcome, rows

    return _rowwise(packed, f"{UNPACK_SCHEMA}, verdict string, checks {CHECKS_TYPE}", one, [id_col, "package"])


def certificate_lines(certs: DataFrame) -> DataFrame:
    """Certificates as text, one line for each check."""
    marks = F.transform("checks", lambda c: F.concat(F.lit("  ["), F.when(c["ok"], "OK ").otherwise("FAIL"), F.lit("] "), c["check"], F.lit(": "), c["detail"]))
    return certs.select("pkg_id", "verdict", F.concat_ws("\n", F.concat(F.lit("certificate: "), F.coalesce("orig_name", F.lit("?"))), F.concat(F.lit("verdict: "), "verdict", F.lit(" | quality: "), "quality"), F.array_join(marks, "\n")).alias("text"))


def analyse(items: DataFrame, keep: list[str] = ()) -> DataFrame:
    """item_id, kind, size, entropy of the first 128 KiB, verdict, and the transform and codec that a pack would try, with its ratio
    on the sample and those of all trials; keep: further columns to carry."""
    kinds = items.withColumn("kind", detect_kind(F.col("path"), F.col("content")))
    chosen = ["entropy", "verdict", "transform", "codec", "est_ratio", "tests"]
    return with_choice(spread(kinds)).select("item_id", *keep, "kind", F.col("length").alias("size"), *[f"chosen.{c}" for c in chosen])


def codec_sizes(items: DataFrame, mode: str = "balanced") -> DataFrame:
    """(item_id, codec, orig, new, sha256 of the decoded bytes, verified) for every codec: encode, then decode."""
    known = codecs.available_codecs()

    schema = pa.schema([("item_id", pa.int64()), ("codec", pa.string()), ("orig", pa.int64()), ("new", pa.int64()), ("sha256", pa.string()), ("verified", pa.bool_())])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for item, data in items_of(batches, ["item_id", "content"]):
            data = data or b""
            for codec in known:
                packed = codecs.compress(data, codec, mode)
                back = codecs.decompress(packed, codec, len(data) + 1)
                yield item, codec, len(data), len(packed), hashlib.sha256(back).hexdigest(), back == data

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(sizes(batches), schema)

    return spread(items.select("item_id", "content")).mapInArrow(rows, "item_id bigint, codec string, orig bigint, new bigint, sha256 string, verified boolean")


def best_codec(sizes: DataFrame) -> DataFrame:
    """The codec with the smallest size per item, the preferred one of equals."""
    priority = F.array_position(F.array(*map(F.lit, codecs.PRIORITY)), F.col("codec"))
    return sizes.groupBy("item_id").agg(F.min_by("codec", F.struct("new", priority)).alias("codec"), F.min("new").alias("new"), F.first("orig").alias("orig"))


def benchmark(items: DataFrame, modes: list[str] = ("fast", "balanced", "max", "ultra"), allow_dedup: bool = True, advanced: bool = False) -> DataFrame:
    """A row per item and mode: sizes, seconds and whether the bytes came back."""

    def one(item, path, kind, mode, content, chosen):
        content, start = content or b"", time.perf_counter()
        try:
            meta, package = packages.encode(content, path or "", kind, mode, allow_dedup, chosen)
            middle = time.perf_counter()
            verified = packages.decode(package)[2]
            return item, mode, meta["codec"], meta["transform"], meta["method"], len(content), len(package), middle - start, time.perf_counter() - middle, verified, None
        except errors.PackError as e:
            return item, mode, None, None, None, len(content), None, None, None, None, _error(e)

    ready = _ready(items, advanced).select("item_id", "path", "kind", F.explode(F.array(*map(F.lit, modes))).alias("mode"), "content", "chosen")
    out = _rowwise(ready, BENCH_SCHEMA, one, ["item_id", "path", "kind", "mode", "content", "chosen"])
    stats = ratio_stats(F.col("orig"), F.col("new"))
    speed = F.round(F.col("orig") / 1048576 / F.greatest("compress_s", F.lit(1e-9)), 2)
    return out.select("item_id", "mode", "codec", "transform", "pipeline", "orig", "new", stats["ratio"].alias("ratio"), stats["saved_pct"].alias("saved_pct"), F.round("compress_s", 3).alias("compress_s"), F.round("decompress_s", 3).alias("decompress_s"), speed.alias("mb_s"), "verified", "error")


def benchmark_lines(rows: DataFrame) -> DataFrame:
    """Benchmark rows as lines of fixed width."""
    widths = [("mode", 10), ("codec", 14), ("transform", 11), ("ratio", 8), ("saved_pct", 8), ("compress_s", 8), ("mb_s", 8)]
    line = F.concat(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("None")), n, " ") for c, n in widths], F.coalesce(F.col("verified").cast("string"), F.lit("None")))
    return rows.select("item_id", "mode", F.when(F.col("error").isNull(), line).otherwise(F.concat(F.rpad("mode", 10, " "), F.lit("ERROR "), F.substring("error", 1, 60))).alias("line"))


def shared_dictionary(items: DataFrame, by: str, size: int = transforms.DICT_BYTES, most: int = 4096) -> DataFrame:
    """One zstd dictionary per group, trained on the first 4 KiB of at most `most` items by hash: (group, dictionary)."""
    ranked = items.select(by, F.struct(F.xxhash64("item_id").alias("h"), F.substring("content", 1, transforms.SLICE_BYTES).alias("s")).alias("x"))
    salted = ranked.groupBy(by, F.pmod(F.col("x.h"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("x")), 1, max(1, most // 64)).alias("x"))

    def one(group, samples):
        return group, transforms.train_dictionary([s for s in samples if s], size)

    parts = salted.groupBy(by).agg(F.transform(F.flatten(F.collect_list("x")), lambda x: x["s"]).alias("samples")).withColumnRenamed(by, "grp")
    return _rowwise(parts, "grp string, dictionary binary", one, ["grp", "samples"])


@lru_cache(maxsize=1024)
def _key(password: str, salt: bytes, iterations: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)


def encrypt(df: DataFrame, password: str, column: str = "package", iterations: int = ITERATIONS) -> DataFrame:
    """df with column encrypted: AES-256-GCM in the JVM under a key from PBKDF2. One random salt for the call, a nonce per row."""
    if not password:
        raise ValueError("the password is empty")
    salt = os.urandom(SALT_BYTES)
    key = F.lit(bytearray(_key(password, salt, iterations)))
    nonce = F.expr(f"unhex(substring(sha2(concat(uuid(), uuid()), 256), 1, {2 * NONCE_BYTES}))")
    fixed = json.dumps({"v": 1, "kdf": "pbkdf2-sha256", "iters": iterations, "salt": base64.b64encode(salt).decode()})[:-1]
    out = df.withColumn("__nonce", nonce)
    head = F.encode(F.concat(F.lit(f'{fixed}, "nonce": "'), F.base64("__nonce"), F.lit('"}')), "UTF-8")
    sealed = F.aes_encrypt(F.col(column), key, F.lit("GCM"), F.lit("DEFAULT"), F.col("__nonce"))
    body = F.substring(sealed, F.lit(NONCE_BYTES + 1), F.octet_length(sealed))
    framed = F.concat(F.encode(F.lit(MAGIC_ENCRYPTED), "UTF-8"), F.unhex(F.lpad(F.hex(F.octet_length(head)), 8, "0")), head, body)
    return out.withColumn(column, framed).drop("__nonce")


def decrypt(df: DataFrame, password: str, column: str = "package") -> DataFrame:
    """df with column decrypted; a wrong password or a changed byte gives null and error_class PasswordError."""

    @F.pandas_udf("binary")
    def keys(salts: pd.Series, iterations: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or n is None or np.isnan(n) or n < 1 else _key(password, bytes(s), int(n)) for s, n in zip(salts, iterations, strict=True)])

    data = F.col(column)
    size = F.conv(F.hex(F.substring(data, 5, 4)), 16, 10).cast("bigint")
    sane = (F.substring(data, 1, 4) == F.encode(F.lit(MAGIC_ENCRYPTED), "UTF-8")) & (F.octet_length(data) >= 8) & (size >= 2) & (size <= packages.MAX_HEADER) & (F.octet_length(data) >= 8 + size)
    head = F.from_json(F.when(sane, F.substring(data, F.lit(9), size.cast("int")).cast("string")), "iters int, salt string, nonce string")
    out = df.withColumn("__head", head).withColumn("__salt", F.expr("try_to_binary(__head.salt, 'base64')")).withColumn("__nonce", F.expr("try_to_binary(__head.nonce, 'base64')"))
    out = out.withColumn("__key", keys(F.col("__salt"), F.col("__head.iters")))
    body = F.substring(data, (9 + size).cast("int"), F.octet_length(data))
    ready = F.col("__key").isNotNull() & (F.octet_length("__nonce") == NONCE_BYTES)
    plain = F.when(ready, F.try_aes_decrypt(F.concat("__nonce", body), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT")))
    out = out.withColumn("__plain", plain).withColumn("error_class", F.when(~F.coalesce(ready, F.lit(False)), "CorruptPackageError").when(F.col("__plain").isNull(), "PasswordError"))
    return out.withColumn(column, F.col("__plain")).drop("__head", "__salt", "__nonce", "__key", "__plain")
