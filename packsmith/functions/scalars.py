"""Scalar functions as Spark columns: kinds, presets, sizes, names and ratios. No Python runs on the data."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KIB = 1024

# Extensions of each kind, in the order in which they are tried.
EXTENSIONS = {
    "image": [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif", ".gif", ".avif", ".heic", ".heif", ".ico"],
    "audio_wav": [".wav", ".aiff", ".aif"],
    "audio": [".mp3", ".ogg", ".flac", ".m4a", ".aac", ".opus", ".wma"],
    "video": [".mp4", ".mkv", ".avi", ".mov", ".webm", ".flv", ".wmv", ".m4v"],
    "pdf": [".pdf"],
    "office": [".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp", ".epub", ".apk", ".jar"],
    "archive": [".zip", ".rar", ".7z", ".gz", ".bz2", ".xz", ".zst", ".tqz", ".tgz"],
    "executable": [".exe", ".dll", ".so", ".bin", ".dat", ".iso", ".img"],
    "csv": [".csv", ".tsv"],
    "json": [".json", ".jsonl"],
    "text": [".txt", ".log", ".md", ".xml", ".html", ".css", ".js", ".ts", ".py", ".java", ".cs", ".c", ".cpp", ".h", ".sql", ".yaml", ".yml", ".ini", ".cfg"],
}
# Fixed values: (first bytes in hexadecimal, least length, kind), in the order in which they are tried.
MAGIC = [("FFD8FF", 3, "image"), ("89504E47", 4, "image"), ("52494646", 12, "audio_wav"), ("25504446", 4, "pdf"), ("504B0304", 4, "office"), ("1F8B", 2, "archive"), ("425A68", 3, "archive"), ("FD377A585A", 5, "archive"), ("47494638", 4, "image")]
# The steps that suit each kind.
STEPS = {
    "image": ["lossless-reencode", "strip-meta?", "best-codec"],
    "text": ["dedup-chunks", "zstd-dict?", "max-codec"],
    "csv": ["column-normalize?", "dedup-chunks", "max-codec"],
    "json": ["dedup-chunks", "max-codec"],
    "pdf": ["recompress-streams", "dedup", "max-codec"],
    "office": ["unzip-recompress", "dedup", "max-codec"],
    "audio_wav": ["flac-if-available", "dedup", "max-codec"],
    "audio": ["repack-only", "dedup"],
    "video": ["repack-only", "dedup"],
    "archive": ["recompress-if-zip", "dedup"],
    "executable": ["dedup", "delta?", "max-codec"],
    "generic": ["dedup", "best-codec"],
}
# Image quality, largest side, resizing, zstd level, lzma preset, chunk MiB and target share of each mode.
PRESETS = {
    "fast": (82, None, False, 3, 1, 8, 0.60),
    "balanced": (72, 1920, True, 12, 6, 8, 0.2875),
    "max": (72, 1920, True, 19, 9, 8, 0.15),
    "ultra": (55, 1280, True, 22, 9, 4, 0.05),
    "extreme": (38, 1280, True, 22, 9, 4, 0.05),
    "micro_800k": (55, 1280, True, 22, 9, 4, None),
}
ALIASES = {"maximum": "max", "best": "ultra"}
MICRO_BYTES = 800 * KIB
SNIFF_BYTES = 8192
AUTO_CAP_BYTES, AUTO_CAP_RATIO = 1 << 30, 100_000
PRESET_SCHEMA = "mode string, image_quality int, max_dim int, allow_resize boolean, zstd_level int, lzma_preset int, chunk_mb int, target_ratio double"


def _map(values: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)) for k, v in values.items()))


def extension(path: Column) -> Column:
    """The extension in lower case with its dot; leading dots of the name make none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def detect_kind(path: Column, content: Column, compat: bool = True, decoded: bool = False) -> Column:
    """The kind of a file: by extension, else by its first bytes, else text if it is UTF-8 without NUL, else generic.

    compat sniffs exactly the first 8,192 bytes; otherwise a character that is cut there does not count against the text.
    decoded: the content comes from a string column, so what is left is text.
    """
    ext = extension(F.coalesce(path, F.lit("")))
    kind = None
    for name, known in EXTENSIONS.items():
        kind = (F if kind is None else kind).when(ext.isin(known), F.lit(name))
    head = F.hex(F.substring(content, 1, 16))
    for magic, least, name in MAGIC:
        kind = kind.when(head.startswith(magic) & (F.octet_length(content) >= least), F.lit(name))
    kind = kind.when(head.startswith("66747970") | (F.substring(head, 9, 8) == "66747970"), F.lit("video"))
    if decoded:
        return kind.otherwise(F.lit("text"))
    sample = F.substring(content, 1, SNIFF_BYTES)
    text = F.is_valid_utf8(sample.cast("string"))
    if not compat:
        for cut in (1, 2, 3):
            text = text | ((F.octet_length(content) > SNIFF_BYTES) & F.is_valid_utf8(F.substring(content, 1, SNIFF_BYTES - cut).cast("string")))
    nul = F.hex(sample).rlike("^(..)*?00")
    return kind.when(content.isNotNull() & text & ~nul, F.lit("text")).otherwise(F.lit("generic"))


def suggest_pipeline(kind: Column) -> Column:
    """The steps for a kind, as an array."""
    return F.coalesce(F.try_element_at(_map(STEPS), kind), F.array(*map(F.lit, STEPS["generic"])))


def presets(spark: SparkSession) -> DataFrame:
    """The modes as a small dimension table."""
    return spark.createDataFrame([(mode, *row) for mode, row in PRESETS.items()], PRESET_SCHEMA)


def canonical_mode(mode: Column) -> Column:
    """The mode in lower case, its aliases resolved; null means balanced; an unknown mode raises."""
    low = F.lower(F.when(F.coalesce(mode, F.lit("")) == "", "balanced").otherwise(mode))
    low = F.coalesce(F.try_element_at(_map(ALIASES), low), low)
    return F.when(low.isin(list(PRESETS)), low).otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), low)).cast("string"))


def lenient_mode(mode: Column) -> Column:
    """As canonical_mode, but balanced instead of an error."""
    low = F.lower(F.coalesce(mode, F.lit("balanced")))
    low = F.coalesce(F.try_element_at(_map(ALIASES), low), low)
    return F.when(low.isin(list(PRESETS)), low).otherwise("balanced")


def with_preset(df: DataFrame, mode_col: str = "mode") -> DataFrame:
    """Join the columns of the mode's preset; its six rows are broadcast."""
    known = presets(df.sparkSession).withColumnRenamed("mode", "__mode")
    return df.join(F.broadcast(known), canonical_mode(F.col(mode_col)) == F.col("__mode"), "left").drop("__mode")


def target_for_mode(size: Column, mode: Column) -> Column:
    """The mode's advisory size for an input, at least 1; null where the mode has none."""
    ratio = F.try_element_at(_map({m: p[-1] for m, p in PRESETS.items() if p[-1] is not None}), F.lower(mode))
    return F.greatest(F.lit(1).cast("bigint"), (size * ratio).cast("bigint")) * F.when(ratio.isNotNull(), F.lit(1))


def ratio_stats(orig: Column, new: Column) -> Column:
    """orig, new, ratio (4 places) and saved_pct (2 places); all but new are 0 where orig is not positive."""
    ok = orig > 0
    ratio = new.cast("double") / F.when(ok, orig).cast("double")
    zero = F.lit(0.0)
    return F.struct(F.when(ok, orig).otherwise(0).cast("bigint").alias("orig"), new.cast("bigint").alias("new"), F.coalesce(F.round(ratio, 4), zero).alias("ratio"), F.coalesce(F.round((1 - ratio) * 100, 2), zero).alias("saved_pct"))


def format_size(size: Column) -> Column:
    """A size for people: whole bytes, or two places (half to even) in KB to TB, by 1,024."""
    out = F.when(size < KIB, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
    for k, unit in enumerate(["KB", "MB", "GB"], 1):
        out = out.when(size < KIB ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(size.cast("double") / KIB**k, 2)))
    return out.otherwise(F.format_string("%.2f TB", F.bround(size.cast("double") / KIB**4, 2)))


def parse_size(text: Column) -> Column:
    """Bytes of a size such as 800KB or 1.5 G; null where it is none."""
    clean = F.upper(F.regexp_replace(F.trim(text), " ", ""))
    number, unit = F.regexp_extract(clean, r"^([0-9.+-]+)(TB|GB|MB|KB|[TGMKB])?$", 1), F.regexp_extract(clean, r"([TGMK])?B?$", 1)
    return (number.try_cast("double") * F.coalesce(F.try_element_at(_map({u: float(KIB**k) for k, u in enumerate("KMGT", 1)}), unit), F.lit(1.0))).cast("bigint")


def sanitize_filename(name: Column, default: str = "file.bin", max_len: int = 100) -> Column:
    """A name without path, quotes and odd characters; the extension stays when the name is cut, if it is at most 10 long."""
    bare = F.regexp_replace(F.regexp_extract(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "\\x00", ""), r"([^/]*)$", 1), "[\r\n\"']", "")
    bare = F.regexp_replace(bare, r"^[ .]+|[ .]+$", "")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9._-]", "_"), "_+", "_"), r"^[._-]+|[._-]+$", "")
    ext = F.regexp_extract(safe, r"\.([^.]*)$", 1)
    short = F.when(safe.contains(".") & (F.length(ext) <= 10), F.concat(F.substring(F.regexp_extract(safe, r"^(.*)\.[^.]*$", 1), F.lit(1), max_len - F.length(ext) - 1), F.lit("."), ext)).otherwise(F.substring(safe, 1, max_len))
    cut = F.when(F.length(safe) > max_len, short).otherwise(safe)
    return F.when((bare == "") | (cut == ""), F.lit(default)).otherwise(cut)


def resolve_cap(cap: Column, compressed: Column) -> Column:
    """The cap of an output: that given, else the larger of 1 GiB and 100,000 times the input; a negative one raises."""
    given = F.when(cap < 0, F.raise_error(F.lit("the cap must be positive")).cast("bigint")).otherwise(cap.cast("bigint"))
    return F.when(F.coalesce(cap, F.lit(0)) == 0, F.greatest(F.lit(AUTO_CAP_BYTES).cast("bigint"), compressed.cast("bigint") * AUTO_CAP_RATIO)).otherwise(given)


def verdict(entropy: Column) -> Column:
    """What the entropy of the bytes says, on its unrounded value."""
    return F.when(entropy <= 6.5, "compressible").when(entropy >= 7.6, "incompressible").otherwise("marginal")


def joined_bytes(parts: Column) -> Column:
    """The values of an array of binaries, one after the other: each byte is copied a fixed number of times, however many parts there
    are. As Latin-1 every byte is one character, so that text functions can join them."""
    return F.encode(F.array_join(F.transform(parts, lambda p: F.decode(p, "ISO-8859-1")), ""), "ISO-8859-1")
