"""Scalar functions against plain Python rules."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from packsmith.functions import scalars as sc


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_kinds(spark):
    cut = ("a" * 8191 + "é").encode()
    rows = [
        ("a/b.PNG", b"x", "image"), ("x.csv", b"", "csv"), ("x.tsv", b"", "csv"), ("x.json", b"", "json"), ("x.md", b"\x00", "text"), ("x.wav", b"", "audio_wav"), ("x.mp3", b"", "audio"), ("x.mkv", b"", "video"), ("x.docx", b"", "office"), ("x.tqz", b"", "archive"), ("x.dll", b"", "executable"), ("x.pdf", b"hello", "pdf"),
        ("x", b"\xff\xd8\xff\xe0", "image"), ("x", b"\x89PNG", "image"), ("x", b"RIFF" + bytes(8), "audio_wav"), ("x", b"RIFFshort", "text"), ("x", b"%PDF-1", "pdf"), ("x", b"PK\x03\x04", "office"), ("x", b"\x1f\x8b\x08", "archive"), ("x", b"BZh9", "archive"), ("x", b"\xfd7zXZ", "archive"), ("x", b"GIF89a", "image"), ("x", b"\x00\x00\x00\x18ftypmp42", "video"), ("x", b"ftyp", "video"),
        ("x", b"plain text", "text"), ("x", b"", "text"), ("x", b"\xff\xfe", "generic"), ("x", b"nul \x00 inside", "generic"), (".bashrc", b"a", "text"), ("dir.png/name", b"a", "text"), (None, b"a", "text"), ("x", None, "generic"), ("x", cut, "generic"),
    ]
    frame = spark.createDataFrame(rows, "path string, content binary, want string")
    got = frame.select("want", sc.detect_kind(F.col("path"), F.col("content")).alias("kind")).collect()
    assert [r.kind for r in got] == [r.want for r in got]
    assert values(spark, [("x", cut), ("x", b"\xff")], "path string, content binary", sc.detect_kind(F.col("path"), F.col("content"), compat=False)) == ["text", "generic"]
    assert values(spark, [("csv",), ("odd",)], "k string", sc.suggest_pipeline(F.col("k"))) == [sc.STEPS["csv"], sc.STEPS["generic"]]


def test_extensions_of_names_with_line_breaks(spark):
    paths = ["a\nb.PNG", "d.x/a\r\n.b.zip", "\u2028x.csv", ".\n.md", "a.gif\n", "\n", ".a\nb"]
    assert values(spark, [(p,) for p in paths], "p string", sc.extension(F.col("p"))) == [os.path.splitext(p)[1].lower() for p in paths]


def test_kinds_of_strings(spark):
    rows = [("x", ("a" * 8191 + "é").encode()), ("x", b"nul \x00"), ("x", None), (None, b"%PDF-1"), ("x.csv", b"")]
    assert values(spark, rows, "path string, content binary", sc.detect_kind(F.col("path"), F.col("content"), decoded=True)) == ["text", "text", "text", "pdf", "csv"]


def plain_size(n):
    n = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{int(n)} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TB"


def test_sizes(spark):
    rng = random.Random(1)
    sizes = [0, 1, 1023, 1024, 1152, 1048575, 1048576, 1 << 40, 1 << 52] + [rng.randrange(1 << rng.randrange(1, 46)) for _ in range(300)]
    assert values(spark, [(s,) for s in sizes], "s bigint", sc.format_size(F.col("s"))) == [plain_size(s) for s in sizes]
    texts = {"800KB": 819200, " 1.5 g": 1610612736, "12": 12, "7b": 7, "2TB": 2 << 40, "3m": 3 << 20, "x": None, "": None, None: None, "1..2K": None}
    assert values(spark, [(t,) for t in texts], "t string", sc.parse_size(F.col("t"))) == list(texts.values())


def test_modes(spark):
    assert values(spark, [("MAX",), ("best",), ("maximum",), (None,), ("",)], "m string", sc.canonical_mode(F.col("m"))) == ["max", "ultra", "max", "balanced", "balanced"]
    assert values(spark, [("odd",), ("best",)], "m string", sc.lenient_mode(F.col("m"))) == ["balanced", "ultra"]
    with pytest.raises(Exception, match="unknown mode"):
        values(spark, [("odd",)], "m string", sc.canonical_mode(F.col("m")))
    got = values(spark, [(1000, "balanced"), (0, "fast"), (800, "balanced"), (5, "micro_800k")], "s bigint, m string", sc.target_for_mode(F.col("s"), F.col("m")))
    assert got == [max(1, int(1000 * 0.2875)), 1, int(800 * 0.2875), None]
    frame = sc.with_preset(spark.createDataFrame([(1, "ultra"), (2, "FAST")], "i int, mode string")).orderBy("i").collect()
    assert [(r.zstd_level, r.max_dim) for r in frame] == [(22, 1280), (3, None)]


def test_ratios_and_caps(spark):
    got = values(spark, [(0, 5), (-1, 5), (3, 1), (100, 115)], "o bigint, n bigint", sc.ratio_stats(F.col("o"), F.col("n")))
    assert [tuple(r) for r in got] == [(0, 5, 0.0, 0.0), (0, 5, 0.0, 0.0), (3, 1, 0.3333, 66.67), (100, 115, 1.15, -15.0)]
    assert values(spark, [(None, 10), (0, 1 << 20), (7, 10)], "c bigint, n bigint", sc.resolve_cap(F.col("c"), F.col("n"))) == [1 << 30, 100_000 << 20, 7]
    with pytest.raises(Exception, match="positive"):
        values(spark, [(-1, 10)], "c bigint, n bigint", sc.resolve_cap(F.col("c"), F.col("n")))


def plain_name(name, max_len=100):
    base = (name or "").strip(" ").replace("\x00", "").rsplit("/", 1)[-1]
    base = re.sub("[\r\n\"']", "", base).strip(" .")
    safe = re.sub("_+", "_", re.sub("[^A-Za-z0-9._-]", "_", base)).strip("._-")
    if not base or not safe:
        return "file.bin"
    if len(safe) > max_len:
        stem, dot, ext = safe.rpartition(".")
        safe = stem[: max_len - len(ext) - 1] + "." + ext if dot and len(ext) <= 10 else safe[:max_len]
    return safe


def test_names(spark):
    rng = random.Random(2)
    names = ["../../etc/passwd", "a b\"c'd.txt", "", None, "...", "é中.txt", "x" * 120 + ".tar", "y" * 130, "a/" * 5, "n" * 95 + "." + "e" * 11, "__--..", "a\r\nb"]
    names += ["".join(rng.choice("ab./ _-é\"'\n") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    assert values(spark, [(n,) for n in names], "n string", sc.sanitize_filename(F.col("n"))) == [plain_name(n) for n in names]
