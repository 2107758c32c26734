"""Routing, directories, delta packages and the command line."""

import io
import random
import tarfile
import zipfile

import pytest

from packsmith import errors
from packsmith.__main__ import main
from packsmith.functions import packages
from packsmith.operators import pack, routes

SCHEMA = "item_id bigint, path string, content binary, length bigint"
rng = random.Random(7)


def frame(spark, rows):
    return spark.createDataFrame([(i, p, c, len(c)) for i, p, c in rows], SCHEMA)


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", "hello " * 999)
    return out.getvalue()


def test_auto(spark):
    rows = [(1, "a.txt", b"hello " * 4000), (2, "b.png", b"\x89PNG" + rng.randbytes(100))]
    plain = {r.item_id: r for r in routes.pack_auto(frame(spark, rows)).collect()}
    assert plain[1].route == plain[2].route == "v2"
    target = {r.item_id: r for r in routes.pack_auto(frame(spark, rows), target=5000).collect()}
    assert target[1].hit_target and target[2].error_class == "UnsupportedCodecError"
    lossy = {r.item_id: r for r in routes.pack_auto(frame(spark, rows), lossless=False).collect()}
    assert lossy[1].route == "v1" and bytes(lossy[1].package)[:4] == packages.MAGIC_V1


def test_optimise(spark):
    rows = [(1, "a.txt", b"hello " * 4000), (2, "b.docx", zipped()), (3, "c.pdf", b"%PDF-1"), (4, "d.zip", b"no zip")]
    got = {r.item_id: r for r in routes.optimise(frame(spark, rows)).collect()}
    assert got[2].route == "zip" and got[2].new < got[2].orig and got[3].error_class == "UnsupportedCodecError" and got[4].error_class == "CorruptPackageError" and got[1].route == "v2"


def test_directories(spark):
    dirs = routes.directories(frame(spark, [(1, "x/b.txt", b"bb"), (2, "x/a.txt", b"a"), (3, "y/c.txt", b"")]))
    rows = {r.path: bytes(r.content) for r in dirs.collect()}
    assert sorted(rows) == ["x.tar", "y.tar"]
    with tarfile.open(fileobj=io.BytesIO(rows["x.tar"])) as t:
        assert t.getnames() == ["x/a.txt", "x/b.txt"]
    assert {bytes(r.content) for r in pack.unpack(pack.pack(dirs)).collect()} == set(rows.values())


def test_delta_packages(spark):
    base = rng.randbytes(400_000)
    new = base + b"tail" * 1000
    sizes = (256, 1024, 4096)
    package = routes.delta_package(base, new, sizes=sizes)
    assert routes.apply_package(base, package, sizes=sizes) == new and len(package) < len(new) // 4
    assert packages.parse(routes.delta_package(base, base, sizes=sizes))[0]["new_chunks"] == 0
    with pytest.raises(errors.BaseMismatchError):
        routes.apply_package(new, package, sizes=sizes)
    with pytest.raises(errors.OutputLimitError):
        routes.apply_package(base, package, cap=100, sizes=sizes)
    with pytest.raises(errors.CorruptPackageError):
        routes.apply_package(base, package[:-3], sizes=sizes)
    with pytest.raises(errors.CorruptPackageError):
        routes.apply_package(base, packages.encode(b"x", "x", "text", "fast")[1])
    pairs = spark.createDataFrame([(1, base, new), (2, b"", b"abc"), (3, b"abc", b"")], "item_id bigint, base binary, new binary")
    made = routes.delta_packages(pairs)
    back = routes.applied_packages(made.join(pairs, "item_id"))
    assert {r.item_id: bytes(r.content) for r in back.collect()} == {1: new, 2: b"abc", 3: b""}
    assert {r.error_class for r in routes.applied_packages(made.join(pairs.selectExpr("item_id", "new as base"), "item_id").where("item_id < 3")).collect()} == {"BaseMismatchError"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"hello " * 500)
    assert main(["detect", str(tmp_path / "in")]) == 0 and "text" in capsys.readouterr().out
    assert main(["pack", str(tmp_path / "in"), "--out", str(tmp_path / "packed")]) == 0
    (row,) = spark.read.parquet(str(tmp_path / "packed")).collect()
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a").write_bytes(bytes(row.package))
    assert main(["certify", str(tmp_path / "pkg")]) == 0 and "PASS" in capsys.readouterr().out
    assert main(["unpack", str(tmp_path / "pkg"), "--out", str(tmp_path / "back")]) == 0
    assert bytes(spark.read.parquet(str(tmp_path / "back")).first().content) == b"hello " * 500
    (tmp_path / "pkg" / "a").write_bytes(bytes(row.package)[:-4])
    assert main(["certify", str(tmp_path / "pkg")]) == 2
    for command in ("analyse", "bench"):
        assert main([command, str(tmp_path / "in")]) == 0
