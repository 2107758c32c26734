"""The driver's contract, and queries against their SQL on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from packsmith.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted("|".join(show(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "size", "sha256", "entropy", "verdict"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(want.columns, want.fetchall())


def test_kinds_of_odd_pages(spark, tmp_path):
    """Characters cut at the 8,192nd byte, NUL, leading dots, line breaks and a dotted I, against the SQL."""
    long = ["a" * k + c for k in range(8188, 8194) for c in ("é", "漢", "😀", "\x00")]
    names = ["a.png", ".png", "..json", "a\n.gif", "a\r\nb.Zip", "\u2028.csv", "a.png\n", "a.G\u0130F", "a.\u212adf", "a.m\u212av", "a.jpg/", "a.jpg?v=1", "..", ""]
    pages = [(f"https://h.example/{n}", "<html>") for n in names] + [(".png", "x"), (None, "x\x00"), (None, None), ("a", "GIF8\x00"), ("a", "éxxftyp")] + [("https://h.example/", h) for h in long]
    spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["profile_pages_kind"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(registry.ORACLES["profile_pages_kind"])
    assert sorted(map(tuple, got.select("page_id", "kind", "steps").collect())) == sorted(want.project("page_id, kind, steps").fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_works_without_the_corpus_operators(tmp_path):
    """The package, the entry and the queries without the folders that may be absent."""
    root = Path(__file__).resolve().parents[2]
    for name in ("packsmith", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "packsmith" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'profile_documents' in q and not any(n.startswith('op') for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
