"""License scans against exact containment of all templates in all windows."""

import random
import re

import pytest

from packsmith.llm import licenses as lc


def words(text):
    return [w.lower() for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def grams(ws):
    return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]


def plain(text, templates=lc.TEMPLATES):
    ws = grams(words(text))
    found = {}
    for name, t in templates.items():
        own = set(grams(words(t)))
        size = lc.block_size(len(own))
        for start in range(0, len(ws), size):
            part = ws[start : start + lc.BLOCKS * size]
            share = len(own & set(part)) / len(own)
            if share >= 0.8:
                at = [start + k for k, g in enumerate(part) if g in own]
                new = (share, at[0], at[-1] + 5)
                if name not in found or (share, -at[0]) > (found[name][0], -found[name][1]):
                    found[name] = new
    names = sorted(found)
    return len(names), ",".join(names), max((found[k][0] for k in names), default=0.0), ",".join(f"{k}:{found[k][1]}:{found[k][2]}" for k in names)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, licenses string")
    got = sorted(str(tuple(r)) for r in lc.scan_licenses(docs).collect())
    assert got == sorted(str((i, *plain(t))) for i, t in rows)
    return got


def test_templates_in_context(spark):
    filler = "some other words that stand around the notice and say nothing of it " * 9
    rows = []
    for k, t in enumerate(lc.TEMPLATES.values()):
        rows += [(10 * k + j, filler[: 13 * j * k % 300] + t + filler) for j in range(6)]
        own = t.split()
        rows.append((10 * k + 7, filler + " ".join(own[: len(own) // 2] + ["oops"] + own[len(own) // 2 :])))
        rows.append((10 * k + 8, " ".join(own[: len(own) // 3])))
        rows.append((10 * k + 9, t.upper() + "\n" + t))
    got = check(spark, rows)
    assert sum("mit-terms" in g for g in got) >= 7


def test_many_templates(spark):
    """More templates of one size than are compared one by one."""
    rng = random.Random(2)
    own = {f"t{k}": " ".join(rng.choices("one two three four five six seven".split(), k=14)) for k in range(40)} | {"twin": "a b c d e f", "twins": "a b c d e f"}
    rows = [(k, " ".join(rng.choices([*own.values(), "some other text"], k=4))) for k in range(60)]
    got = lc.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), own).collect()
    assert sorted(map(tuple, got)) == sorted((i, *plain(t, own)) for i, t in rows)


def test_windows_at_every_position():
    """A notice with an insertion of its own length is found wherever it begins."""
    own = lc.TEMPLATES["mit-terms"].split()
    torn = " ".join([*own[:30], *(f"foreign{k}" for k in range(len(own) - 6)), *own[30:]])
    texts = [" ".join(["filler"] * k + [torn] + ["end"] * (97 - k)) for k in range(97)]
    found = lc.Scanner().scan(lc.pa.array(texts))
    place = sorted(lc.TEMPLATES).index("mit-terms")
    share = len(set(grams(words(torn))) & set(grams(words(lc.TEMPLATES["mit-terms"])))) / len(set(grams(words(lc.TEMPLATES["mit-terms"]))))
    assert share >= 0.9
    assert [x[place][0] for x in found] == [share] * 97


def test_near_misses():
    """Notices of related licenses, and one whose words have the hashes of the template's, are told apart."""
    names = sorted(lc.TEMPLATES)
    for name in ("lgpl-notice", "agpl-3.0-notice", "gpl-notice", "bsd-warranty", "mit-warranty", "boost-terms", "mit-terms", "zlib-terms"):
        (found,) = lc.Scanner().scan(lc.pa.array([lc.TEMPLATES[name]]))
        assert [names[k] for k in found] == [name]
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, other = ("".join(x[k] for k in bits) for x in ("ab", "ba"))
    scanner = lc.Scanner({"t": f"{one} two three four five six"})
    assert [len(x) for x in scanner.scan(lc.pa.array([f"{one} two three four five six", f"{other} two three four five six"]))] == [1, 0]


def test_edge_cases(spark):
    t = lc.TEMPLATES["mit-line"]
    check(spark, [(1, None), (2, ""), (3, "too few words"), (None, t), (5, t), (5, t), (6, "é " * 30_000 + t + " 中" * 30_000)])
    assert lc.scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark):
    import pyarrow.parquet as pq

    from packsmith.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(map(tuple, QUERIES["op4_licenses"](spark, sf).collect()))
    assert got == sorted((r["doc_id"], *plain(r["text"])) for r in rows)
    assert sum(g[1] for g in got) > 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 30, 100, 1000])
def test_bands_hardly_miss(n):
    assert lc.block_size(n) >= 1.25 * n
    assert lc.miss_probability(n) < 1e-5
