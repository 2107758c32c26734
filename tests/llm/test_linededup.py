"""Line dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from packsmith.llm import linededup as ld

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, min_docs=3):
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    held = defaultdict(list)
    for r, (i, own) in enumerate(lines):
        for k in {key(x) for x in own}:
            if len(k) >= 20:
                held[k].append((i if i is not None else ld.NO_ID, r))
    last = {k: max(v)[0] for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, own in lines:
        kept = [x for x in own if key(x) not in last or last[key(x)] == (i if i is not None else ld.NO_ID)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    pool = [f"a line that many documents share, number {k} é中" for k in range(40)] + ["short", "", "   \t", "exactly twenty chars", "nineteen characters"]
    rows = []
    for i in range(200):
        own = [rng.choice(["", "  ", "\t"]) + (rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool)) + rng.choice(["", "\r", " "]) for _ in range(rng.randint(1, 12))]
        rows.append((i, "\n".join(own)))
    hot = "the one line that a third of all documents hold"
    rows += [(1000 + i, f"{hot}\nown line of this document {i}\n") for i in range(100)]
    rows += [(5000, None), (5001, ""), (None, hot), (1099, f"{hot}\nagain"), (6000, "x" * 300_000 + "\n" + hot)]
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_both_ways_of_deciding(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_lines string").repartition(5)
    want = plain(rows)
    assert result(ld.line_digest(docs)) == want
    assert result(ld.line_digest(docs, broadcast_keys=0)) == want


def test_texts_and_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, None, "s", -1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = ld.dedup_lines(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got), key=str) == sorted(((i, h) for i, _, _, h in plain(rows)), key=str)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert [r.text for r in got if r.doc_id == 5000] == [None]


def test_columns_with_names_used_inside(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, k, 0, 0) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, __gone int, __key int, __own int")
    store = ld.LineRuns(spark)
    store.add(docs)
    want = sorted(((i, h) for i, _, _, h in plain(rows)), key=str)
    for most in (0, 1 << 20):
        got = ld.drop_lines(docs, store.frequent(), broadcast_keys=most)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=str) == want


def test_counts_stop_at_the_largest(spark):
    """A line in 2**32 + 1 documents is not one that occurs once."""
    one = np.zeros(1, np.uint64)
    batch = ld._pack((one, one, np.array([(1 << 32) + 1]), np.array([7])), 4)
    assert ld._unpack(*(batch.column(k)[0].as_py() for k in (1, 2, 3)))[2].tolist() == [ld.MOST_DOCS]


def test_many_buckets_and_a_large_frequent_table(spark, monkeypatch):
    """Buckets that follow from the size of the input, and more frequent lines than are broadcast."""
    rows = [(i, "\n".join(f"line number {j} of a large pool of lines" for j in range(i % 50, i % 50 + 60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    monkeypatch.setattr(ld, "BUCKET_BYTES", 512)
    store = ld.LineRuns(spark)
    store.add(docs)
    assert store.buckets > 300
    frequent = ld.stored(store.frequent(), "frequent")
    assert result(ld.drop_lines(docs, frequent, digest=True, broadcast_keys=10)) == result(ld.drop_lines(docs, frequent, digest=True)) == plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert ld.line_digest(docs).count() == 0


def test_levels_compact_and_batches_match_one_batch(spark):
    rows = [r for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    store = ld.LineRuns(spark, buckets=5, fan=2)
    for k in range(5):
        store.add(docs.where(f"doc_id % 5 = {k}"))
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert result(ld.drop_lines(docs, store.frequent(), digest=True)) == plain(rows)


def test_first_come(spark):
    store = ld.LineRuns(spark, buckets=3)
    one = spark.createDataFrame([(1, "a line that is long enough\nfirst batch has this one too")], "doc_id bigint, text string")
    two = spark.createDataFrame([(2, "A LINE that is long enough \nsomething that is wholly new"), (3, "short\nfirst batch has this one too")], "doc_id bigint, text string")
    assert store.add_new(one).collect() == one.collect()
    assert sorted((r.doc_id, r.text) for r in store.add_new(two).collect()) == [(2, "something that is wholly new"), (3, "short")]
    assert store.add_new(two).select("text").collect()[0].text in ("", "short")
