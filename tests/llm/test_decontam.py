"""Decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from packsmith.llm import arrays
from packsmith.llm import decontam as dc


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items, window=13):
    own, hit, names = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for g in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else ():
            for at in range(len(own) - k + 1):
                if tuple(own[at : at + k]) == g:
                    hit.update(range(at, at + k))
                    names.add("" if item is None else str(item))
    joined = ",".join(sorted(names))
    return len(own), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)


def corpus():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)] + ["é", "中文", "The", "X1"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(1, 40)))) for k in range(25)] + [(100, "Short item"), (101, ""), (102, None), (103, "a " * 30), (104, "the the the the"), (None, "null id item"), (7, "second text of item seven")]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choices(vocab, k=rng.randint(0, 30))))
            if rng.random() < 0.5:
                w = (rng.choice(items)[1] or "").split()
                a = rng.randint(0, max(0, len(w) - 13))
                parts.append(rng.choice([" ", ", ", "\n"]).join(w[a : a + rng.choice([12, 13, 20, 40])]).upper())
        docs.append((k, " ".join(parts)))
    docs += [(None, items[0][1]), (200, None), (201, ""), (202, "a " * 20_000), (203, "the THE the, the; the"), (5, items[3][1]), (5, items[3][1]), (300, "short"), (301, "item short item"), (302, "x null id item y second text of item seven")]
    return docs, items


def check(spark, docs, items, **kw):
    table = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id bigint, text string, n_words int").repartition(3)
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, n_hit int")
    got = dc.contamination(dc.build_index(table), bench, **kw).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *plain(t, items))) for i, t in docs)


def test_against_brute_force(spark):
    docs, items = corpus()
    check(spark, docs, items)


def test_several_blocks(spark):
    docs, items = corpus()
    check(spark, docs, items, block_words=60)


def test_small_segments_and_chunks(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(dc, "CHUNK", 5)
    index = dc.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    rows = index.collect()
    (block,) = dc.query_blocks(spark.createDataFrame(items, "item_id bigint, text string"))
    got = []
    for r in rows:
        n = np.array(r.n_words)
        flags, ends, names = dc._matches(dc.Segment(r.terms, r.counts, r.postings, n), block)
        got += list(zip(r.doc_ids, n.tolist(), dc._hits(flags, ends).tolist(), map(len, names), strict=True))
    assert sorted(map(str, got)) == sorted(str((i, *plain(t, items)[:3])) for i, t in docs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert dc.contamination(dc.build_index(none), bench).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    (row,) = dc.contamination(dc.build_index(one), bench.limit(0)).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert dc.decontaminate(one, bench).count() == 0 and dc.decontaminate(one, bench.limit(0)).count() == 1


def shortest(text, item, reach):
    """The shortest stretch of text with all words of the item: (width, position), by brute force."""
    own, want = words(text), set(words(item))
    found = [(w, p) for p in range(len(own)) for w in range(1, reach + 1) if p + w <= len(own) and want and want <= set(own[p : p + w])]
    return min(found, default=None)


def test_proximity_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(12)] + ["É", "Zed"]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for k in range(80)] + [(None, "v1 v2 v3"), (90, None), (91, ""), (92, "v1 " * 3000 + "v2"), (93, "v1 v2"), (93, "v1 v2")]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(1, 4)))) for k in range(12)] + [(50, "nowhere v1"), (51, ""), (52, None), (None, "v2 v1")]
    index = dc.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for reach in (1, 3, 10):
        want = sorted(str((i, None if j is None else str(j), best[1], best[0])) for i, t in docs for j, q in items for best in [shortest(t, q, reach)] if best)
        for block_words in (5, 1000):
            assert sorted(str(tuple(r)) for r in dc.proximity(index, bench, reach, block_words).collect()) == want
    assert dc.proximity(index, bench.limit(0), 5).count() == 0


def thue_morse(size, a="a", b="b"):
    """Two words of a length that is a power of two, one with the letters of the other swapped."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join((a, b)[k] for k in bits), "".join((b, a)[k] for k in bits)


def test_words_with_equal_hashes_are_told_apart(spark):
    """These words share the fast hash, whatever its odd base."""
    one, other = thue_morse(2048)
    column = pa.array([f"{one} {other} {one}"])
    data, offsets = dc.text_bytes(column)
    starts, ends = dc.runs(data, offsets, dc.ALNUM)
    assert len(set(arrays.span_hashes(data, starts, ends).tolist())) == 1
    docs = [(1, one), (2, other), (3, f"{other} {one} {other}"), (4, thue_morse(1024)[0])]
    check(spark, docs, [(1, one), (2, thue_morse(1024)[1])])


def test_grouped_spans_against_brute_force():
    rng = random.Random(5)
    pool = [*thue_morse(1024), *thue_morse(2048), "", "x", "y" * 9, "y" * 8, "z" * 100, "z" * 99 + "w", "ab", "ba"]
    text = [rng.choice(pool).encode() for _ in range(300)]
    data, ends = np.frombuffer(b"".join(text), np.uint8), np.cumsum([len(t) for t in text])
    order, first, _ = arrays.grouped_spans(data, ends - np.array([len(t) for t in text]), ends)
    groups = [order[a:b].tolist() for a, b in zip(first, np.r_[first[1:], len(order)])]
    want = {}
    for k, t in enumerate(text):
        want.setdefault(t, []).append(k)
    assert sorted(groups) == sorted(want.values())


def test_decontaminate_goes_by_row(spark):
    """Any occurrence is a leak; null and repeated ids, a long clean rest and columns with names used inside change nothing."""
    leak, clean = "one two three four five six seven eight nine ten eleven twelve thirteen", "clean text with nothing"
    rows = [(None, leak, 1), (None, clean, 2), (5, leak, 3), (5, clean, 4), (6, leak + " x" * 5000, 5), (7, None, 6), (8, "", 7), (5, clean, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __id int").withColumns({"__key": dc.F.lit(1), "__gone": dc.F.lit(2)})
    bench = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    got = dc.decontaminate(docs, bench)
    assert got.columns == docs.columns
    assert sorted(r["__id"] for r in got.collect()) == [2, 4, 6, 7, 8]
