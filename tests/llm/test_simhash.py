"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from packsmith.llm import simhash
from packsmith.llm.components import connected_components, forest


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps):
    """{doc_id: fp} -> {doc_id: smallest reachable doc_id}."""
    ids, parent = sorted(fps), {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_query_against_brute_force(spark):
    import pyarrow.parquet as pq

    from packsmith.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    comps = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", comps[i]) for i in texts}


def test_all_distances(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.append(x)
        for d in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            fps.append(y)
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    table = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()}
    assert got == plain_components(dict(enumerate(fps)))


def test_many_small_buckets_and_forests(spark):
    """Buckets and tasks that follow from the number of fingerprints, and forests that are passed on in parts."""
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(3)]
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp bigint")
    links = simhash.link_forest(table, bucket_variants=4, task_links=1)
    assert links.rdd.getNumPartitions() > 8
    roots = {r.node: r.root for r in connected_components(links).collect()}
    as_int = lambda f: int(np.uint64(f).view(np.int64))
    got = {f: roots.get(as_int(f), as_int(f)) for f in set(fps)}
    want = plain_components({f: f for f in set(fps)})
    groups = lambda by: sorted(sorted(k for k in by if by[k] == v) for v in set(by.values()))
    assert groups(got) == groups(want)


def test_kept_rows(spark):
    """Repeated ids with other texts, rows repeated exactly, null ids, columns with names used inside; with and without broadcasts."""
    text = {k: " ".join(f"word{k}x{j}" for j in range(40)) for k in range(6)}
    rows = [(1, text[0]), (1, text[1]), (2, text[0]), (1, text[1]), (3, text[2]), (3, text[2]), (None, text[3]), (None, text[3]), (None, text[0]), (4, None), (5, ""), (6, text[4])]
    docs = spark.createDataFrame([(i, t, k, 0, 0) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, keep_id int, __own int, __key int")
    for most in (1000, 0):
        got = simhash.keep_one(docs, most=most)
        assert got.columns == docs.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t in [(1, text[0]), (1, text[1]), (3, text[2]), (None, text[3]), (4, None), (6, text[4])])
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_edge_cases(spark):
    long = "alpha beta " * 50_000
    rows = [(1, None, "x"), (2, "", "y"), (3, "  \n\t", None), (4, "One two THREE four", "a"), (4, "One two THREE four", "b"), (None, "one two three four", "c"), (6, "word", None), (7, long, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect())
    by_id = {(none, i): (f, c) for none, i, f, c in got}
    assert len(got) == 8
    assert by_id[False, 1] == by_id[False, 2] == by_id[False, 3] == ("0" * 16, 1)
    assert by_id[True, 0] == by_id[False, 4]
    assert by_id[False, 7][0] == f"{plain_fingerprint(long):016x}"
    kept = simhash.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "6", "7"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "component_id"}
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(2000, 2500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{i: 1000 for i in range(2000, 2500)}}


@pytest.mark.parametrize("seed", range(3))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 80, 60), rng.integers(0, 80, 60)
    keep = a != b
    nodes, roots = forest(a[keep], b[keep])
    graph = {}
    for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
        graph.setdefault(x, set()).add(y)
        graph.setdefault(y, set()).add(x)
    for node, root in zip(nodes.tolist(), roots.tolist(), strict=True):
        seen, todo = {node}, [node]
        while todo:
            for y in graph[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert root == min(seen)
