"""Nearest neighbours: recall and exact scores against brute force."""

import numpy as np
import pytest

from packsmith.llm import ann
from packsmith.session import table


def brute(rows, k=5, step=50):
    """{query_id: [(vec_id, score)]} over usable rows."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, np.float64)).all() and np.any(np.array(v, np.float64))]
    out = {}
    for i, q in good:
        if i % step == 0:
            found = sorted({(-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for j, v in good if j != i})
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    frame = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    got, want = found(ann.nearest(frame)), brute(rows)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want) / (5 * len(want)) >= 0.9
    exact = {i: np.array(v, np.float64) for i, v in rows}
    for i, own in got.items():
        for j, score in own:
            a, b = exact[i], exact[j]
            assert abs(score - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())) < 1e-12
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_clusters_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.05 * rng.standard_normal(16)]) for i in range(2000)]
    hot = [float(x) for x in rng.standard_normal(16)]
    rows += [(2000 + i, hot) for i in range(1000)]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, score double")
    rows = [(r.vec_id, r.embedding) for r in frame.select("vec_id", "embedding").collect()]
    got, want = found(ann.nearest(frame)), brute(rows)
    assert got.keys() == want.keys()
    for i in want:
        if i >= 2000:
            assert [j for j, _ in got[i]] == [j for j in range(2000, 2010) if j != i][:5]
    share = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want) / sum(map(len, want.values()))
    assert share >= 0.9


def test_edge_cases(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 0.0, 0.0], 1), (50, [0.0, 2.0], 1), (50, [0.0, 2.0], 1), (None, [1.0, 1.0], 1), (8, [], 1), (9, [-3.0, 0.0], None)]
    got = found(ann.nearest(spark.createDataFrame(rows, schema)))
    assert got == {0: [(1, 1.0), (50, 0.0), (9, -1.0)], 50: [(0, 0.0), (1, 0.0), (9, 0.0)]}
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:1], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], schema)).count() == 0


def test_extreme_magnitudes(spark):
    """Parts whose squares overflow or underflow give the true cosine."""
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2e200]), (2, [3e-200, 0.0]), (3, [1e308, 1e308]), (4, [5e-324, 5e-324]), (50, [0.0, 1e-310])]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")))
    half = 1 / np.sqrt(2)
    want = {0: {1: 1 / np.sqrt(5), 2: 1.0, 3: half, 4: half, 50: 0.0}, 50: {0: 0.0, 1: 2 / np.sqrt(5), 2: 0.0, 3: half, 4: half}}
    assert got.keys() == want.keys()
    for query, own in got.items():
        assert {j for j, _ in own} == set(want[query])
        assert all(abs(score - want[query][j]) < 1e-12 for j, score in own)


def test_scaling_changes_no_score():
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((200, 24)) * 10.0 ** rng.integers(-20, 20, (200, 1)), rng.standard_normal((200, 24))
    plain = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    assert (ann.cosine(a, b) == plain).all()


def test_hilbert_curve_visits_neighbours():
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
