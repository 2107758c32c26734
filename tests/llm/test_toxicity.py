"""Positive-unlabelled toxicity: held-out accuracy, the risk's edge cases, and the hold-out."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from packsmith.llm import arrays
from packsmith.llm import toxicity as tx
from packsmith.session import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = tx.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    y, p, s = (np.array([r[k] for r in rows]) for k in ("toxic", "predicted", "score"))
    assert len(rows) > 500 and set(p.tolist()) == {0, 1}
    assert (p[y == 1] == 1).mean() > 0.85
    assert (y[p == 1] == 1).mean() > 0.8
    pairs = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert pairs > 0.95
    assert ((p == 1) == (s >= 0.5)).all() and (s >= 0).all() and (s <= 1).all()


def test_held_out_rows_teach_nothing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    other = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - toxic, toxic) as toxic")
    key = lambda r: (r.doc_id, round(r.score, 9))
    assert sorted(map(key, tx.score(docs, other).collect())) == sorted(map(key, tx.score(docs, labels).collect()))


def test_planted_words_are_learned():
    rng = random.Random(1)
    words = [f"word{k}" for k in range(400)]

    def text(toxic):
        own = rng.choices(words, k=60)
        return " ".join(own + rng.sample(["vile", "awful", "rotten", "nasty"], 2) if toxic else own)

    rows = []
    for k in range(2500):
        toxic = k < 250
        own = toxic or rng.random() < 0.1
        at, values, _ = tx.features(pa.array([text(own)]))
        rows.append((at, values, toxic))
    n_toxic = sum(t for *_, t in rows)
    seen = {side: np.zeros(1 << tx.DIM_BITS, np.int64) for side in (True, False)}
    for at, _, toxic in rows:
        seen[toxic][at] += 1
    chosen = tx.telling(seen[True], n_toxic, seen[False], len(rows) - n_toxic)
    chosen[0] = True
    chosen = np.flatnonzero(chosen)
    model = tx.Classifier.of(chosen, tx.fit([(np.searchsorted(chosen, at[own]), values[own], toxic) for at, values, toxic in rows for own in [np.isin(at, chosen)]], len(chosen), 0.1))
    good, bad = model.scores(pa.array([text(False) for _ in range(200)])), model.scores(pa.array([text(True) for _ in range(200)]))
    assert (bad >= 0.5).mean() > 0.97 and (good < 0.5).mean() > 0.97


def small_rows():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        at = np.sort(rng.choice(6, rng.integers(1, 5), replace=False))
        rows.append((at, rng.random(len(at)) * 2 + (k < 8), k < 8))
    return rows


def plain_risks(rows, theta, prior):
    """Both risks, row by row."""
    loss = {True: [], False: [], "toxic as clean": []}
    for at, values, toxic in rows:
        m = theta[-1] + sum(theta[a] * v for a, v in zip(at.tolist(), values.tolist(), strict=True))
        if toxic:
            loss[True].append(math.log1p(math.exp(-m)))
            loss["toxic as clean"].append(math.log1p(math.exp(m)))
        else:
            loss[False].append(math.log1p(math.exp(m)))
    mean = lambda x: sum(x) / len(x)
    return prior * mean(loss[True]), mean(loss[False]) - prior * mean(loss["toxic as clean"])


def plain_gradients(rows, theta, prior, step=1e-6):
    """Finite differences of both risks."""
    out = []
    for k in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[k] += step
        down[k] -= step
        out.append([(a - b) / (2 * step) for a, b in zip(plain_risks(rows, up, prior), plain_risks(rows, down, prior), strict=True)])
    return np.array(out).T


def test_risks_and_gradients_against_brute_force():
    rows, rng = small_rows(), np.random.default_rng(4)
    for prior in (0.05, 0.3, 0.5):
        training = tx.Training(rows, 6, prior)
        for _ in range(5):
            theta = rng.normal(size=7)
            assert np.allclose(training.risks(theta), plain_risks(rows, theta, prior), rtol=0, atol=1e-12)
            assert np.allclose(training.gradients(theta), plain_gradients(rows, theta, prior), rtol=0, atol=1e-7)


def test_training_against_brute_force():
    """Adam by finite differences, with the step against an overfit where the other class's risk is below zero."""
    rows, prior = small_rows(), 0.5
    theta = np.zeros(7)
    first, second, undone = np.zeros(7), np.zeros(7), 0
    for step in range(1, 61):
        on_toxic, on_rest = plain_gradients(rows, theta, prior)
        below = plain_risks(rows, theta, prior)[1] < 0
        undone += below
        move = -on_rest if below else on_toxic + on_rest
        move[:-1] += tx.DECAY * theta[:-1] / len(rows) ** 0.5
        first, second = 0.9 * first + 0.1 * move, 0.999 * second + 0.001 * move * move
        theta = theta - 0.5 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    assert undone > 0
    assert np.allclose(tx.fit(rows, 6, prior, steps=60, rate=0.5), theta, rtol=0, atol=1e-4)


def test_scores_against_brute_force():
    """Whole texts, word by word."""
    rng = np.random.default_rng(5)
    model = tx.Classifier(rng.normal(size=1 << tx.DIM_BITS) * 0.2, -0.3)
    texts = ["Some words, and Some more words; wonderfully extraordinary", "", None, "a " * 300, "Ünïcode wörter 中文 ÜNÏCODE", "x1 y2 z3 " * 5]

    def plain(text):
        found = Counter()
        for word in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            raw = bytes(b + 32 if 65 <= b <= 90 else b for b in word.encode())
            one = lambda x: int(arrays.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
            found[0] += 1
            found[one(raw) >> (64 - tx.DIM_BITS)] += 1
            for size in tx.STEMS:
                if len(raw) > size:
                    found[((one(raw[:size]) * int(tx.STEM_SALT)) % (1 << 64)) >> (64 - tx.DIM_BITS)] += 1
        margin = model.bias + sum(model.weights[at] * math.log2(1 + n) for at, n in found.items())
        return 1 / (1 + math.exp(-margin))

    assert np.allclose(model.scores(pa.array(texts)), [plain(t) for t in texts], rtol=0, atol=1e-9)


def test_edge_cases(spark):
    rows = [(k, f"vile rotten text here {k}" if k % 4 == 0 else f"plain words only number {k} again", "x") for k in range(1, 200)] + [(300, None, "x"), (301, "", "x"), (None, "vile", "x"), (302, "good " * 50_000, "x"), (5, "plain", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, 1, 1 if k % 4 == 0 else 0) for k in range(1, 150)] + [(1, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = tx.score(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[4].predicted == 1 and by[302].predicted == 0 and by[300].score == by[301].score < 0.5 and by[None].held_out is False
    assert {r.score for r in tx.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert tx.score(docs.limit(0), labels).count() == 0
    assert tx.score(docs, labels.limit(0)).count() == len(rows)
