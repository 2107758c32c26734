"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and stems is trained in numpy from confirmed toxic documents and unlabelled text. Its
risk is that of an ordinary classifier, written without negative examples: with the class prior p, the loss of calling
unlabelled text toxic less p times that of calling toxic text so stands for the negatives. That difference cannot truly be below zero;
where a step would push it there, the step undoes the overfit instead (Kiryo et al., 2017). The prior is the share of toxic rows
among the labels, all of which are counted.

Training takes about POSITIVES toxic and UNLABELLED other documents by hash of the id, whole texts each; exact copies count
once. Their features are counted in Spark, and only the values of the telling ones come to the driver. Every document is scored.

Edge cases: a null or empty text has no words and gets the score of the bias alone; labels that are null teach nothing; without
a toxic example every score is 0; a null doc_id is not learned from and not held out; repeated rows are scored row by row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsmith.llm.arrays import ALNUM, LOWER, U64, bounded, per_row, runs, span_hashes, text_bytes
from packsmith.llm.texts import text_key
from packsmith.session import stored

DIM_BITS = 20
#: Bytes of a word's beginning that are features besides the word.
STEMS, STEM_SALT = (5, 6, 7, 8), U64(0xD6E8FEB86659FD93)
POSITIVES, UNLABELLED = 4_000, 12_000
PIECE_BYTES = 4 << 20
STEPS, RATE, DECAY = 200, 0.1, 1e-3
#: A word is a feature if so many toxic examples have it and its likelihood ratio against equal shares is at least this.
LEAST_TEXTS, LEAST_RATIO = 3, 25.0
RESULT_SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features of each row, their values, and how many each row has.

    Features are hashed words and the first bytes of longer words, which stand for stems; a value grows with the logarithm of the
    number of occurrences in the row.
    """
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends = runs(data, offsets, ALNUM)
    row = np.repeat(np.arange(len(column), dtype=np.uint64), per_row(starts, offsets))
    # Feature 0 is the row's length, in words.
    pairs = [row << U64(DIM_BITS), (row << U64(DIM_BITS)) | (span_hashes(data, starts, ends) >> U64(64 - DIM_BITS))]
    for size in STEMS:
        long = ends - starts > size
        hashes = span_hashes(data, starts[long], starts[long] + size) * STEM_SALT
        pairs.append((row[long] << U64(DIM_BITS)) | (hashes >> U64(64 - DIM_BITS)))
    found = np.sort(np.concatenate(pairs))
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
    n = np.diff(np.r_[first, len(found)])
    found = found[first]
    return (found & U64((1 << DIM_BITS) - 1)).astype(np.int64), np.log2(1.0 + n), np.bincount((found >> U64(DIM_BITS)).astype(np.int64), minlength=len(column))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(counts)), counts), weights=values, minlength=len(counts))


class Classifier:
    """Weights over hashed words, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    @classmethod
    def of(cls, chosen: np.ndarray, theta: np.ndarray) -> Classifier:
        weights = np.zeros(1 << DIM_BITS)
        weights[chosen] = theta[:-1]
        return cls(weights, float(theta[-1]))

    def scores(self, column: pa.Array) -> np.ndarray:
        at, values, counts = features(column)
        margin = _sums(self.weights[at] * values, counts) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def likelihood_ratio(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> np.ndarray:
    """G statistic of a of n_a texts against b of n_b texts."""
    share = (a + b) / (n_a + n_b)

    def part(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (n * p)), 0.0) + np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - p))), 0.0)

    return 2 * (part(a, n_a, share) + part(b, n_b, share))


def telling(n_toxic: np.ndarray, all_toxic: int, n_rest: np.ndarray, all_rest: int) -> np.ndarray:
    """Whether a feature that n_toxic of the toxic and n_rest of the other texts have is one to learn."""
    return (n_toxic >= LEAST_TEXTS) & (likelihood_ratio(n_toxic, all_toxic, n_rest, all_rest) >= LEAST_RATIO)


class Training:
    """Rows of (places of features, values, is toxic), and the class prior."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, bool]], n_features: int, prior: float) -> None:
        self.toxic = np.array([t for _, _, t in rows], bool)
        self.row = np.repeat(np.arange(len(rows)), [len(x) for x, _, _ in rows])
        self.at, self.values = np.concatenate([x for x, _, _ in rows]), np.concatenate([v for _, v, _ in rows]).astype(np.float64)
        self.n_features, self.prior = n_features, min(max(prior, 1e-4), 0.5)

    def margins(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=theta[self.at] * self.values, minlength=len(self.toxic)) + theta[-1]

    def risks(self, theta: np.ndarray) -> tuple[float, float]:
        """The risk on the toxic class, and that on the other one, which is estimated without examples of it."""
        margin = self.margins(theta)
        as_toxic, as_clean = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        return self.prior * as_toxic[self.toxic].mean(), as_clean[~self.toxic].mean() - self.prior * as_clean[self.toxic].mean()

    def gradients(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradients of both risks."""
        p = 1 / (1 + np.exp(-np.clip(self.margins(theta), -500, 500)))
        n_toxic, n_rest = self.toxic.sum(), (~self.toxic).sum()
        # d/dm log(1 + exp(m)) = p and d/dm log(1 + exp(-m)) = p - 1
        by_row = np.where(self.toxic, self.prior * (p - 1) / n_toxic, 0.0), np.where(self.toxic, -self.prior * p / n_toxic, p / n_rest)
        return tuple(np.r_[np.bincount(self.at, weights=x[self.row] * self.values, minlength=self.n_features), x.sum()] for x in by_row)


def fit(rows: list[tuple[np.ndarray, np.ndarray, bool]], n_features: int, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """The weights of the features and the bias that the non-negative risk gives, by Adam on all rows."""
    training = Training(rows, n_features, prior)
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(training.prior / (1 - training.prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        on_toxic, on_rest = training.gradients(theta)
        move = -on_rest if training.risks(theta)[1] < 0 else on_toxic + on_rest
        move[:-1] += decay * theta[:-1] / len(rows) ** 0.5
        first, second = 0.9 * first + 0.1 * move, 0.999 * second + 0.001 * move**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta


def _fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def _share(id_col: str, salt: str, share: float) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)) + (share >= 1)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier | None:
    """Fit from documents that are not held out (crc32 of doc_id mod 5 is 0: held out); None without a toxic example."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where((_fold("label_id") != 0) & F.col("toxic").isNotNull())
    n, n_toxic = known.agg(F.count("*"), F.sum(F.expr("if(toxic = 1, 1, 0)"))).first()
    if not n_toxic:
        return None
    # At most a little over `positives` ids: a share of them by hash.
    ids = known.where((F.col("toxic") == 1) & _share("label_id", "p", positives / n_toxic)).select("label_id").distinct().limit(2 * positives)
    open_ = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(_fold("doc_id") != 0)
    total = open_.select("doc_id").count()
    picked = open_.join(F.broadcast(ids), open_["doc_id"] == ids["label_id"], "left")
    toxic, rest = F.col("label_id").isNotNull(), _share("doc_id", "u", unlabelled / max(1, total))
    # A sampled text may stand on both sides; exact copies count once on each.
    sides = F.explode(F.filter(F.array(F.when(toxic, True), F.when(rest, False)), lambda x: x.isNotNull())).alias("own")
    picked = picked.where(toxic | rest).select(sides, text_key().alias("key"), "text").dropDuplicates(["own", "key"]).select("own", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", PIECE_BYTES):
            at, values, counts = features(batch.column("text"))
            at, values = (np.split(x, np.cumsum(counts)[:-1]) for x in (at.astype(np.uint32), values.astype(np.float16)))
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array([p.tobytes() for p in x], pa.binary()) for x in (at, values))], names=["own", "at", "value"])

    found = stored(picked.mapInArrow(rows, "own boolean, at binary, value binary"), "sampled")
    sizes = {r["own"]: r["count"] for r in found.groupBy("own").count().collect()}
    if len(sizes) < 2:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << DIM_BITS), np.int64)
        for batch in batches:
            for own, at in zip(batch.column("own").to_pylist(), batch.column("at").to_pylist(), strict=True):
                seen[int(own)][np.frombuffer(at, np.uint32)] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1][some]), pa.array(seen[0][some])], names=["at", "toxic", "rest"])

    # Features are counted where the rows are; the driver sees counts of those in enough toxic texts, then the chosen ones' values.
    counts = found.mapInArrow(counted, "at bigint, toxic bigint, rest bigint").groupBy("at").agg(F.sum("toxic").alias("toxic"), F.sum("rest").alias("rest"))
    counts = counts.where((F.col("toxic") >= LEAST_TEXTS) | (F.col("at") == 0)).toArrow()
    known, in_toxic, in_rest = (counts.column(c).to_numpy() for c in ("at", "toxic", "rest"))
    chosen = np.sort(known[(known == 0) | telling(in_toxic, sizes[True], in_rest, sizes[False])])
    held = docs.sparkSession.sparkContext.broadcast(chosen)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, value in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist(), strict=True):
                at, value = np.frombuffer(at, np.uint32), np.frombuffer(value, np.float16)
                own = np.isin(at, held.value)
                out.append((np.searchsorted(held.value, at[own]).astype(np.uint32).tobytes(), value[own].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array([x[k] for x in out], pa.binary()) for k in range(2))], names=["own", "at", "value"])

    # In a fixed order, so that sums do not depend on how the rows were dealt.
    sampled = found.mapInArrow(kept, "own boolean, at binary, value binary").orderBy("own", "at", "value").collect()
    theta = fit([(np.frombuffer(r["at"], np.uint32).astype(np.int64), np.frombuffer(r["value"], np.float16), r["own"]) for r in sampled], len(chosen), n_toxic / n)
    return Classifier.of(chosen, theta)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in bounded(batches, "text", PIECE_BYTES):
            scores = own.scores(batch.column("text")) if own else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array(scores >= 0.5).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "text")
    return chosen.mapInArrow(rows, RESULT_SCHEMA)
