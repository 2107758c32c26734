"""Approximate nearest neighbours with shifted space-filling curves.

Every vector is normalised and projected to DIMS directions of a random rotation, one per curve; each projection is turned into its
rank among a bounded sample (so that dense regions get as much of the range as they hold rows), shifted, and the cells get their
number on a Hilbert curve. The curves' orders are cut into ranges of keys, and Spark deals vectors and queries to the ranges.
A query's window on a curve is a range of keys around its own; it goes to all ranges that its window touches, is compared with the
vectors inside, and the best of all curves are merged and reranked with the exact cosine.

The window's width is measured, not guessed: for a bounded sample of the queries the true neighbours are found by brute force,
and the window is made so wide that on some curve it holds the share TARGET of them. Data without structure need wide windows; on
clustered data they are narrow. Equal vectors are merged before, with the smallest ids that can matter, so a vector that a third of
all rows share is indexed once.

Edge cases: vectors that are null, zero, of another length than most, or with null or non-finite parts take no part; a query has
fewer rows if there are fewer other vectors; rows that repeat a vec_id count as that id's own and never as its neighbours; a null
vec_id takes no part; ties go to the smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packsmith.session import stored

CURVES, DIMS, BITS, TIE_BITS = 16, 8, 7, 6
#: What a key may lose as a number of double precision, at most.
ROUNDING = 1024
NEIGHBOURS, QUERY_STEP = 5, 50
#: Rows of the sample that fits ranks and ranges, and queries whose neighbours are found by brute force.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 256
TARGET = 0.95
RANGE_ROWS, QUERIES_AT_ONCE = 50_000, 64
SEED = 7
RESULT_SCHEMA = "query_id bigint, vec_id bigint, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points with whole coordinates below 2**bits (rows x dimensions).

    Walks from the coarsest bit to the finest: each level's corner is taken relative to the orientation that the levels above left.
    """
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for k in range(dims):
            set_ = (x[k] & bit) != 0
            swap = np.where(set_, np.uint32(0), (x[0] ^ x[k]) & below)
            x[0] = np.where(set_, x[0] ^ below, x[0] ^ swap)
            x[k] ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    flips = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flips
    keys = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            keys = (keys << 1) | ((x[k] >> np.uint32(level)) & np.uint32(1))
    return keys


class Curves:
    """The curves, fitted to a sample of vectors: from a vector to its key on each of them."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.curves, self.dims = curves, min(DIMS, dim)
        self.rotations = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : self.dims] for _ in range(curves)]
        self.shifts = rng.random((curves, self.dims)) * 0.25
        unit = _unit(sample)
        self.ranks = [np.sort(unit @ r, axis=0) for r in self.rotations]
        self.keys = np.stack([np.sort(k) for k in self.of(sample)])
        self.knots = []
        for own in self.keys:
            keys, first = np.unique(own, return_index=True)
            self.knots.append((np.r_[-1.0, keys, 2.0**62], np.r_[0.0, (first + 0.5) / len(own), 1.0]))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The key of each vector on each curve (curves x vectors): the cell's place, then a hash that parts a cell."""
        unit, out = _unit(vectors), []
        tie = (np.ascontiguousarray(unit[:, 0]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)
        for rotation, shift, ranks in zip(self.rotations, self.shifts, self.ranks, strict=True):
            y = unit @ rotation
            place = np.stack([np.searchsorted(ranks[:, k], y[:, k]) / len(ranks) for k in range(self.dims)], axis=1)
            cells = ((place * 0.75 + shift) * ((1 << BITS) - 1)).astype(np.uint32)
            out.append((hilbert_keys(cells, BITS) << TIE_BITS) | tie.astype(np.int64))
        return np.stack(out)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The share of the sample before each key; between two keys of the sample in proportion, so that it tells apart more places than
        the sample has, however many rows there are."""
        return np.stack([np.interp(k.astype(np.float64), *own) for own, k in zip(self.knots, keys, strict=True)])

    def window(self, keys: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest key of the windows around keys that reach the given share of the sample to either side."""
        low, high, at = np.empty_like(keys), np.empty_like(keys), self.places(keys)
        for c, (knots, ranks) in enumerate(self.knots):
            below, above = (np.clip(np.interp(x, ranks, knots), 0, 2.0**62) for x in (at[c] - reach, at[c] + reach))
            low[c] = np.where(at[c] - reach > 0, np.minimum(below.astype(np.int64) - ROUNDING, keys[c]), np.iinfo(np.int64).min)
            high[c] = np.where(at[c] + reach < 1, np.maximum(above.astype(np.int64) + ROUNDING, keys[c]), np.iinfo(np.int64).max)
        return low, high


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two that brings the largest part below 1: an exact step, by which no square is too large or small."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of rows of a and b in double precision, the same for a pair wherever it is computed."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, each (id, vector) once."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    return rows


def best_pairs(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float]]:
    """For each query the k nearest ids among vectors that several ids may share: (query, id, score), ties to smaller ids."""
    out = []
    rough = _unit(queries) @ _unit(vectors).T
    for row in range(len(queries)):
        own = rough[row]
        # One more than k, as the query itself may be among them, and whatever rounding may bring up.
        if len(own) > k + 1:
            bar = np.partition(own, len(own) - k - 1)[len(own) - k - 1]
            near = np.flatnonzero(own >= bar - 1e-12)
        else:
            near = np.arange(len(own))
        exact = cosine(np.broadcast_to(queries[row], (len(near), queries.shape[1])), vectors[near])
        found = sorted((-s, i) for s, n in zip(exact.tolist(), near.tolist(), strict=True) for i in ids[n] if i != query_ids[row])
        out += [(row, i, -s) for s, i in found[:k]]
    return out


def _brute(queries: np.ndarray, query_ids: np.ndarray, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                vectors, ids = _vectors(part.column("v")), part.column("ids").to_pylist()
                where = {i: n for n, own in enumerate(ids) for i in own}
                found = best_pairs(queries, query_ids, vectors, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _, _ in found], pa.int64()), pa.array([i for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64()), pa.array([vectors[where[i]] for _, i, _ in found], pa.list_(pa.float64()))], names=["q", "vec_id", "score", "v"])

    return rows


def _reach(curves: Curves, groups: DataFrame, queries: DataFrame, k: int, target: float) -> float:
    """How far windows must reach so that the target share of the sampled queries' true neighbours is inside on some curve."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    vectors, ids = np.array([r.v for r in sample]), np.array([r.vec_id for r in sample])
    pairs = groups.mapInArrow(_brute(vectors, ids, k), "q bigint, vec_id bigint, score double, v array<double>")
    ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k).select("q", "v").collect()
    if not ranked:
        return 0.0
    own, other = curves.places(curves.of(vectors)), curves.places(curves.of(np.array([r.v for r in ranked])))
    gaps = np.abs(own[:, [r.q for r in ranked]] - other).min(axis=0)
    return float(np.quantile(gaps, target, method="higher"))


def nearest(table: DataFrame, step: int = QUERY_STEP, k: int = NEIGHBOURS, curves: int = CURVES, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest other rows of each row whose id is divisible by step: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    rows = usable(table, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not sizes:
        return empty
    rows = rows.where(F.size("v") == sizes[0]["dim"])
    # The smallest k + 1 ids of equal vectors are all that any query can be given; the limit by rank is applied before the shuffle.
    order = Window.partitionBy("v").orderBy("vec_id")
    least = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    groups = stored(least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    queries = stored(rows.where(F.pmod("vec_id", F.lit(step)) == 0).distinct(), "queries")
    n = groups.count()
    if not queries.limit(1).count():
        return empty
    share = min(1.0, SAMPLE_ROWS / n)
    sampled = groups if share == 1.0 else groups.where(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(1 << 30)) < int(share * (1 << 30)))
    fitted = Curves(np.array([r.v for r in sampled.select("v").limit(2 * SAMPLE_ROWS).collect()]), curves)
    reach = _reach(fitted, groups, queries, k, target)
    parts = max(-(-n // RANGE_ROWS), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // curves))
    held = spark.sparkContext.broadcast((fitted, reach, _cuts(fitted, parts)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, cuts = held.value
        for batch in batches:
            keys = own.of(_vectors(batch.column("v"))) if batch.num_rows else np.zeros((curves, 0), np.int64)
            for c in range(curves):
                part = c * parts + np.searchsorted(cuts[c], keys[c], side="right")
                yield _dealt(part, 0, keys[c], keys[c], batch.column("ids"), batch.column("v"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reach, cuts = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high = own.window(own.of(_vectors(batch.column("v"))), reach)
            ids = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1), pa.int32()), batch.column("vec_id"))
            for c in range(curves):
                first, last = np.searchsorted(cuts[c], low[c], side="right"), np.searchsorted(cuts[c], high[c], side="right")
                n = last - first + 1
                row = np.repeat(np.arange(batch.num_rows), n)
                part = c * parts + first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = pa.array(row)
                yield _dealt(part, 1, low[c][row], high[c][row], ids.take(at), batch.column("v").take(at))

    schema = "part int, role int, low bigint, high bigint, ids array<bigint>, v array<double>"
    spread = groups.mapInArrow(vectors, schema).unionByName(queries.mapInArrow(asked, schema))
    dealt = spread.repartitionById(parts * curves, F.col("part")).sortWithinPartitions("part", "role")
    found = dealt.mapInArrow(_compare(k), RESULT_SCHEMA).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cuts(curves: Curves, parts: int) -> np.ndarray:
    """The keys that part each curve into ranges with about as many rows."""
    n = curves.keys.shape[1]
    return np.stack([own[(np.arange(1, parts) * n) // parts] for own in curves.keys])


def _dealt(part: np.ndarray, role: int, low: np.ndarray, high: np.ndarray, ids: pa.Array, v: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(part), role), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), ids, v], names=["part", "role", "low", "high", "ids", "v"])


def _compare(k: int):
    """For each part its vectors come first, then the queries; queries are compared with the vectors in their windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready = None, [], None

        def index() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
            keys, vectors = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            ids = [i for h in held for i in h[2]]
            order = np.argsort(keys, kind="stable")
            vectors = vectors[order]
            return keys[order], vectors, _unit(vectors).astype(np.float32), [ids[n] for n in order.tolist()]

        for batch in batches:
            cut = np.flatnonzero(np.diff(batch.column("part").to_numpy() * 2 + batch.column("role").to_numpy())) + 1
            for start, stop in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                own = batch.slice(start, stop - start)
                if not own.num_rows:
                    continue
                if (here := own.column("part")[0].as_py()) != part:
                    part, held, ready = here, [], None
                if own.column("role")[0].as_py() == 0:
                    held.append((own.column("low").to_numpy(), _vectors(own.column("v")), own.column("ids").to_pylist()))
                elif held:
                    ready = ready or index()
                    yield _answers(own, *ready, k)

    return rows


def _answers(asked: pa.RecordBatch, keys: np.ndarray, vectors: np.ndarray, unit: np.ndarray, ids: list[list[int]], k: int) -> pa.RecordBatch:
    """The best of each query's window. Neighbouring queries have much of their windows in common, so these are multiplied at once, in
    single precision; what may be among the best for all its rounding is then compared exactly."""
    queries, query_ids = _vectors(asked.column("v")), np.array([i[0] for i in asked.column("ids").to_pylist()])
    first = np.searchsorted(keys, asked.column("low").to_numpy(), side="left")
    last = np.searchsorted(keys, asked.column("high").to_numpy(), side="right")
    slack, rough = np.float32(1e-5 + 1e-6 * vectors.shape[1]), _unit(queries).astype(np.float32)
    some = np.flatnonzero(last > first)
    some, out = some[np.argsort(first[some], kind="stable")], []
    for start in range(0, len(some), QUERIES_AT_ONCE):
        rows = some[start : start + QUERIES_AT_ONCE]
        base, end = first[rows].min(), last[rows].max()
        scores = rough[rows] @ unit[base:end].T
        for place, row in enumerate(rows.tolist()):
            a, own = first[row], scores[place, first[row] - base : last[row] - base]
            # One more than k, as the query itself may be among them.
            near = np.flatnonzero(own >= np.partition(own, len(own) - k - 1)[len(own) - k - 1] - slack) if len(own) > k + 1 else np.arange(len(own))
            out += [(query_ids[row], i, s) for _, i, s in best_pairs(queries[row : row + 1], query_ids[row : row + 1], vectors[a + near], [ids[n] for n in (a + near).tolist()], k)]
    return pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
