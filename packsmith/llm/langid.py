"""Language identification with interpolated Kneser-Ney character models, one per language.

Texts become symbols: lower-case letters by code point, those from U+0800 on as two symbols each (the code point's upper and
lower part), and one symbol for any stretch of other characters; no two letters share symbols. Five symbols of 12 bits fill one
60-bit key. The counts of all 5-grams of all learnable documents are summed in Spark; orders four to one count the distinct
continuations. A model keeps for each order the sorted hashes of its grams with their interpolated probabilities, and of its contexts
with their back-off weights. Every gram counts: beyond BLOCK_GRAMS the grams are cut by their context, read backwards, into blocks of
about that many. A block holds the contexts of its range and all that they back off to, so its probabilities are those of the whole
model; the texts are read once per block, each adds up the grams of its range, and only one block is broadcast at a time.

A text goes to the language with the lowest cross-entropy per symbol. The score (the softmax of scaled cross-entropies) and the
rejection are calibrated on text that was not learned from: of the learnable documents those whose text's hash leaves 0 when divided
by FOLDS are measured under second models, which are fitted to the grams of all others. A text of at least MIN_SYMBOLS is rejected if
its best cross-entropy lies further above what all but a thousandth of that language's left-out documents have (to a 1,024th of a nat)
than that lies above their median. That thousandth is out of sight of fewer than 999 documents: their largest distance from the median
then stands for it in the proportion of normal quantiles. For a language with fewer than LEAST left-out documents all this is taken over
those of all languages, where that is more than its own; where all together are fewer, the limit is a uniform guess among the language's
own symbols.

Edge cases: text that is null, empty or without a letter is `und`, scored 0 and rejected, as is all text when nothing can be
learned; ties go to the first language by name; a null doc_id is not learned from and not held out; a language whose documents are
all left out is learned but takes no part in the calibration; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from packsmith.llm.arrays import U64, bounded, mixed
from packsmith.llm.texts import text_key, without_texts
from packsmith.session import stored

ORDER, BITS = 5, 12
MASKS = [(1 << (BITS * k)) - 1 for k in range(ORDER + 1)]
PIECE_BYTES = 2 << 20
#: Grams of all orders and languages in a block, and so in a broadcast.
BLOCK_GRAMS = 6_000_000
MIN_SYMBOLS = 20
#: One in so many learnable documents is left out of the models that calibrate, and so many of them make a limit of their own.
FOLDS, LEAST = 8, 20
#: Bins per nat of the histograms of entropies, and scales of the score that are tried.
BINS = 1024
SCALES = [2.0**k for k in range(-6, 3)]
UNKNOWN = "und"
TASK_ENTRIES = 1 << 21
#: Letters below WIDE are one symbol. Others have code points below 2**18: an upper part by units of 2**SPLIT, then a lower part.
WIDE, SPLIT = 2048, 10
UPPER, LOWER = WIDE, WIDE + (1 << (18 - SPLIT))
RESULT_SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after the other, and how many each has; 0 stands for a character that is no letter."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    wide = letter & (points >= WIDE)
    out = np.repeat(np.where(letter, np.where(wide, UPPER + (points >> SPLIT), points), 0).astype(np.uint16), 1 + wide)
    ends = np.cumsum(1 + wide)
    out[ends[wide] - 1] = LOWER + (points[wide] & ((1 << SPLIT) - 1))
    return out, np.diff(np.r_[0, ends][np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)])


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 5-gram that ends at each symbol of each row, the number of symbols of each row, and whether it has a letter."""
    own, sizes = symbols([(t or "").lower() for t in column.to_pylist()])
    row = np.repeat(np.arange(len(sizes)), sizes)
    before = np.r_[np.uint16(0), own[:-1]][: len(own)]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    keep = (own != 0) | (before != 0)
    own, row = own[keep], row[keep]
    counts = np.bincount(row, minlength=len(sizes))
    letters = np.bincount(row[own != 0], minlength=len(sizes)) > 0
    padded = np.zeros(len(own) + (ORDER - 1) * len(sizes), U64)
    place = np.arange(len(own)) + (ORDER - 1) * (row + 1)
    padded[place] = own
    keys = padded[place]
    for k in range(1, ORDER):
        keys |= padded[place - k] << U64(BITS * k)
    return keys, counts, letters


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _left_out() -> Column:
    """Whether a learnable row is left out of the models that calibrate; by its text, so that copies are not split."""
    return F.pmod(F.xxhash64(F.lit("left out"), F.col("text")), F.lit(FOLDS)) == 0


def count_grams(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, out, key, n) over all rows (lang, text): lang as its place in langs; out: whether the rows are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for part, parts in held.items():
                keys, n = _merged(parts)
                columns = [pa.array(np.full(len(keys), part // 2, np.int32)), pa.array(np.full(len(keys), part % 2, bool)), pa.array(keys.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "out", "key", "n"])
            held.clear()

        for batch in bounded(batches, "text", PIECE_BYTES):
            keys, counts, _ = grams(batch.column("text"))
            own = np.repeat(batch.column("part").to_numpy(), counts)
            for part in np.unique(own).tolist():
                mine = np.sort(keys[own == part])
                first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                held.setdefault(part, []).append((mine[first], np.diff(np.r_[first, len(mine)])))
                if len(held[part]) >= 8:
                    held[part] = [_merged(held[part])]
            if sum(len(k) for parts in held.values() for k, _ in parts) >= TASK_ENTRIES:
                yield from flush()
        yield from flush()

    places = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])
    docs = docs.select((2 * places[F.col("lang")] + _left_out().cast("int")).alias("part"), "text")
    return docs.mapInArrow(rows, "lang int, out boolean, key bigint, n bigint").groupBy("lang", "out", "key").agg(F.sum("n").alias("n"))


#: Contexts read backwards, from the symbol next to the gram's last, are below this.
ALL_CONTEXTS = 1 << (BITS * (ORDER - 1))


def backwards(keys: np.ndarray) -> np.ndarray:
    """The context of each 5-gram read backwards: what it backs off to is a prefix of it."""
    out = np.zeros(len(keys), U64)
    for k in range(1, ORDER):
        out |= ((keys >> U64(BITS * k)) & U64(MASKS[1])) << U64(BITS * (ORDER - 1 - k))
    return out


def _backwards(order: int):
    """The same of a column of grams of an order, filled up with zeros: the first of the 5-grams' contexts that it is a prefix of."""
    out = F.lit(0).cast("bigint")
    for k in range(1, order):
        out = out.bitwiseOR(F.shiftleft(F.shiftright("key", BITS * k).bitwiseAND(MASKS[1]), BITS * (ORDER - 1 - k)))
    return out


@dataclass
class Order:
    """One order of one language: sorted hashes of grams with probabilities, and of contexts with back-off weights."""

    grams: np.ndarray
    probs: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def _sorted_by_hash(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = mixed(keys)
    order = np.argsort(hashes)
    return hashes[order], values[order]


def lookup(hashes: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key, or default; and whether it is there."""
    wanted = mixed(keys)
    if not len(hashes):
        return np.full(len(keys), default), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    hit = hashes[at] == wanted
    return np.where(hit, values[at], default), hit


def probabilities(orders: list[Order], keys: np.ndarray) -> np.ndarray:
    """The interpolated probability of the last symbol of each 5-gram given the four before; only unknown grams back off."""
    if not orders:
        return np.full(len(keys), 1.0 / (1 << BITS))
    own = keys & U64(MASKS[len(orders)])
    found, hit = lookup(orders[-1].grams, orders[-1].probs, own, 0.0)
    rest = np.flatnonzero(~hit)
    if len(rest):
        weight, _ = lookup(orders[-1].contexts, orders[-1].weights, own[rest] >> U64(BITS), 1.0)
        found[rest] = weight * probabilities(orders[:-1], own[rest])
    return found


def fit_language(counts: list[tuple[np.ndarray, np.ndarray]], singles: list[tuple[int, int]]) -> list[Order]:
    """Interpolated Kneser-Ney from the grams and counts of orders 1 to 5, and how many grams count once and twice."""
    orders: list[Order] = []
    for (keys, n), (once, twice) in zip(counts, singles, strict=True):
        discount = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.1))
        contexts, back = np.unique(keys >> U64(BITS), return_inverse=True)
        totals = np.bincount(back, weights=n, minlength=len(contexts))
        weights = discount * np.bincount(back, minlength=len(contexts)) / totals
        order = Order(np.zeros(0, U64), np.zeros(0), *_sorted_by_hash(contexts, weights))
        lower = probabilities(orders, keys)
        probs = (n - discount) / totals[back] + weights[back] * lower
        order.grams, order.probs = _sorted_by_hash(keys, probs)
        orders.append(order)
    return orders


class Identifier:
    """The models of all languages, or a block of them, with calibration; small enough to broadcast."""

    def __init__(self, langs: list[str], models: list[list[Order]], low: int = 0, high: int = ALL_CONTEXTS) -> None:
        self.langs, self.models, self.low, self.high = langs, models, low, high
        self.scale, self.limits = 1.0, np.full(len(langs), np.inf)

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each row under each language, the rows' numbers of symbols, and whether they have letters.

        Of a block: the share of the grams in its range, so that the blocks' entropies add up.
        """
        keys, counts, letters = grams(column)
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.zeros((len(counts), len(self.langs)))
        some = np.flatnonzero(counts)
        first = (np.cumsum(counts) - counts)[some]
        context = backwards(distinct)
        own = np.flatnonzero((context >= U64(self.low)) & (context < U64(self.high)))
        for k, model in enumerate(self.models):
            if len(some):
                logs = np.zeros(len(distinct))
                logs[own] = np.log(probabilities(model, distinct[own]))
                out[some, k] = -np.add.reduceat(logs[back], first) / counts[some]
        return out, counts, letters

    def decide(self, entropies: np.ndarray, counts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each row (-1: none), its score, and whether it is rejected."""
        if not self.langs:
            return np.full(len(counts), -1), np.zeros(len(counts)), np.ones(len(counts), bool)
        best = np.where(letters, entropies.argmin(axis=1), -1)
        least = entropies.min(axis=1)
        score = 1 / np.exp(-(entropies - least[:, None]) * (self.scale * np.minimum(counts, 200))[:, None]).sum(axis=1)
        rejected = ~letters | ((counts >= MIN_SYMBOLS) & (least > self.limits[best]))
        return best, np.where(letters, score, 0.0), rejected


@dataclass
class Grams:
    """Stored tables (lang, key, n) of orders 1 to 5; of each order and language how many grams there are, and how many count once
    and twice; and where the blocks begin and end."""

    langs: list[str]
    tables: list[DataFrame]
    sizes: list[list[int]]
    singles: list[list[tuple[int, int]]]
    cuts: list[int]

    def block(self, b: int) -> Identifier:
        """The models of the contexts in a block, with all that these back off to."""
        low, high, counts = self.cuts[b], self.cuts[b + 1], []
        for order, table in enumerate(self.tables, 1):
            if len(self.cuts) > 2:
                begin, width = _backwards(order), 1 << (BITS * (ORDER - order))
                table = table.where((begin < high) & (begin + F.lit(width) > low))
            found = table.toArrow()
            lang, keys, n = (found.column(c).to_numpy() for c in ("lang", "key", "n"))
            counts.append([(keys[lang == k].view(U64), n[lang == k].astype(np.float64)) for k in range(len(self.langs))])
        return Identifier(self.langs, [fit_language([c[k] for c in counts], [s[k] for s in self.singles]) for k in range(len(self.langs))], low, high)


def _orders(highest: DataFrame, langs: list[str], block_grams: int) -> Grams:
    """The lower orders of a table of 5-grams, and the cuts into blocks."""
    tables, sizes, singles = [stored(highest, "grams")], [], []
    for k in range(ORDER - 1, 0, -1):
        lower = tables[0].groupBy("lang", F.col("key").bitwiseAND(MASKS[k]).alias("key")).agg(F.count("*").alias("n"))
        tables.insert(0, stored(lower, f"grams{k}"))
    for t in tables:
        found = t.groupBy("lang", F.least("n", F.lit(3)).alias("n")).count().collect()
        rare = {(r["lang"], r["n"]): r["count"] for r in found}
        singles.append([(rare.get((k, 1), 0), rare.get((k, 2), 0)) for k in range(len(langs))])
        sizes.append([sum(rare.get((k, n), 0) for n in (1, 2, 3)) for k in range(len(langs))])
    cuts, blocks = [], -(-sum(map(sum, sizes)) // block_grams)
    if blocks > 1:
        places = [t.select(_backwards(k).alias("at")) for k, t in enumerate(tables, 1)]
        shares = [k / blocks for k in range(1, blocks)]
        cuts = reduce(DataFrame.unionAll, places).agg(F.percentile_approx("at", shares, max(10_000, 20 * blocks))).first()[0]
    return Grams(langs, tables, sizes, singles, sorted({0, *cuts, ALL_CONTEXTS}))


def gather(docs: DataFrame, block_grams: int = BLOCK_GRAMS) -> tuple[Grams, Grams]:
    """The grams of rows (lang, text): of all of them, and of those that are not left out for calibration."""
    docs = docs.where("lang is not null and text is not null")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    if not langs:
        none = Grams([], [], [], [], [0, ALL_CONTEXTS])
        return none, none
    counted = stored(count_grams(docs, langs), "counted")
    whole = counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return tuple(_orders(t, langs, block_grams) for t in (whole, counted.where("not out").select("lang", "key", "n")))


def measured(docs: DataFrame, found: Grams | Identifier) -> DataFrame:
    """The rows, without text, with their number of symbols n, letters (whether they have any) and the entropies h by language; stored."""
    spark, keep = docs.sparkSession, [f for f in docs.schema.fields if f.name != "text"]
    added = [("n", pa.int64()), ("letters", pa.bool_()), ("h", pa.list_(pa.float64()))]

    def pass_over(rows: DataFrame, model: Identifier, name: str) -> DataFrame:
        held = spark.sparkContext.broadcast(model)
        own = [f.name for f in rows.schema.fields if f.name != "text"]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, "text", PIECE_BYTES):
                h, n, letters = held.value.entropies(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1], pa.int32()), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(n, pa.int64()), pa.array(letters), lists], names=[*own, *[c for c, _ in added]])

        schema = StructType([f for f in rows.schema.fields if f.name != "text"]).add("n", "long").add("letters", "boolean").add("h", ArrayType(DoubleType()))
        out = stored(rows.mapInArrow(measure, schema), name)
        held.destroy()
        return out

    blocks = 1 if isinstance(found, Identifier) else len(found.cuts) - 1
    if blocks == 1:
        return pass_over(docs, found if isinstance(found, Identifier) else found.block(0), "entropies")
    # What is measured depends on the text alone, so the blocks' shares meet by its hash and no text is moved.
    keyed = docs.withColumn("__key", F.coalesce(text_key(), F.lit(bytearray())))
    shares = [pass_over(keyed.select("__key", "text"), found.block(b), "shares").dropDuplicates(["__key"]) for b in range(blocks)]
    sums = [F.sum(F.col("h")[k]).alias(f"h{k}") for k in range(len(found.langs))]
    whole = reduce(DataFrame.unionAll, shares).groupBy("__key").agg(F.first("n").alias("n"), F.first("letters").alias("letters"), *sums)
    whole = whole.select("__key", "n", "letters", F.array(*[f"h{k}" for k in range(len(found.langs))]).alias("h"))
    return stored(keyed.drop("text").join(whole, "__key").select(*[f.name for f in keep], "n", "letters", "h"), "entropies")


def _measures(batch: pa.RecordBatch, langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = batch.column("h").flatten().to_numpy(zero_copy_only=False)
    return h.reshape(batch.num_rows, langs), batch.column("n").to_numpy(), batch.column("letters").to_numpy(zero_copy_only=False)


def _stretch(n: int) -> float:
    """How much further the thousandth lies from the median than the largest of n, for normal quantiles."""
    z = NormalDist().inv_cdf
    return z(0.999) / z(min(0.999, max(2, n) / (max(2, n) + 1)))


def calibrated(fitted: Identifier, rows: DataFrame, alphabets: list[int]) -> None:
    """Calibrate with all measured rows (lang, n, letters, h) that have a language: the score's scale by log loss, and each language's
    limit. alphabets: how many symbols each language has."""
    places = F.create_map(*[F.lit(x) for k, lang in enumerate(fitted.langs) for x in (lang, k)]) if fitted.langs else None
    if places is None:
        return
    rows = rows.where("lang is not null and letters").select(places[F.col("lang")].alias("lang"), "n", "letters", "h")

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, _ = _measures(batch, len(fitted.langs))
            gaps = (h - h.min(axis=1, keepdims=True, initial=np.inf)) * np.minimum(n, 200)[:, None]
            own = np.arange(len(n)), batch.column("lang").to_numpy()
            sums = [float((gaps[own] * s + np.log(np.exp(-gaps * s).sum(axis=1))).sum()) for s in SCALES]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=[f"s{k}" for k in range(len(SCALES))])

    names = [f"s{k}" for k in range(len(SCALES))]
    sums = rows.mapInArrow(losses, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    if sums[0] is not None:
        fitted.scale = min(zip(sums, SCALES, strict=True))[1]
    # Exact quantiles of fixed bins: the same however the rows are dealt, and combined before the shuffle, as bounded counts of bins.
    binned = rows.where(F.col("n") >= MIN_SYMBOLS).select("lang", (F.floor(F.get("h", F.col("lang")) * BINS) + 1).alias("bin"))
    at = [F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY bin)").alias(name) for share, name in ((0.5, "middle"), (0.999, "most"))]
    seen = binned.rollup("lang").agg(F.count("*").alias("all"), *at).collect()
    found = {r["lang"]: (r["all"], (r["middle"] + 2 * _stretch(r["all"]) * (r["most"] - r["middle"])) / BINS) for r in seen}
    together, pooled = found.get(None, (0, 0.0))
    for k in range(len(fitted.langs)):
        total, limit = found.get(k, (0, 0.0))
        guess = float(np.log(max(2, alphabets[k])))
        fitted.limits[k] = limit if total >= LEAST else max(limit, pooled) if together >= LEAST else guess


def _calibrate(fitted: Identifier, docs: DataFrame, whole: Grams, rest: Grams) -> None:
    """Calibrate with the rows (lang, text) that are left out, measured under the models of the rest."""
    known = [lang for k, lang in enumerate(rest.langs) if rest.sizes[-1][k]]
    rows = docs.select("lang", "text").where(F.col("lang").isin(known) & F.col("text").isNotNull() & _left_out())
    calibrated(fitted, measured(rows, rest), whole.sizes[0] if whole.sizes else [])


def learn(docs: DataFrame) -> Identifier:
    """Fit one model per language to rows (lang, text), in one block, and calibrate."""
    whole, rest = gather(docs, sys.maxsize)
    fitted = whole.block(0)
    _calibrate(fitted, docs, whole, rest)
    return fitted


def _fold(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def _taught(docs: DataFrame, *keep) -> DataFrame:
    """The kept columns, text, and lang where the row teaches: not held out (crc32 of doc_id mod 4 is 2: held out), not null."""
    return docs.select(*keep, "text", F.when((_fold("doc_id") != 2) & F.col("text").isNotNull(), F.col("lang")).alias("lang"))


def _decided(docs: DataFrame, block_grams: int) -> tuple[DataFrame, Identifier]:
    """The measured rows of docs (text, lang and others), and what decides on them."""
    whole, rest = gather(docs, block_grams)
    decider = Identifier(whole.langs, [])
    _calibrate(decider, docs, whole, rest)
    return measured(docs, whole), decider


def identify(docs: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, and rejected by the calibrated limit."""
    own = F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(_fold("doc_id") == 2, F.lit(False)).alias("held_out")
    found, decider = _decided(_taught(docs, *own), block_grams)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*decider.langs, UNKNOWN])
        for batch in batches:
            best, score, rejected = decider.decide(*_measures(batch, len(decider.langs)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), names.take(pa.array(np.where(best < 0, len(decider.langs), best))), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return found.mapInArrow(rows, RESULT_SCHEMA)


def accepted(docs: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The documents, with all their columns, that are not rejected."""
    found, decider = _decided(_taught(docs, F.coalesce(text_key(), F.lit(bytearray())).alias("key")), block_grams)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected = decider.decide(*_measures(batch, len(decider.langs)))
            yield batch.select(["key"]).filter(pa.array(rejected))

    # Whether a document goes depends on its text alone, so the rejected texts' keys are enough; a null text has no letter.
    gone = stored(found.mapInArrow(rows, "key binary").distinct(), "rejected")
    return without_texts(docs.where(F.col("text").isNotNull()), gone)
