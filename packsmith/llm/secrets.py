"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. On the driver its syntax tree is turned into a Boolean query over trigrams that every match
must contain: stretches whose possible strings can be listed give "one of these strings", and a string stands for all its
trigrams. The index holds, for every trigram that a rule asks for, the sorted ids of the documents that contain it, in blocks of
documents: so a list is bounded however frequent its trigram is. Lists are intersected and united per block, and only the documents
that remain for a rule are scanned with its expression. Rules without a mandatory trigram (hex) scan all documents.

Python runs nowhere on the data. Positions come from the lengths of the parts between matches, in code points.

Edge cases: null text counts as empty; documents with a null doc_id cannot be in the index and are scanned by every rule; rows that
share a doc_id are scanned if one of them is a candidate, and each reports its own spans; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsmith.session import stored


@dataclass(frozen=True)
class Rule:
    """kind, expression, and the group whose length must be at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules in the order of their report.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
# Public formats of credentials.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
]
RULES = BASE + MORE
BLOCK_DOCS = 4096
BROADCAST_ROWS = 500_000
#: Listed strings of one stretch at most; a class with more characters ends the stretch.
STRINGS, CLASS = 256, 12

Clause = frozenset[frozenset[str]]  # one of these sets of trigrams


def _clause(strings: Iterable[str]) -> Clause | None:
    """One of the strings occurs: as sets of trigrams without those that another one implies; None if that asks for nothing."""
    sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(t < s for t in sets))


class _Stretch:
    """The strings that the current stretch may be, and the clauses so far."""

    def __init__(self) -> None:
        self.strings, self.clauses = {""}, []

    def end(self) -> None:
        if found := _clause(self.strings):
            self.clauses.append(found)
        self.strings = {""}

    def append(self, strings: set[str]) -> None:
        if len(self.strings) * len(strings) > STRINGS:
            self.end()
        self.strings = {a + b for a in self.strings for b in strings}


def _characters(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 64:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= CLASS else None


def _strings(tree) -> set[str] | None:
    """All strings, in lower case, that the tree matches, if they can be listed."""
    out = {""}
    for op, value in tree:
        if op is sre.LITERAL:
            own = {chr(value).lower()}
        elif op is sre.IN:
            own = _characters(value)
        elif op is sre.SUBPATTERN:
            own = _strings(value[3])
        elif op is sre.BRANCH:
            parts = [_strings(t) for t in value[1]]
            own = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 8:
            own, one = set(), _strings(value[2])
            for n in range(value[0], value[1] + 1):
                power = {""}
                for _ in range(n):
                    power = None if one is None or power is None or len(power) * len(one) > STRINGS else {a + b for a in power for b in one}
                own = None if own is None or power is None else own | power
        elif op is sre.AT:
            own = {""}
        else:
            own = None
        if own is None or len(out) * len(own) > STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _walk(tree, stretch: _Stretch) -> None:
    for node in tree:
        op, value = node
        if (own := _strings([node])) is not None:
            stretch.append(own)
        elif op is sre.SUBPATTERN:
            _walk(value[3], stretch)
        elif op is sre.BRANCH:
            stretch.end()
            parts = []
            for t in value[1]:
                inner = _Stretch()
                _walk(t, inner)
                inner.end()
                parts.append(inner.clauses)
            if all(parts):  # one clause of each branch is a sound choice
                sets = frozenset(s for clauses in parts for s in clauses[0])
                stretch.clauses.append(sets)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            if (one := _strings(value[2])) is None:
                stretch.end()
                _walk(value[2], stretch)
            else:
                for _ in range(min(value[0], 3)):
                    stretch.append(one)
            stretch.end()
        else:
            stretch.end()


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that the lower-cased text of every match satisfies, each: all trigrams of one of some sets. Empty: no condition."""
    stretch = _Stretch()
    _walk(parser.parse(pattern), stretch)
    stretch.end()
    return stretch.clauses


def trigrams_of(rules: list[Rule]) -> list[str]:
    return sorted({t for rule in rules for clause in trigram_query(rule.pattern) for own in clause for t in own})


def build_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, trigram, ids): the sorted ids of the documents of a block that contain a trigram, stored."""
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    wanted = F.array(*[F.lit(t) for t in trigrams])
    # The outer transform binds the lower-cased text once for all trigrams.
    inside = F.transform(F.array(F.lower(text_col)), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    found = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.explode(inside).alias("trigram"))
    found = found.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return stored(found.groupBy("block", "trigram").agg(F.array_sort(F.collect_set("id")).alias("ids")), "trigrams")


def _marked(bit: int):
    return lambda i: F.struct(i.alias("id"), F.lit(bit).alias("bit"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(id, mask): the documents that satisfy the query of some rule; bit k of mask is rule k."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("m"))
    none = F.array().cast("array<bigint>")

    def all_of(own: frozenset[str]) -> Column:
        found = None
        for t in sorted(own):
            ids = F.coalesce(F.try_element_at("m", F.lit(t)), none)
            found = ids if found is None else F.array_intersect(found, ids)
        return found

    hits = []
    for k, rule in enumerate(rules):
        found: Column | None = None
        for clause in trigram_query(rule.pattern):
            either = None
            for own in sorted(clause, key=sorted):
                either = all_of(own) if either is None else F.array_union(either, all_of(own))
            found = either if found is None else F.array_intersect(found, either)
        if found is not None:
            hits.append(F.transform(found, _marked(1 << k)))
    if not hits:
        return index.select(F.lit(0).cast("bigint").alias("id"), F.lit(0).alias("mask")).limit(0)
    rows = lists.select(F.explode(F.concat(*hits)).alias("hit"))
    return rows.groupBy("hit.id").agg(F.bit_or("hit.bit").alias("mask"))



def _spans(text: Column, rule: Rule, k: int) -> Column:
    """The rule's spans in text, as an array of (start, k, end)."""
    pattern = F.lit(rule.pattern)
    matches, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    sizes = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    parts = F.arrays_zip(F.transform(matches, F.char_length).alias("n"), F.transform(F.slice(between, 1, F.size(matches)), F.char_length).alias("gap"), F.transform(sizes, F.char_length).alias("own"))
    empty = F.array().cast("array<struct<start:int,k:int,end:int>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        span = F.struct(start.alias("start"), F.lit(k).alias("k"), (start + part["n"]).alias("end"))
        return F.struct((start + part["n"]).alias("at"), F.when(part["own"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(F.regexp_like(text, pattern), found).otherwise(empty)


def _listed(spans: Column, rules: list[Rule]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, found, an array of (start, k, end) with k the place of the rule."""
    index = build_index(docs, trigrams_of(rules))
    hits = stored(candidates(index, rules).withColumnRenamed("id", "hit_id"), "candidates")
    side = F.broadcast(hits) if hits.limit(broadcast_rows + 1).count() <= broadcast_rows else hits
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = base.join(side, base["doc_id"] == F.col("hit_id"), "left")
    full = sum(1 << k for k in range(len(rules)))
    mask = F.when(F.col("doc_id").isNull(), F.lit(full)).otherwise(F.coalesce("mask", F.lit(0)))
    joined = joined.select("doc_id", "text", mask.alias("mask"))
    empty = F.array().cast("array<struct<start:int,k:int,end:int>>")
    found = []
    for k, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, k)
        found.append(spans if not trigram_query(rule.pattern) else F.when(F.col("mask").bitwiseAND(1 << k) != 0, spans).otherwise(empty))
    return joined.select("doc_id", F.concat(*found).alias("found"))


def secret_digest(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, the numbers of base spans, the digest of base spans, and all spans as text."""
    found = find_secrets(docs, RULES, broadcast_rows)

    def of(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["k"] == k)).cast("bigint")

    base = F.filter("found", lambda s: s["k"] < len(BASE))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_listed(base, RULES).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found"), RULES).alias("spans"))


def compiled(rule: Rule) -> re.Pattern:
    """The rule for Python, as the tests use it."""
    return re.compile(rule.pattern)
