"""Anchors: keys that a document must share with a query to match it.

A query can only match if each of its clauses holds, and a clause without
negations only if one of its literals does.  So some such clauses, the
cheapest, stand for the query: each of their literals gets a key (a 64-bit
hash), keys of several clauses are combined into one hash, and a document
yields the same for each of its values that could satisfy an atom of the
class.  A false candidate costs time only, as the whole query is evaluated on
it.

Classes: term and integer equality are the value itself; a prefix is its
first L characters for a few lengths L; a cell its ancestor at the query's
resolution; an integer range the classes of :func:`values.bucket_of` that it
reaches; a radius the squares of a grid about its size.

Costs are those of :func:`config.literal_cost`.  The share of documents that a
value lets through is the observed one where it is known; else that of one
of as many values as the stored queries themselves name for the field.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo, values
from ..query import Clause, Literal, Query
from .config import WHOLE, EngineConfig, literal_cost

#: Longitudes of one radius, in squares; beyond it the key is the whole band of latitude.
SQUARES = 64


class Extractor(NamedTuple):
    """How documents yield keys: a class, its field and its parameter.

    The parsed values of a document are columns: f has texts, fi integers, fc cells, fg points, by field.
    """

    kind: str
    field: str
    param: int = 0

    def tag(self) -> str:
        return f"{self.kind}{self.param}:{self.field}"

    def _texts(self, v: Column) -> Column:
        """The key texts of one parsed value, an array that may hold nulls."""
        if self.kind == "T":
            return F.array(v)
        if self.kind == "P":
            return F.array(F.when(F.length(v) >= self.param, F.left(v, F.lit(self.param))))
        if self.kind == "E":
            return F.array(v.cast("string"))
        if self.kind == "I":
            return F.array(values.int_bucket(v).cast("string"))
        if self.kind == "H":
            return F.array(geo.cell_parent(v, F.lit(self.param)).cast("string"))
        step = 2.0**self.param
        # latitudes beyond +-90 are the other side of the pole
        usual, lat = F.abs(v["lat"]) <= 90, F.radians(v["lat"])
        band = F.floor(F.when(usual, v["lat"]).otherwise(F.degrees(F.asin(F.sin(lat)))) / step)
        lng = v["lng"] + F.when(usual | (F.cos(lat) >= 0), 0.0).otherwise(180.0)
        turn = lng - F.floor((lng + 180) / 360) * 360
        return F.array(F.concat_ws(":", band, F.floor(turn / step)), F.concat_ws(":", band, F.lit("*")))

    def keys(self) -> Column:
        """The hashes of a document's keys of this class."""
        of = F.try_element_at(F.col({"T": "f", "P": "f", "E": "fi", "I": "fi", "H": "fc"}.get(self.kind, "fg")), F.lit(self.field))
        if self.kind == "T":
            return F.coalesce(F.transform(of, lambda v: F.xxhash64(F.lit(self.tag()), v)), F.array().cast("array<bigint>"))
        each = F.filter(F.flatten(F.transform(F.filter(of, lambda v: v.isNotNull()), self._texts)), lambda x: x.isNotNull())
        return F.coalesce(F.transform(each, lambda x: F.xxhash64(F.lit(self.tag()), x)), F.array().cast("array<bigint>"))

    def hash_of(self, text: str) -> int:
        """What ``xxhash64(tag, text)`` is in Spark."""
        return xxhash.xxh64_intdigest(text.encode(), _tag_hash(self.tag()))


@lru_cache(maxsize=10_000)
def _tag_hash(tag: str) -> int:
    return xxhash.xxh64_intdigest(tag.encode(), 42)


def combined(a: int, b: int) -> int:
    """What ``xxhash64(a, b)`` of two longs is in Spark, all unsigned."""
    return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))


class Key(NamedTuple):
    of: Extractor
    text: str


def _grid(x: Literal) -> list[Key]:
    """The squares that a radius reaches; none if it reaches a pole or is very large."""
    degrees = math.degrees(x.radius / geo.RADIUS_M) * (1 + 1e-9) + 1e-9
    if degrees >= 45 or abs(x.lat) + degrees >= 90:
        return []
    k = max(-12, math.ceil(math.log2(degrees)))
    step, of = 2.0**k, Extractor("G", x.field, k)
    bands = range(math.floor((x.lat - degrees) / step), math.floor((x.lat + degrees) / step) + 1)
    wide = math.degrees(math.asin(math.sin(math.radians(degrees)) / math.cos(math.radians(x.lat)))) + 1e-9
    if 2 * wide / step + 2 > SQUARES:
        return [Key(of, f"{b}:*") for b in bands]
    lng = x.lng - math.floor((x.lng + 180) / 360) * 360
    west, east = lng - wide, lng + wide
    edges = [(west + 360, 180.0), (-180.0, east)] if west < -180 else [(west, 180.0), (-180.0, east - 360)] if east >= 180 else [(west, east)]
    squares = sorted({g for a, b in edges for g in range(math.floor(a / step), math.floor(b / step) + 1)})
    return [Key(of, f"{b}:{g}") for b in bands for g in squares]


def literal_keys(x: Literal, config: EngineConfig) -> list[Key] | None:
    """The keys of a positive literal, None if it can't be anchored."""
    if x.neg or x.kind == "all":
        return None
    if x.kind == "term":
        return [Key(Extractor("T", x.field), x.val)]
    if x.kind == "prefix":
        n = len(x.val)
        size = max((s for s in config.prefix_sizes if s <= n), default=n)
        return [Key(Extractor("P", x.field, size), x.val[:size])]
    if x.kind == "eq":
        return [Key(Extractor("E", x.field), str(x.num))]
    if x.kind == "h3":
        return [Key(Extractor("H", x.field, geo.resolution(x.num)), str(x.num))]
    if x.kind == "geo":
        return _grid(x) or None
    own = values.bucket_of(x.num)
    return _range_keys(x.field, -65, own) if x.kind in ("lt", "le") else _range_keys(x.field, own, 64)


@lru_cache(maxsize=10_000)
def _range_keys(name: str, low: int, high: int) -> list[Key]:
    return [Key(Extractor("I", name), str(b)) for b in range(low, high + 1)]


#: Most keys of one query's combined anchor, most combinations of classes that documents are asked for,
#: and the cost below which a further clause is worth combining.
MOST_KEYS, MOST_CLASSES, WORTH = 64, 96, WHOLE // 2

#: The classes that an anchor combines, in order; the key's hash is folded in that order.
Classes = tuple[Extractor, ...]


@dataclass
class Costs:
    """What is known for choosing: shares of documents of some (field, value), and how many values queries name for a field."""

    seen: Mapping[tuple[str, str], float] | None = None
    named: Mapping[str, int] = field(default_factory=dict)

    @staticmethod
    def of(queries: Iterable[Query], seen: Mapping[tuple[str, str], float] | None = None) -> Costs:
        values_: dict[str, set[str]] = {}
        for q in queries:
            for c in q.clauses:
                for x in c.literals:
                    if x.kind == "term":
                        values_.setdefault(x.field, set()).add(x.val)
        return Costs(seen, {k: len(v) for k, v in values_.items()})

    def clause(self, c: Clause) -> float:
        return sum(self.literal(x) for x in c.literals)

    def literal(self, x: Literal) -> float:
        share = None
        if x.kind == "term":
            share = (self.seen or {}).get((x.field, x.val))
            if share is None and (n := self.named.get(x.field, 0)) > 1:
                share = 1 / n
        elif x.kind == "prefix" and self.seen:
            some = [s for (f, v), s in self.seen.items() if f == x.field and v.startswith(x.val)] if len(self.seen) <= 2000 else []
            share = sum(some) or None
        return literal_cost(x.kind, x.neg, share)


@dataclass
class Keys:
    """The anchor of one query: for each combination of classes its key hashes (signed), one clause or several."""

    one: list[tuple[Classes, int]]
    many: list[tuple[Classes, int]]


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def query_keys(q: Query, config: EngineConfig, costs: Costs) -> Keys | None:
    """The anchors of a query by its cheapest clause, and by some of them together; None if no clause can be one."""
    found = []
    for c in q.clauses:
        if not c.literals:  # nothing satisfies it
            return Keys([], [])
        keys = [literal_keys(x, config) for x in c.literals]
        if None not in keys:
            found.append((costs.clause(c), sum(map(len, keys)), keys))
    if not found:
        return None
    found.sort(key=lambda x: x[:2])
    distinct = lambda keys: list(dict.fromkeys(k for ks in keys for k in ks)) if len(keys) > 1 else keys[0]
    first = distinct(found[0][2])
    one = [((k.of,), _signed(k.of.hash_of(k.text))) for k in first]
    many = [[k] for k in first]
    used, clauses = {k.of for k in first}, 1
    for cost, n, keys in found[1:]:
        if clauses == config.n_clause_matchers or cost >= WORTH:
            break
        own = {ks[0].of for ks in keys}  # a literal has one class
        if own & used or len(many) * n > MOST_KEYS or any(e.kind == "I" for e in own):  # a range has too many classes
            continue
        keys = distinct(keys)
        many = [[*a, k] for a in many for k in keys]
        used, clauses = used | own, clauses + 1

    def folded(keys: list[Key]) -> tuple[Classes, int]:
        keys = sorted(keys, key=lambda k: k.of)
        h = keys[0].of.hash_of(keys[0].text)
        for k in keys[1:]:
            h = combined(h, k.of.hash_of(k.text))
        return tuple(k.of for k in keys), _signed(h)

    return Keys(one, one if clauses == 1 else [folded(ks) for ks in many])


@dataclass
class Anchors:
    """keys: for each anchored query id its distinct key hashes; classes: what documents must yield; always: ids
    that every document is tried on."""

    keys: dict[int, list[int]] = field(default_factory=dict)
    classes: list[Classes] = field(default_factory=list)
    always: list[int] = field(default_factory=list)


def pick(combinations: Mapping[frozenset[Classes], int]) -> set[frozenset[Classes]]:
    """Those sets of combinations that most queries use, ``MOST_CLASSES`` combinations in all."""
    out, classes = set(), set()
    for c, _ in sorted(combinations.items(), key=lambda x: (-x[1], sorted(map(str, x[0])))):
        if len(classes | c) <= MOST_CLASSES:
            out.add(c)
            classes |= c
    return out


def choose(queries: Iterable[tuple[int, Query]], config: EngineConfig | None = None, seen: Mapping[tuple[str, str], float] | None = None) -> Anchors:
    """The anchors of all queries.  ``seen`` has shares of documents for frequent (field, value) pairs."""
    config, out, found = config or EngineConfig(), Anchors(), list(queries)
    costs = Costs.of((q for _, q in found), seen)
    got = {qid: query_keys(q, config, costs) for qid, q in found}
    used = Counter(frozenset(c for c, _ in k.many) for k in got.values() if k)
    picked = pick({c: n for c, n in used.items() if any(len(x) > 1 for x in c)})
    classes: set[Classes] = set()
    for qid, k in got.items():
        if k is None:
            out.always.append(qid)
            continue
        own = k.many if frozenset(c for c, _ in k.many) in picked else k.one
        out.keys[qid] = list(dict.fromkeys(h for _, h in own))
        classes.update(c for c, _ in own)
    out.classes = sorted(classes)
    return out
