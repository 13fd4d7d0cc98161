"""Boolean queries in conjunctive normal form, built on the driver.

A query is a conjunction of clauses, a clause a disjunction of literals, a
literal an atom or its negation.  ``&``, ``|`` and ``~`` keep the normal form:
AND joins the clause lists, OR distributes over them, NOT applies De Morgan's
laws twice.  ``matches`` evaluates a query in plain Python and is the
definition that the engine is tested against: a clause holds if some literal
holds, a literal if negated XOR some value of its field satisfies the atom.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from .functions import geo, values

INT_KINDS = {"lt": "<", "le": "<=", "eq": "==", "ge": ">=", "gt": ">"}


@dataclass(frozen=True)
class Literal:
    """An atom on one field.  ``kind`` is term, prefix, lt, le, eq, ge, gt, h3, geo or all."""

    kind: str
    field: str
    val: str | None = None
    num: int | None = None
    lat: float | None = None
    lng: float | None = None
    radius: int | None = None
    neg: bool = False

    def negate(self) -> Literal:
        return replace(self, neg=not self.neg)

    def accepts(self, value: str) -> bool:
        """Does one value satisfy the atom?"""
        if self.kind == "term":
            return value == self.val
        if self.kind == "prefix":
            return value.startswith(self.val)
        if self.kind in INT_KINDS:
            n = values.parse_int(value)
            return n is not None and {"lt": n < self.num, "le": n <= self.num, "eq": n == self.num, "ge": n >= self.num, "gt": n > self.num}[self.kind]
        if self.kind == "h3":
            cell = geo.parse_cell(value)
            return cell is not None and geo.parent(cell, geo.resolution(self.num)) == self.num
        at = geo.parse_point(value)
        return at is not None and geo.distance(at, (self.lat, self.lng)) <= self.radius

    def matches(self, doc: Mapping[str, Sequence[str]]) -> bool:
        return self.neg != (self.kind == "all" or any(map(self.accepts, doc.get(self.field, ()))))

    def _shown(self) -> str:
        """The value as it sorts and shows."""
        if self.kind == "h3":
            return format(self.num, "x")
        if self.kind == "geo":
            return f"({self.lat:.10f}, {self.lng:.10f}),{self.radius}"
        return str(self.num) if self.kind in INT_KINDS else self.val or ""

    def __str__(self) -> str:
        sign = {"term": "=", "prefix": "=", "h3": "=H3IN=", "geo": " LATLNG_WITHIN ", "all": "="} | INT_KINDS
        return f"{'~' * self.neg}{self.field}{sign[self.kind]}{self._shown()}{'*' * (self.kind == 'prefix')}"


@dataclass(frozen=True)
class Clause:
    literals: tuple[Literal, ...]

    @staticmethod
    def match_all() -> Clause:
        return Clause((Literal("all", "__match_all__", "true"),))

    @staticmethod
    def from_clauses(clauses: Iterable[Clause]) -> Clause:
        return Clause(tuple(x for c in clauses for x in c.literals))

    def negate(self) -> Query:
        return Query(tuple(Clause((x.negate(),)) for x in self.literals))

    def cleansed(self) -> Clause:
        """Without repeated literals, order kept."""
        return Clause(tuple(dict.fromkeys(self.literals)))

    def matches(self, doc: Mapping[str, Sequence[str]]) -> bool:
        return any(x.matches(doc) for x in self.literals)

    def __str__(self) -> str:
        return f"(OR {' '.join(map(str, sorted(self.literals, key=lambda x: (x.field, x._shown()))))})"


class QueryTooLarge(ValueError):
    """The normal form has more clauses or literals than allowed."""


@dataclass(frozen=True)
class Query:
    """The empty query has no clause and matches everything; so does its negation, a product over nothing."""

    clauses: tuple[Clause, ...] = ()

    #: Literals that a normal form may have in all; distributing may grow exponentially.
    MAX_LITERALS = 1_000_000

    @staticmethod
    def of(literal: Literal) -> Query:
        return Query((Clause((literal,)),))

    @staticmethod
    def term(name: str, value: str) -> Query:
        return Query.of(Literal("term", name, value))

    @staticmethod
    def prefix(name: str, value: str) -> Query:
        return Query.of(Literal("prefix", name, value))

    @staticmethod
    def from_and(queries: Iterable[Query]) -> Query:
        return Query(tuple(c for q in queries for c in q.clauses))

    @staticmethod
    def from_or(queries: Iterable[Query]) -> Query:
        def both(a: Query, b: Query) -> Query:
            size = sum(len(c.literals) for c in a.clauses) * len(b.clauses) + sum(len(c.literals) for c in b.clauses) * len(a.clauses)
            if size > Query.MAX_LITERALS:
                raise QueryTooLarge(f"{size} literals")
            return Query(tuple(Clause(x.literals + y.literals) for x, y in product(a.clauses, b.clauses)))

        found = list(queries)
        return reduce(both, found) if found else Query()

    def negation(self) -> Query:
        return Query(tuple(c.cleansed() for c in Query.from_or(c.negate() for c in self.clauses).clauses))

    def __and__(self, other: Query) -> Query:
        return Query.from_and((self, other))

    def __or__(self, other: Query) -> Query:
        return Query.from_or((self, other))

    def __invert__(self) -> Query:
        return self.negation()

    def matches(self, doc: Mapping[str, Sequence[str]]) -> bool:
        return all(c.matches(doc) for c in self.clauses)

    def prefix_queries(self) -> list[Literal]:
        return [x for c in self.clauses for x in c.literals if x.kind == "prefix"]

    def __str__(self) -> str:
        return f"(AND {' '.join(map(str, self.clauses))})"


@dataclass(frozen=True)
class field:  # noqa: N801
    """Builds atoms on one field: ``field("taste").has_value("sweet")``."""

    name: str

    def has_value(self, value: str) -> Query:
        return Query.term(self.name, value)

    def has_prefix(self, value: str) -> Query:
        return Query.prefix(self.name, value)

    def _int(self, kind: str, n: int) -> Query:
        if not values.INT_MIN <= n <= values.INT_MAX:
            raise ValueError(f"{n} is no 64-bit integer")
        return Query.of(Literal(kind, self.name, num=n))

    def i64_lt(self, n: int) -> Query:
        return self._int("lt", n)

    def i64_le(self, n: int) -> Query:
        return self._int("le", n)

    def i64_eq(self, n: int) -> Query:
        return self._int("eq", n)

    def i64_ge(self, n: int) -> Query:
        return self._int("ge", n)

    def i64_gt(self, n: int) -> Query:
        return self._int("gt", n)

    def h3in(self, cell: str | int) -> Query:
        n = geo.parse_cell(cell if isinstance(cell, str) else format(cell, "x"))
        if n is None:
            raise ValueError(f"{cell!r} is no H3 cell")
        return Query.of(Literal("h3", self.name, num=n))

    def latlng_within(self, lat: float, lng: float, metres: int) -> Query:
        return Query.of(Literal("geo", self.name, lat=float(lat), lng=float(lng), radius=int(metres)))
