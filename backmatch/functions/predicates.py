"""The atoms as Spark columns: over a literal in a row (data-driven), as SQL text and compiled from a query.

Null never leaks through a negation: a value that can't be read or a field
that is missing is false before the literal's sign is applied.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..query import INT_KINDS, Literal, Query
from . import geo, values

LITERAL = "struct<neg:boolean,kind:string,field:string,val:string,num:bigint,lat:double,lng:double,radius:bigint>"
CLAUSES = f"array<array<{LITERAL}>>"


def rows(query: Query) -> list[list[dict]]:
    """The clauses as data for a column of type ``CLAUSES``."""
    return [[{"neg": x.neg, "kind": x.kind, "field": x.field, "val": x.val, "num": x.num, "lat": x.lat, "lng": x.lng, "radius": x.radius} for x in c.literals] for c in query.clauses]


def from_rows(clauses) -> Query:
    from ..query import Clause

    return Query(tuple(Clause(tuple(Literal(x["kind"], x["field"], x["val"], x["num"], x["lat"], x["lng"], x["radius"], x["neg"]) for x in c)) for c in clauses))


_INTS = ("lt", "le", "eq", "ge", "gt")
#: The parsed values of a document by kind of atom, made once for each document and only for fields that need them.
PARSED = {"fi": (_INTS, values.int_value, "bigint"), "fc": (("h3",), geo.cell_value, "bigint"), "fg": (("geo",), geo.point_value, "struct<lat:double,lng:double>")}


def needs(queries: Iterable[Query]) -> dict[str, set[str]]:
    """The fields of each kind of atom in some queries."""
    out: dict[str, set[str]] = {}
    for q in queries:
        for c in q.clauses:
            for x in c.literals:
                out.setdefault(x.kind, set()).add(x.field)
    return out


def parsed(docs: DataFrame, fields: Mapping[str, set[str]]) -> DataFrame:
    """doc_id and f of ``docs`` with fi, fc and fg: integers, cells and points of the fields that atoms of these kinds ask for."""
    out = []
    for name, (kinds, parse, kind) in PARSED.items():
        wanted = sorted(set().union(*(fields.get(k, set()) for k in kinds)))
        got = F.transform_values(F.map_filter("f", lambda k, v: k.isin(wanted)), lambda k, vs: F.transform(vs, parse)) if wanted else F.lit(None).cast(f"map<string,array<{kind}>>")  # noqa: B023
        out.append(got.alias(name))
    return docs.select("doc_id", "f", *out)


def clauses_match(clauses: Column, kinds: Iterable[str]) -> Column:
    """Does a document, as ``parsed`` gives it, satisfy all clauses?  ``kinds`` are those that occur in them."""
    of = lambda name, l: F.try_element_at(F.col(name), l["field"])  # noqa: E731, E741
    near = lambda l, v: geo.metres(v["lat"], v["lng"], l["lat"], l["lng"]) <= l["radius"]  # noqa: E731, E741
    inside = lambda l, v: geo.cell_parent(v, F.shiftright(l["num"], 52).bitwiseAND(F.lit(15)).cast("int")) == l["num"]  # noqa: E731, E741
    some = lambda name, l, p: F.exists(of(name, l), lambda v: F.coalesce(p(v), F.lit(False)))  # noqa: E731, E741
    each = {
        "term": lambda l: F.array_contains(of("f", l), l["val"]),
        "prefix": lambda l: some("f", l, lambda v: F.startswith(v, l["val"])),
        "lt": lambda l: some("fi", l, lambda v: v < l["num"]),
        "le": lambda l: some("fi", l, lambda v: v <= l["num"]),
        "eq": lambda l: some("fi", l, lambda v: v == l["num"]),
        "ge": lambda l: some("fi", l, lambda v: v >= l["num"]),
        "gt": lambda l: some("fi", l, lambda v: v > l["num"]),
        "h3": lambda l: some("fc", l, lambda v: inside(l, v)),
        "geo": lambda l: some("fg", l, lambda v: near(l, v)),
        "all": lambda l: F.lit(True),
    }
    kinds = [k for k in each if k in set(kinds)]

    def literal(l: Column) -> Column:  # noqa: E741
        got = F.lit(None).cast("boolean")
        for k in reversed(kinds):
            got = F.when(l["kind"] == k, each[k](l)).otherwise(got)
        return l["neg"] != F.coalesce(got, F.lit(False))

    return F.forall(clauses, lambda c: F.exists(c, literal))


def text_sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def operand_sql(x: Literal) -> str:
    """What an atom needs of a ``parsed`` document, as SQL text that all atoms of its kind on its field have in common."""
    of = lambda name: f"try_element_at({name}, {text_sql(x.field)})"
    if x.kind == "prefix":
        return f"transform({of('f')}, v -> substring(v, 1, {len(x.val)}))"
    if x.kind in ("lt", "le", "ge", "gt"):
        return f"array_{'min' if x.kind in ('lt', 'le') else 'max'}({of('fi')})"
    return "true" if x.kind == "all" else of({"term": "f", "eq": "fi", "h3": "fc", "geo": "fg"}[x.kind])


def literal_sql(x: Literal, operand: str) -> str:
    """A positive literal over its operand as SQL text, which is cheap to make in great numbers; but for cells and
    points it becomes generated code."""
    n = x.num is not None and (f"{x.num}L" if x.num > -(2**63) else "(-9223372036854775807L - 1L)")
    if x.kind in ("all", "term", "prefix", "eq"):
        got = operand if x.kind == "all" else f"array_contains({operand}, {n if x.kind == 'eq' else text_sql(x.val)})"
    elif x.kind == "h3":
        res = geo.resolution(x.num)
        got = f"exists({operand}, v -> coalesce((shiftright(v, 52) & 15) >= {res} AND ((v & {~(15 << 52)}L) | {res << 52}L | {(1 << 3 * (15 - res)) - 1}L) = {x.num}L, false))"
    elif x.kind == "geo":
        h = f"pow(sin(radians({x.lat!r}D - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians({x.lat!r}D)) * pow(sin(radians({x.lng!r}D - v.lng) / 2), 2)"
        got = f"exists({operand}, v -> coalesce({2 * geo.RADIUS_M!r}D * asin(sqrt(least(1.0D, {h}))) <= {x.radius}L, false))"
    else:
        got = f"{operand} {INT_KINDS[x.kind]} {n}"
    return f"coalesce({got}, false)"


def compiled_literal(x: Literal, doc: Column) -> Column:
    """One literal as an expression; ``array_contains`` for terms keeps it in generated code."""
    if x.kind == "all":
        return F.lit(not x.neg)
    of = F.try_element_at(doc, F.lit(x.field))
    if x.kind == "term":
        got = F.array_contains(of, x.val)
    elif x.kind == "prefix":
        got = F.exists(of, lambda v: F.startswith(v, F.lit(x.val)))
    elif x.kind == "h3":
        got = F.exists(of, lambda v: F.coalesce(geo.cell_parent(geo.cell_value(v), F.lit(geo.resolution(x.num))) == x.num, F.lit(False)))
    elif x.kind == "geo":
        got = F.exists(of, lambda v: F.coalesce(geo.metres(geo.point_value(v)["lat"], geo.point_value(v)["lng"], F.lit(x.lat), F.lit(x.lng)) <= x.radius, F.lit(False)))
    else:
        op = {"lt": "__lt__", "le": "__le__", "eq": "__eq__", "ge": "__ge__", "gt": "__gt__"}[x.kind]
        got = F.exists(of, lambda v: F.coalesce(getattr(values.int_value(v), op)(F.lit(x.num)), F.lit(False)))
    got = F.coalesce(got, F.lit(False))
    return ~got if x.neg else got


def compiled(query: Query, doc: Column) -> Column:
    """The whole query as one expression."""
    clause = lambda c: reduce(Column.__or__, (compiled_literal(x, doc) for x in c.literals), F.lit(False))
    return reduce(Column.__and__, map(clause, query.clauses), F.lit(True))
