"""Percolation: the pairs (document, stored query) that match.

``anchor`` (the default) turns each document into an array of key hashes,
explodes it and joins it with the keys of the queries' anchors; a pair is
taken at the first of the query's keys that the document has, so no distinct
and no shuffle is needed, and the whole query is evaluated as the join's
residual on values that were parsed once.  Queries without an anchor become
expressions over their distinct atoms.  ``cross`` tries all queries on all
documents and is meant for comparison, ``compiled`` makes an expression of
every query.  All three give the same set.

``percolate`` takes queries from the driver.  ``percolate_table`` takes a
corpus that is a DataFrame and never brings it to the driver, but for the
queries without an anchor.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import CLAUSES, LITERAL, clauses_match, compiled, from_rows, literal_sql, needs, operand_sql, parsed
from ..plans.anchors import Classes, Costs, Extractor, choose, pick, query_keys
from ..plans.config import EngineConfig
from ..query import Clause, Literal, Query
from ..shipping import ship
from ..sources.documents import field_values

#: Queries in one expression.
COMPILED_QUERIES = 1024
#: Clauses of a query that are tried before the whole of it, and the longest text in which their values are sought.
TRIED_CLAUSES, HAYSTACK = 4, 4096
#: Estimated bytes of a key's row and of a literal.
KEY_BYTES, LITERAL_BYTES = 64, 160

_LITERAL = pa.struct([("neg", pa.bool_()), ("kind", pa.string()), ("field", pa.string()), ("val", pa.string()), ("num", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64()), ("radius", pa.int64())])


def _clauses(queries: Iterable[Query]) -> pa.Array:
    """A column of type ``CLAUSES``, made field by field."""
    clauses = [q.clauses for q in queries]
    flat = [c.literals for cs in clauses for c in cs]
    literals = [x for c in flat for x in c]
    struct = pa.StructArray.from_arrays([pa.array([getattr(x, f.name) for x in literals], f.type) for f in _LITERAL], fields=list(_LITERAL))
    upto = lambda parts: pa.array(list(accumulate(map(len, parts), initial=0)), pa.int32())
    return pa.ListArray.from_arrays(upto(clauses), pa.ListArray.from_arrays(upto(flat), struct))


def query_frame(spark: SparkSession, queries: Iterable[tuple[int, Query]]) -> DataFrame:
    """qid, clauses."""
    found = list(queries)
    if not found:
        return spark.createDataFrame([], f"qid bigint, clauses {CLAUSES}")
    return spark.createDataFrame(pa.table({"qid": pa.array([i for i, _ in found], pa.int64()), "clauses": _clauses(q for _, q in found)}))


def _bounded(df: DataFrame, size: int, config: EngineConfig) -> DataFrame:
    return F.broadcast(df) if size <= config.broadcast_bytes else df


def matches(query: Query, f: Column | str = "f") -> Column:
    """One query as a filter over a document map."""
    return compiled(query, F.col(f) if isinstance(f, str) else f)


def match_all() -> Query:
    """A query that every document matches."""
    return Query()


def search(docs: DataFrame, query: Query) -> DataFrame:
    """The dual: documents that match one query."""
    return docs.where(matches(query))


def frequent_values(docs: DataFrame, top: int = 1000, fraction: float | None = None) -> dict[tuple[str, str], float]:
    """The shares of documents of the ``top`` most frequent (field, value) pairs, for choosing anchors; of a sample
    if ``fraction`` is given, as they change no answer."""
    docs = docs if fraction is None else docs.sample(fraction, seed=7)
    pairs = field_values(docs).groupBy("field", "value").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(top).collect()
    total = docs.count()
    return {(r["field"], r["value"]): r["n"] / total for r in pairs} if total else {}


def _literals(queries: Iterable[Query]) -> int:
    return sum(len(c.literals) for q in queries for c in q.clauses)


def _needle(x: Literal) -> str | None:
    """Text that ``_haystack`` holds if a document satisfies the literal."""
    if x.neg or x.kind not in ("term", "prefix", "eq"):
        return None
    return f"\x1c{x.field}\x1f{x.num}\x1e" if x.kind == "eq" else f"\x1c{x.field}\x1d{x.val}" + "\x1e" * (x.kind == "term")


def _haystack(fields: Mapping[str, set[str]]) -> Column:
    """All values of a ``parsed`` document that needles may ask for as one text, null if it is long."""
    wanted = sorted(fields.get("term", set()) | fields.get("prefix", set()))
    none = F.array().cast("array<string>")
    each = lambda e, sep: F.transform(e["value"], lambda v: F.concat(F.lit("\x1c"), e["key"], F.lit(sep), v.cast("string"), F.lit("\x1e")))
    told = lambda name, sep: F.flatten(F.transform(F.map_entries(name), lambda e: F.coalesce(each(e, sep), none)))
    parts = [told(F.map_filter("f", lambda k, _: k.isin(wanted)), "\x1d")] * bool(wanted) + [told(F.col("fi"), "\x1f")] * ("eq" in fields)
    text = F.array_join(F.concat(none, *(F.coalesce(p, none) for p in parts)), "")
    return F.get(F.filter(F.array(text), lambda t: F.length(t) <= HAYSTACK), F.lit(0))


def _cross(docs: DataFrame, queries: list[tuple[int, Query]], config: EngineConfig) -> DataFrame:
    """All documents by all queries.  Whole queries are evaluated by interpreted functions, so up to ``TRIED_CLAUSES``
    of a query's clauses, those of one or two literals with needles, are tried before in generated code: by rareness,
    which is estimated from how many needles queries name for a field."""
    fields, needles = needs(q for _, q in queries), {}
    for x in (x for _, q in queries for c in q.clauses for x in c.literals):
        needles.setdefault((x.kind, x.field), set()).add(_needle(x))
    share = lambda c: sum(1 / len(needles[x.kind, x.field]) for x in c.literals)
    slots = [(f"a{i}", f"b{i}") for i in range(TRIED_CLAUSES)]
    tried: dict[str, list[str | None]] = {name: [] for slot in slots for name in slot}
    for _, q in queries:
        found = sorted((c for c in q.clauses if 0 < len(c.literals) <= 2 and all(map(_needle, c.literals))), key=share)
        for slot, c in zip(slots, [*found[:TRIED_CLAUSES], *[Clause(())] * TRIED_CLAUSES]):
            for name, x in zip(slot, [*map(_needle, c.literals), None, None]):
                tried[name].append(x)
    spark, size = docs.sparkSession, LITERAL_BYTES * _literals(q for _, q in queries) + sum(len(x) + 16 for xs in tried.values() for x in xs if x)
    own = pa.table({"qid": pa.array([i for i, _ in queries], pa.int64()), "clauses": _clauses(q for _, q in queries)} | {k: pa.array(v, pa.string()) for k, v in tried.items()})
    own = spark.createDataFrame(own) if queries else query_frame(spark, []).select("*", *(F.lit(None).cast("string").alias(k) for k in tried))
    may = " AND ".join(f"({a} IS NULL OR contains(text, {a}) OR ({b} IS NOT NULL AND contains(text, {b})))" for a, b in slots)
    docs = parsed(docs, fields).select("*", _haystack(fields).alias("text"))
    return docs.join(_bounded(own, size, config), F.expr(f"text IS NULL OR ({may})") & clauses_match(F.col("clauses"), fields), "inner").select("doc_id", "qid")


def _none(docs: DataFrame) -> DataFrame:
    return docs.where("false").select("doc_id", F.lit(0).cast("bigint").alias("qid"))


def _compiled(docs: DataFrame, queries: Iterable[tuple[int, Query]]) -> DataFrame:
    """Queries as expressions over their distinct atoms, ``COMPILED_QUERIES`` in one pass over the documents."""
    out, left = None, iter(queries)
    while some := list(islice(left, COMPILED_QUERIES)):
        got = _expression(docs, some)
        out = got if out is None else out.unionByName(got)
    return _none(docs) if out is None else out


#: A null that has no generated code.  It keeps a projection of many expressions out of the code of its stage, where
#: they'd be one method, too large for the JVM to compile; a projection on its own splits them.
_APART = "get(transform(array(doc_id), x -> CAST(NULL AS {})), 0)"


def _expression(docs: DataFrame, queries: list[tuple[int, Query]]) -> DataFrame:
    atoms: dict[Literal, int] = {}

    def literal(x: Literal) -> str:
        return f"{'NOT ' * x.neg}atoms[{atoms.setdefault(replace(x, neg=False), len(atoms))}]"

    def clause(c: Clause) -> str:
        return f"({' OR '.join(dict.fromkeys(map(literal, c.literals))) or 'false'})"

    each = [f"CASE WHEN {' AND '.join(dict.fromkeys(map(clause, q.clauses))) or 'true'} THEN {i}L END" for i, q in queries]
    operands: dict[str, str] = {}
    true = [literal_sql(x, operands.setdefault(operand_sql(x), f"o{len(operands)}")) for x in atoms]
    found = parsed(docs, needs(q for _, q in queries)).select("doc_id", *(F.expr(e).alias(name) for e, name in operands.items()))
    found = found.select("doc_id", F.expr(f"array({', '.join([*true, _APART.format('boolean')])})").alias("atoms"))
    # exploded, as the elements of a plain array would be computed again for each query
    found = found.select("doc_id", F.explode(F.array("atoms")).alias("atoms"))
    found = found.select("doc_id", F.expr(f"array({', '.join([*each, _APART.format('bigint')])})").alias("qids"))
    return found.select("doc_id", F.explode(F.array_compact("qids")).alias("qid"))


def document_keys(docs: DataFrame, classes: Iterable[Classes]) -> DataFrame:
    """The columns of a ``parsed`` document and keys, the distinct hashes that the combinations of classes find in it."""
    classes = list(classes)
    single = sorted({e for c in classes for e in c})
    names = {e: f"k{i}" for i, e in enumerate(single)}
    docs = docs.select("*", *(e.keys().alias(names[e]) for e in single))

    def folded(c: Classes) -> Column:
        got = F.col(names[c[0]])
        for e in c[1:]:
            got = F.flatten(F.transform(got, lambda a: F.transform(names[e], lambda b: F.xxhash64(a, b))))  # noqa: B023
        return got

    return docs.select("doc_id", "f", "fi", "fc", "fg", F.array_distinct(F.concat(*map(folded, classes))).alias("keys"))


@dataclass(frozen=True)
class Prepared:
    """Queries with their anchors, which ``prepare`` makes once for any number of batches.

    keys has key, qid and at (the key's place among the query's), own has qid, qkeys and clauses.
    """

    keys: pa.Table
    own: pa.Table
    n_literals: int
    fields: dict[str, set[str]]
    classes: list[Classes]
    always: list[tuple[int, Query]]
    config: EngineConfig

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """keys and own, broadcast if they are small enough."""
        n = self.keys.num_rows
        return _bounded(spark.createDataFrame(self.keys), KEY_BYTES * n, self.config), _bounded(spark.createDataFrame(self.own), LITERAL_BYTES * self.n_literals + 8 * n, self.config)


def prepare(queries: Iterable[tuple[int, Query]], config: EngineConfig | None = None, seen: Mapping[tuple[str, str], float] | None = None) -> Prepared:
    """Choose the anchors of all queries; ``seen`` has shares of documents for frequent (field, value) pairs."""
    config, by_id = config or EngineConfig(), dict(queries)
    anchors = choose(by_id.items(), config, seen)
    flat = [(k, i, at) for i, ks in anchors.keys.items() for at, k in enumerate(ks)]
    ids = list(anchors.keys)
    keys = pa.table({"key": pa.array([x[0] for x in flat], pa.int64()), "qid": pa.array([x[1] for x in flat], pa.int64()), "at": pa.array([x[2] for x in flat], pa.int32())})
    own = pa.table({"qid": pa.array(ids, pa.int64()), "qkeys": pa.array([anchors.keys[i] for i in ids], pa.list_(pa.int64())), "clauses": _clauses(by_id[i] for i in ids)})
    anchored = [by_id[i] for i in ids]
    return Prepared(keys, own, _literals(anchored), needs(anchored), anchors.classes, [(i, by_id[i]) for i in anchors.always], config)


_FIRST = "at = 0 OR NOT arrays_overlap(keys, slice(qkeys, 1, at))"


def _probe(docs: DataFrame, classes: Iterable[Classes]) -> DataFrame:
    # outer, as an inner one adds a filter that computes the keys again
    return document_keys(docs, classes).select("*", F.explode_outer("keys").alias("key"))


def _anchored(docs: DataFrame, found: Prepared, residual: bool = True) -> DataFrame:
    keys, own = found.frames(docs.sparkSession)
    got = _probe(parsed(docs, found.fields), found.classes).join(keys, "key").join(own, "qid").where(_FIRST)
    return (got.where(clauses_match(F.col("clauses"), found.fields)) if residual else got).select("doc_id", "qid")


def percolate(docs: DataFrame, queries: Iterable[tuple[int, Query]] | Prepared, strategy: str = "anchor", config: EngineConfig | None = None, seen: Mapping[tuple[str, str], float] | None = None) -> DataFrame:
    """doc_id, qid of all matching pairs; ``docs`` has doc_id and f, and may be a stream.  ``queries`` that were
    prepared have their configuration with them."""
    docs = docs.select("doc_id", "f")
    if strategy == "compiled":
        return _compiled(docs, queries)
    if strategy == "cross":
        return _cross(docs, list(queries), config or EngineConfig())
    if strategy != "anchor":
        raise ValueError(strategy)
    found = queries if isinstance(queries, Prepared) else prepare(queries, config, seen)
    parts = [_anchored(docs, found)] if found.classes else []
    if found.always or not parts:
        parts.append(_compiled(docs, found.always))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def candidates(docs: DataFrame, queries: Iterable[tuple[int, Query]] | Prepared, config: EngineConfig | None = None, seen: Mapping[tuple[str, str], float] | None = None) -> DataFrame:
    """doc_id, qid of the anchor join before the residual, for measuring how selective anchors are."""
    found = queries if isinstance(queries, Prepared) else prepare(queries, config, seen)
    docs = docs.select("doc_id", "f")
    return _anchored(docs, found, residual=False) if found.classes else _none(docs)


def table_keys(corpus: DataFrame, config: EngineConfig, costs: Costs) -> DataFrame:
    """qid, one and many: the combinations of classes (JSON) and the keys of each query's anchors, null without any."""
    ship(corpus.sparkSession)

    def told(keys: list[tuple[Classes, int]]) -> tuple[str, list[int]]:
        names = sorted({c for c, _ in keys})
        return json.dumps([[[e.kind, e.field, e.param] for e in c] for c in names]), list(dict.fromkeys(h for _, h in keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [query_keys(from_rows(c), config, costs) for c in b.column(1).to_pylist()]
            one, many = ([told(getattr(k, name)) if k else (None, None) for k in got] for name in ("one", "many"))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in part], kind) for part in (one, many) for i, kind in enumerate((pa.string(), pa.list_(pa.int64()))))], ["qid", "one_of", "one", "many_of", "many"])

    return corpus.select("qid", "clauses").mapInArrow(run, "qid bigint, one_of string, one array<bigint>, many_of string, many array<bigint>")


def percolate_table(docs: DataFrame, corpus: DataFrame, config: EngineConfig | None = None, seen: Mapping[tuple[str, str], float] | None = None) -> DataFrame:
    """doc_id, qid of all matching pairs, for a corpus with qid and clauses (and active) as ``query_frame`` gives it.

    The driver gets the numbers of values that queries name for each field, the combinations of classes
    that are used, and the queries that can't be anchored.
    """
    config = config or EngineConfig()
    corpus = corpus.where("active") if "active" in corpus.columns else corpus
    literals = corpus.select(F.explode(F.flatten("clauses")).alias("l")).select("l.*")
    fields: dict[str, set[str]] = {}
    for r in literals.select("kind", "field").distinct().collect():  # bounded by the fields of documents
        fields.setdefault(r["kind"], set()).add(r["field"])
    named = literals.where("kind = 'term'").groupBy("field").agg(F.approx_count_distinct("val").alias("n")).collect()
    keys = table_keys(corpus, config, Costs(seen, {r["field"]: r["n"] for r in named}))
    told = lambda text: frozenset(tuple(Extractor(*e) for e in c) for c in json.loads(text))
    used = {r["many_of"]: (told(r["many_of"]), r["n"]) for r in keys.where("one_of IS NOT NULL").groupBy("many_of").agg(F.count("*").alias("n")).collect()}
    picked = pick({c: n for c, n in used.values() if any(len(x) > 1 for x in c)})
    wide = [text for text, (c, _) in used.items() if c in picked]
    chosen = keys.select("qid", F.when(F.col("many_of").isin(wide), F.col("many")).otherwise(F.col("one")).alias("qkeys"), F.when(F.col("many_of").isin(wide), F.col("many_of")).otherwise(F.col("one_of")).alias("of"))
    classes = set().union(*(told(r["of"]) for r in chosen.where("of IS NOT NULL").select("of").distinct().collect()))
    docs = docs.select("doc_id", "f")
    always = chosen.where("qkeys IS NULL").join(corpus.select("qid", "clauses"), "qid").select("qid", "clauses")
    out = _compiled(docs, ((r["qid"], from_rows(r["clauses"])) for r in always.toLocalIterator()))
    if not classes:
        return out
    anchored = chosen.where("qkeys IS NOT NULL")
    n_keys, n_literals = anchored.join(corpus.select("qid", F.size(F.flatten("clauses")).alias("n")), "qid").agg(F.sum(F.size("qkeys")), F.sum("n")).first()
    rows_ = _bounded(anchored.select("qid", F.posexplode("qkeys").alias("at", "key")), KEY_BYTES * n_keys, config)
    own = _bounded(anchored.select("qid", "qkeys").join(corpus.select("qid", "clauses"), "qid"), LITERAL_BYTES * n_literals + 8 * n_keys, config)
    got = _probe(parsed(docs, fields), sorted(classes)).join(rows_, "key").join(own, "qid").where(_FIRST)
    return got.where(clauses_match(F.col("clauses"), fields)).select("doc_id", "qid").unionByName(out)


__all__ = ["CLAUSES", "LITERAL", "Prepared", "candidates", "document_keys", "frequent_values", "match_all", "matches", "percolate", "percolate_table", "prepare", "query_frame", "search", "table_keys"]
