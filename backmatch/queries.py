"""The registered queries of the engine, each with SQL that gives the same rows.

The SQL is written from the query algebra for a table whose columns are the
fields: a positive atom over a null column is false, a negated one true.
"""

from __future__ import annotations

import random
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parser
from .functions import geo
from .operators import percolate as P
from .operators import stats
from .operators.store import Percolator, PercolatorError
from .query import INT_KINDS, Clause, Query, field
from .sources import documents as D
from .streaming.percolate import percolate_stream
from .testing import random_ast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; only a session on one machine may do without it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{at or tempfile.mkdtemp()}/engine-{random.randrange(2**60)}"


# -- SQL of queries

_quoted = lambda s: "'" + s.replace("'", "''") + "'"


def _sql_atom(x, columns: dict[str, str]) -> str:
    if x.kind == "all":
        return "true"
    v = columns.get(x.field)
    if v is None:
        return "false"
    if x.kind == "term":
        got = f"{v} = {_quoted(x.val)}"
    elif x.kind == "prefix":
        got = f"starts_with({v}, {_quoted(x.val)})"
    elif x.kind in INT_KINDS:
        got = f"CASE WHEN regexp_full_match({v}, '[+-]?[0-9]+') THEN try_cast({v} AS BIGINT) END {INT_KINDS[x.kind].replace('==', '=')} {x.num}"
    elif x.kind == "h3":
        c, res = f"cast('0x' || {v} AS UBIGINT)", geo.resolution(x.num)
        got = f"((({c} >> 52) & 15) >= {res} AND (({c} & {~(15 << 52) & (2**64 - 1)}::UBIGINT) | {res << 52}::UBIGINT | {(1 << 3 * (15 - res)) - 1}::UBIGINT) = {x.num}::UBIGINT)"
    else:
        lat, lng = (f"cast(split_part({v}, ',', {i}) AS DOUBLE)" for i in (1, 2))
        h = f"pow(sin(radians({x.lat} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({x.lat})) * pow(sin(radians({x.lng} - {lng}) / 2), 2)"
        got = f"{2 * geo.RADIUS_M} * asin(sqrt(least(1.0, {h}))) <= {x.radius}"
    return f"coalesce({got}, false)"


def sql_predicate(q: Query, columns: dict[str, str]) -> str:
    clause = lambda c: "(" + " OR ".join(f"{'NOT ' * x.neg}{_sql_atom(x, columns)}" for x in c.literals) + ")" if c.literals else "false"
    return " AND ".join(map(clause, q.clauses)) or "true"


def sql_union(queries: list[tuple[int, Query]], source: str, key: str, columns: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(f"SELECT {key} AS doc_id, {i}::BIGINT AS qid FROM {source} WHERE {sql_predicate(q, columns)}" for i, q in queries)


# -- document views of the tables: Spark SQL and DuckDB SQL for the same fields



def _cell_number(key: str, spark: bool):
    """A cell made of a key: base cell key % 100 moved past pentagons, resolution 3 + key % 7, digits from the key."""
    e = f"({key})"
    base = f"(CASE WHEN {e} % 100 IN (4,14,24,38,49,58,63,72,83,97) THEN {e} % 100 + 1 ELSE {e} % 100 END)"
    res = f"(3 + {e} % 7)"
    big = "BIGINT"
    shift = (lambda a, n: f"shiftleft(cast({a} AS BIGINT), cast({n} AS INT))") if spark else (lambda a, n: f"(({a})::BIGINT << ({n})::INT)")
    digit = lambda i: f"(CASE WHEN {i} <= {res} THEN (({e} * 7 + {i} * {i}) % 7) ELSE 7 END)"
    parts = [shift("1", 59), shift(res, 52), shift(base, 45), *(shift(digit(i), 3 * (15 - i)) for i in range(1, 16))]
    return " + ".join(f"cast({p} AS {big})" for p in parts)


_CELL_SQL = f"printf('%x', {_cell_number('c_custkey', False)})"
_CELL = f"lower(hex({_cell_number('c_custkey', True)}))"
_LAT = lambda s: f"cast(40 + (c_custkey * 37) % 15 AS {s}) || '.' || lpad(cast((c_custkey * 7919) % 1000 AS {s}), 3, '0')"
_LNG = lambda s: f"cast((c_custkey * 53) % 20 AS {s}) || '.' || lpad(cast((c_custkey * 104729) % 1000 AS {s}), 3, '0')"

VIEWS: dict[str, tuple] = {
    "events": ("event_id", {"type": "event_type", "k": "get_json_object(props, '$.k')", "user": "cast(user_id AS STRING)"}, "events", {"type": "event_type", "k": "json_extract_string(props, '$.k')", "user": "cast(user_id AS VARCHAR)"}),
    "documents": ("doc_id", {"lang": "lang", "source": "source", "long": "CASE WHEN n_chars > 2000 THEN 'yes' END"}, "documents", {"lang": "lang", "source": "source", "long": "CASE WHEN n_chars > 2000 THEN 'yes' END"}),
    "part": ("p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "cast(p_size AS STRING)", "odd": ("CASE p_partkey % 6 WHEN 0 THEN concat('00', p_size) WHEN 1 THEN concat(' ', p_size) WHEN 2 THEN concat(p_size, '.5') WHEN 3 THEN concat('+', p_size) WHEN 4 THEN '' ELSE '99999999999999999999' END")}, "part", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "cast(p_size AS VARCHAR)", "odd": "CASE p_partkey % 6 WHEN 0 THEN '00' || p_size WHEN 1 THEN ' ' || p_size WHEN 2 THEN p_size || '.5' WHEN 3 THEN '+' || p_size WHEN 4 THEN '' ELSE '99999999999999999999' END"}),
    "pages": ("page_id", {"url": "concat('é', url)"}, "pages", {"url": "'é' || url"}),
    "customer": ("c_custkey", {"cell": _CELL, "at": f"{_LAT('STRING')} || ',' || {_LNG('STRING')}", "segment": "c_mktsegment"}, "customer", {"cell": _CELL_SQL, "at": f"{_LAT('VARCHAR')} || ',' || {_LNG('VARCHAR')}", "segment": "c_mktsegment"}),
}


def docs_of(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    key, fields, name, _ = VIEWS[view]
    return D.to_documents(table(spark, sf_dir, name), key, _columns(fields))


def _columns(fields: dict[str, str]) -> dict:
    return {k: F.expr(e) for k, e in fields.items()}


def _cell(key: int, res: int) -> int:
    """The ancestor at ``res`` of the cell made of a key."""
    base = key % 100 + (key % 100 in (4, 14, 24, 38, 49, 58, 63, 72, 83, 97))
    own = 3 + key % 7
    c = 1 << 59 | own << 52 | base << 45
    for i in range(1, 16):
        c |= ((key * 7 + i * i) % 7 if i <= own else 7) << 3 * (15 - i)
    return geo.parent(c, res)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, view: str, found: list[Query], strategy: str = "anchor") -> None:
    numbered = list(enumerate(found))
    key, _, source, columns = VIEWS[view]
    QUERIES[name] = lambda spark, sf: P.percolate(docs_of(spark, sf, view), numbered, strategy)
    ORACLE_SQL[name] = sql_union(numbered, source, key, columns)


_type, _kf, _user, _lang, _source, _long = (field(x) for x in ("type", "k", "user", "lang", "source", "long"))
_name, _brand, _ptype, _size, _odd, _url, _cellf, _at, _seg = (field(x) for x in ("name", "brand", "type", "size", "odd", "url", "cell", "at", "segment"))

_register("term", "events", [_type.has_value(x) for x in ("signup", "purchase", "error", "view", "click", "Click")])
_register("absent_field", "documents", [~field("none").has_value("x"), _long.has_value("yes"), ~_long.has_value("yes"), ~_long.has_value("yes") & _lang.has_value("de")])
_register("prefix", "part", [_name.has_prefix(x) for x in ("s", "small", "small ring", "SMALL")] + [_ptype.has_prefix("STAND") & ~_brand.has_prefix("Brand#1")])
_register("prefix_empty", "documents", [_long.has_prefix(""), ~_long.has_prefix("")])
_register("prefix_utf8", "pages", [_url.has_prefix("é"), _url.has_prefix("éhttps://"), _url.has_prefix("e")])
for _kind in INT_KINDS:
    _register(f"int_{_kind}", "events", [_kf._int(_kind, n) for n in (-1, 0, 10, 57, 99)] + [_user._int(_kind, 500)])
_register("int_bad_text", "part", [_odd.i64_ge(0), _odd.i64_eq(7), _odd.i64_lt(20), ~_odd.i64_lt(20), _odd.i64_gt(2**62)])
_register("and", "events", [_type.has_value("click") & _kf.i64_lt(50), _type.has_value("view") & _kf.i64_ge(10) & _user.has_prefix("1")])
_register("or", "part", [_brand.has_value("Brand#11") | _size.i64_eq(7), _name.has_prefix("s") | _ptype.has_prefix("ECO") | _size.i64_gt(40)])
_register("not", "part", [~_brand.has_value("Brand#11"), ~_size.i64_lt(10), ~(_name.has_prefix("s") & _size.i64_gt(5))])
_register("nested_not", "part", [~((_name.has_prefix("s") & _size.i64_gt(5)) | ~_ptype.has_prefix("P")), ~~_size.i64_le(3)])
_register("contradiction", "events", [_type.has_value("click") & ~_type.has_value("click")])
_register("match_all", "events", [Query(), ~Query(), Query() & _type.has_value("error")])
_register("h3in", "customer", [_cellf.h3in(_cell(k, r)) for k in (8, 17, 123) for r in (0, 2, 3, 5) if _cell(k, r)] + [~_cellf.h3in(_cell(17, 1))])
_register("latlng_within", "customer", [_at.latlng_within(48.86471, 2.34901, m) for m in (1, 50_000, 400_000)] + [_at.latlng_within(41.5, 19.5, 90_000), ~_at.latlng_within(50.1, 8.6, 700_000), _at.latlng_within(48.0, 179.0, 12_000_000)])
_TEXTS = ["type:click AND k<50", "NOT type:click OR k>=90", "(type:view OR type:error) AND NOT (k<10 OR k>80)", 'user:"1"* AND k=7', "k:007", "k<abc OR type:sign*", "NOT NOT type:purchase", "type:click AND (user<100 OR user>=900)"]
_register("parsed", "events", [parser.parse_query(t) for t in _TEXTS])
_register("parsed_geo", "customer", [parser.parse_query(t) for t in (f"cell H3IN {_cell(17, 2):x}", "at LLWITHIN 48.86471,2.34901,300000 AND segment:BUILDING", "cell H3IN nothex OR segment:MACHINERY")])


def generated(n: int, seed: int = 42) -> list[tuple[int, Query]]:
    """Queries over ``events`` such as alerts would be: a type, a user or a prefix of it, a bound, at times a negation."""
    rng, out = random.Random(seed), []
    for i in range(n):
        q = _user.has_value(str(rng.randrange(1000))) if rng.random() < 0.7 else _user.has_prefix(str(rng.randrange(10, 100)))
        q &= _type.has_value(rng.choice(("signup", "purchase", "error", "view", "click")))
        q &= getattr(_kf, rng.choice(("i64_lt", "i64_ge")))(rng.randrange(100))
        if rng.random() < 0.2:
            q |= _type.has_value("error") & _kf.i64_eq(rng.randrange(100)) & ~_user.has_prefix(str(rng.randrange(1, 10)))
        if rng.random() < 0.02:
            q = ~_type.has_value("view") & ~_user.has_prefix(str(rng.randrange(1, 10))) & ~_kf.i64_gt(rng.randrange(5))
        out.append((i, q))
    return out


for _name_, _strategy in (("percolate_anchor", "anchor"), ("percolate_cross", "cross"), ("percolate_compiled", "compiled")):
    _register(_name_, "events", [q for _, q in generated(200)], _strategy)

_DUAL = (_lang.has_value("fr") | _source.has_value("src3")) & ~_long.has_value("yes")
QUERIES["search_dual"] = lambda spark, sf: P.search(docs_of(spark, sf, "documents"), _DUAL).select("doc_id")
ORACLE_SQL["search_dual"] = f"SELECT doc_id FROM documents WHERE {sql_predicate(_DUAL, VIEWS['documents'][3])}"


_register("match_all_atom", "events", [q for m in [Query((Clause.match_all(),))] for q in (m, m & _type.has_value("error"), ~m, m | _type.has_value("view"))])
_register("from_clauses", "part", [Query((Clause.from_clauses([*_brand.has_value("Brand#11").clauses, *(~_size.i64_lt(45)).clauses, *_name.has_prefix("small").clauses]),))])
_register("from_clauses_twice", "part", [Query((Clause.from_clauses([*_size.i64_eq(7).clauses, *_size.i64_eq(7).clauses]).cleansed(),)), Query((Clause(()),))])


def _random_formulas(n: int) -> list[Query]:
    """Random formulas over the fields of ``part``, of every operator that fits them."""
    rng = random.Random(5)
    texts = {"name": ("small ring", "s", "large", "medium b"), "brand": ("Brand#11", "Brand#2", "Brand#33", "B"), "type": ("ECONOMY", "PROMO", "STANDARD", "S")}

    def atom(r: random.Random) -> parser.Atom:
        if r.random() < 0.45:
            return parser.Atom(r.choice(("size", "odd")), r.choice(("<", "<=", "=", ">=", ">")), parser.Value("integer", r.randrange(-1, 52)))
        name = r.choice(list(texts))
        return parser.Atom(name, ":", parser.Value(r.choice(("term", "prefix", "prefix")), r.choice(texts[name])))

    return [random_ast(rng, rng.randint(1, 4), atom).to_query() for _ in range(n)]


_register("random_queries", "part", _random_formulas(60))


# -- multi-valued documents

_PRIORITY = field("priority")
_MULTI = [(0, _PRIORITY.has_value("1-URGENT")), (1, _PRIORITY.has_value("1-URGENT") & _PRIORITY.has_value("5-LOW")), (2, ~_PRIORITY.has_prefix("2")), (3, _PRIORITY.has_prefix("4") | _PRIORITY.has_prefix("3"))]


def _order_documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.from_pairs(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")))


def _multi_sql() -> str:
    some = lambda x: f"bool_or({'o_orderpriority = ' + _quoted(x.val) if x.kind == 'term' else f'starts_with(o_orderpriority, {_quoted(x.val)})'})"
    where = lambda q: " AND ".join("(" + " OR ".join(f"{'NOT ' * x.neg}{some(x)}" for x in c.literals) + ")" for c in q.clauses)
    return "\nUNION ALL\n".join(f"SELECT o_custkey AS doc_id, {i}::BIGINT AS qid FROM orders GROUP BY o_custkey HAVING {where(q)}" for i, q in _MULTI)


QUERIES["term_multi_value"] = lambda spark, sf: P.percolate(_order_documents(spark, sf), _MULTI)
ORACLE_SQL["term_multi_value"] = _multi_sql()

QUERIES["field_values"] = lambda spark, sf: D.field_values(_order_documents(spark, sf))
ORACLE_SQL["field_values"] = "SELECT o_custkey AS doc_id, 'priority' AS field, o_orderpriority AS value FROM orders"

QUERIES["fv_count"] = lambda spark, sf: _order_documents(spark, sf).select("doc_id", D.fv_count(F.col("f")).alias("fv_count"), F.size("f").cast("bigint").alias("n_fields"))
ORACLE_SQL["fv_count"] = "SELECT o_custkey AS doc_id, count(*) AS fv_count, 1::BIGINT AS n_fields FROM orders GROUP BY o_custkey"


def _merge_docs(spark: SparkSession, sf: str) -> DataFrame:
    own = D.to_documents(table(spark, sf, "customer"), "c_custkey", {"priority": F.lit("1-URGENT"), "segment": F.col("c_mktsegment")}).select("doc_id", F.col("f").alias("g"))
    both = own.join(_order_documents(spark, sf), "doc_id", "left").select("doc_id", D.merged(F.col("g"), F.coalesce("f", F.create_map().cast(D.FIELDS))).alias("f"))
    return D.field_values(both)


QUERIES["merge_docs"] = _merge_docs
ORACLE_SQL["merge_docs"] = "SELECT o_custkey AS doc_id, 'priority' AS field, o_orderpriority AS value FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) UNION SELECT c_custkey, 'priority', '1-URGENT' FROM customer UNION SELECT c_custkey, 'segment', c_mktsegment FROM customer"


# -- the store

_A, _B, _C = _type.has_value("click"), _type.has_value("view") & _kf.i64_lt(30), ~_type.has_value("error") & _kf.i64_gt(90)


def _stored() -> Percolator:
    p = Percolator()
    for uid, q in ((10, _A), (20, _B), (30, _C)):
        p.index_query_uid(q, uid)
    return p


def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = _stored()
    p.index_query_uid(_B, 10)
    return p.percolate(docs_of(spark, sf, "events"))


def _remove(spark: SparkSession, sf: str) -> DataFrame:
    p = _stored()
    p.remove_uid(20)
    return p.percolate(docs_of(spark, sf, "events"))


def _compact(spark: SparkSession, sf: str) -> DataFrame:
    p = _stored()
    p.index_query_uid(_C, 20)
    p.remove_uid(10)
    return p.optimized().percolate(docs_of(spark, sf, "events"))


def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    p = _stored()
    p.remove_uid(30)
    at = scratch(spark)
    p.save(spark, at)
    return Percolator.load(spark, at).percolate(docs_of(spark, sf, "events"))


def _store_sql(live: dict[int, Query]) -> str:
    return sql_union(list(live.items()), "events", "event_id", VIEWS["events"][3]).replace(" AS qid", " AS uid")


for _n, _f, _live in (("upsert", _upsert, {10: _B, 20: _B, 30: _C}), ("remove", _remove, {10: _A, 30: _C}), ("compact", _compact, {20: _C, 30: _C}), ("roundtrip", _roundtrip, {10: _A, 20: _B})):
    QUERIES[_n] = _f
    ORACLE_SQL[_n] = _store_sql(_live)


def _string_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = Percolator()
    for uid, q in (("clicks", _A), ("views <30", _B), ("é", _C)):
        p.index_query_uid(q, uid)
    return p.percolate(docs_of(spark, sf, "events"))


def _mixed_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = Percolator()
    for uid, q in ((7, _A), ("seven", _B)):
        p.index_query_uid(q, uid)
    return p.percolate(docs_of(spark, sf, "events"))


def _add_query(spark: SparkSession, sf: str) -> DataFrame:
    p = Percolator()
    p.index_query_uid(_C, 1)  # an id that add_query must pass over
    ids = [p.add_query(q) for q in (_A, _B)]
    found = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "uid bigint, place bigint")
    return p.percolate(docs_of(spark, sf, "events")).join(F.broadcast(found), "uid")


def _builder(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for k, settings in enumerate(({"n_clause_matchers": 1}, {"n_clause_matchers": 2, "prefix_sizes": (1, 3)}, {"broadcast_bytes": 0})):
        p = Percolator.builder(**settings)
        for q in (_name.has_prefix("small") & _size.i64_lt(20), _ptype.has_prefix("ST") | _brand.has_value("Brand#11")):
            p.add_query(q)
        got = p.percolate(docs_of(spark, sf, "part")).withColumn("settings", F.lit(k).cast("bigint"))
        out = got if out is None else out.unionByName(got)
    return out


def _optimized(spark: SparkSession, sf: str) -> DataFrame:
    """With frequent values of half of the documents, saved, and matched as a table."""
    p, docs, at = _stored(), docs_of(spark, sf, "events"), scratch(spark)
    p.optimized(docs, fraction=0.5).save(spark, at)
    return Percolator.percolate_saved(docs, at).select("doc_id", F.col("uid").cast("bigint").alias("uid"))


for _n, _f, _live in (("string_ids", _string_ids, {"'clicks'": _A, "'views <30'": _B, "'é'": _C}), ("mixed_ids", _mixed_ids, {"'7'": _A, "'seven'": _B}), ("optimized_saved", _optimized, {10: _A, 20: _B, 30: _C})):
    QUERIES[_n] = _f
    ORACLE_SQL[_n] = "\nUNION ALL\n".join(f"SELECT event_id AS doc_id, {u}{'::BIGINT' if isinstance(u, int) else ''} AS uid FROM events WHERE {sql_predicate(q, VIEWS['events'][3])}" for u, q in _live.items())
QUERIES["add_query"] = _add_query
ORACLE_SQL["add_query"] = "\nUNION ALL\n".join(f"SELECT event_id AS doc_id, {u}::BIGINT AS uid, {k}::BIGINT AS place FROM events WHERE {sql_predicate(q, VIEWS['events'][3])}" for k, (u, q) in enumerate(((2, _A), (3, _B))))
QUERIES["builder"] = _builder
ORACLE_SQL["builder"] = "\nUNION ALL\n".join(f"SELECT p_partkey AS doc_id, {i}::BIGINT AS uid, {k}::BIGINT AS settings FROM part WHERE {sql_predicate(q, VIEWS['part'][3])}" for k in range(3) for i, q in enumerate((_name.has_prefix("small") & _size.i64_lt(20), _ptype.has_prefix("ST") | _brand.has_value("Brand#11"))))

QUERIES["percolate_table"] = lambda spark, sf: P.percolate_table(docs_of(spark, sf, "part"), _corpus(spark, sf).where("qid <= 60"))
ORACLE_SQL["percolate_table"] = "SELECT d.p_partkey AS doc_id, q.p_partkey AS qid FROM part d JOIN part q ON q.p_partkey <= 60 AND q.p_partkey % 5 <> 0 AND d.p_brand = q.p_brand AND d.p_size < q.p_size AND (q.p_partkey % 3 <> 0 OR starts_with(d.p_name, q.p_name) = (q.p_partkey % 2 <> 0))"

_RARE = [(0, _type.has_value("click") & _user.has_value("7")), (1, _type.has_value("view") & _kf.i64_eq(3)), (2, _user.has_prefix("99") & ~_type.has_value("view"))]
QUERIES["candidates"] = lambda spark, sf: P.candidates(docs_of(spark, sf, "events"), _RARE[:2], seen={("type", "click"): 0.2, ("type", "view"): 0.2})
ORACLE_SQL["candidates"] = sql_union(_RARE[:2], "events", "event_id", VIEWS["events"][3])  # plain values leave no false candidate
QUERIES["candidates_hold_all_matches"] = lambda spark, sf: P.percolate(docs_of(spark, sf, "events"), _RARE).join(P.candidates(docs_of(spark, sf, "events"), _RARE), ["doc_id", "qid"], "left_semi")
ORACLE_SQL["candidates_hold_all_matches"] = sql_union(_RARE, "events", "event_id", VIEWS["events"][3])


# -- what the driver does with single queries and documents, for each nation

def _per_nation(spark: SparkSession, sf: str, schema: str, rows: Callable[[int, str], Iterable[tuple]]) -> DataFrame:
    """``rows`` of each nation's key and name; there are 25 of them at any scale."""
    found = table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    return spark.createDataFrame([r for k, n in found for r in rows(k, n)], schema)


def _register_nations(name: str, schema: str, rows: Callable[[int, str], Iterable[tuple]], sql: str) -> None:
    QUERIES[name] = lambda spark, sf: _per_nation(spark, sf, schema, rows)
    ORACLE_SQL[name] = sql


_nation = field("nation")
_register_nations("display", "k int, shown string", lambda k, n: [(k, str(((~_nation.has_value(n)) | field("area").i64_ge(k)) & field("code").has_prefix(n[:2])))], "SELECT n_nationkey AS k, '(AND (OR area>=' || n_nationkey || ' ~nation=' || n_name || ') (OR code=' || n_name[1:2] || '*))' AS shown FROM nation")
_register_nations("equality", "k int, same boolean, swapped boolean", lambda k, n: [(k, (_nation.has_value(n) & _kf.i64_eq(k)) == (_nation.has_value(n) & _kf.i64_eq(k % 10)), (_nation.has_value(n) & _kf.i64_eq(k)) == (_kf.i64_eq(k) & _nation.has_value(n)))], "SELECT n_nationkey AS k, n_nationkey < 10 AS same, false AS swapped FROM nation")
_register_nations("prefix_queries", "k int, prefix string", lambda k, n: [(k, x.val) for x in ((_nation.has_prefix(n[:3]) | _kf.i64_eq(k)) & ~_nation.has_prefix(n)).prefix_queries()], "SELECT n_nationkey AS k, unnest([n_name[1:3], n_name]) AS prefix FROM nation")
_register_nations("ast_display", "k int, shown string", lambda k, n: [(k, str(parser.parse_ast(f'a:{n.split()[0]} AND  NOT(b<{k} OR c:"{n} ""*)'.replace('""', '\\""'))))], """SELECT n_nationkey AS k, '( a:' || string_split(n_name, ' ')[1] || ' AND NOT ( b<' || n_nationkey || ' OR c:"' || n_name || ' \\""* ) )' AS shown FROM nation""")
_register_nations("get_query", "k int, shown string, missing boolean", lambda k, n: [(k, str(_nations()[0].get_query(f"id-{k % 3}")), _nations()[0].safe_get_query(n) is None)], "SELECT n_nationkey AS k, '(AND (OR n==' || n_nationkey % 3 || '))' AS shown, true AS missing FROM nation")
_register_nations("safe_add", "k int, added boolean, kind string", lambda k, n: [(k, not isinstance(got, PercolatorError), getattr(got, "kind", None)) for got in [Percolator.builder(max_prefix=6).safe_add_query(_nation.has_prefix(n))]], "SELECT n_nationkey AS k, length(n_name) <= 6 AS added, CASE WHEN length(n_name) > 6 THEN 'prefix_too_long' END AS kind FROM nation")


def _nations() -> tuple[Percolator]:
    p = Percolator()
    for k in range(3):
        p.index_query_uid(field("n").i64_eq(k), f"id-{k}")
    return (p,)


def _built_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents made value by value; that of a region without a name stays empty."""
    found = table(spark, sf, "nation").collect()
    docs = [(r["n_nationkey"], D.Document().with_value("nation", r["n_name"]).with_value("region", r["n_regionkey"]).with_value("region", r["n_regionkey"])) for r in found]
    return D.documents(spark, [*docs, (-1, D.Document())])


QUERIES["with_value"] = lambda spark, sf: D.field_values(_built_documents(spark, sf))
ORACLE_SQL["with_value"] = "SELECT n_nationkey::BIGINT AS doc_id, 'nation' AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation, range(2)"
_ABOUT = [(0, field("nation").has_prefix("")), (1, ~field("nation").has_prefix("")), (2, ~field("region").i64_eq(1)), (3, Query())]
QUERIES["empty_document"] = lambda spark, sf: P.percolate(_built_documents(spark, sf), _ABOUT)
ORACLE_SQL["empty_document"] = "WITH d AS (SELECT n_nationkey::BIGINT AS doc_id, n_regionkey AS r FROM nation UNION ALL SELECT -1, NULL) SELECT doc_id, 0::BIGINT AS qid FROM d WHERE r IS NOT NULL UNION ALL SELECT doc_id, 1 FROM d WHERE r IS NULL UNION ALL SELECT doc_id, 2 FROM d WHERE coalesce(r, 0) <> 1 UNION ALL SELECT doc_id, 3 FROM d"


def _to_clause(spark: SparkSession, sf: str) -> DataFrame:
    """A document's values as one clause, by which other documents are found."""
    probes = enumerate(D.Document.of(p).to_clause() for p in ([("segment", "BUILDING"), ("segment", "MACHINERY")], [("segment", "HOUSEHOLD"), ("none", "x")], []))
    return P.percolate(docs_of(spark, sf, "customer"), [(i, Query((c,))) for i, c in probes])


QUERIES["to_clause"] = _to_clause
ORACLE_SQL["to_clause"] = "SELECT c_custkey AS doc_id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 ELSE 0 END::BIGINT AS qid FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"


def _store_of_parts(spark: SparkSession, sf: str) -> Percolator:
    """A query for each of the first 1,000 parts; every fifth is removed."""
    p = Percolator()
    for r in table(spark, sf, "part").where("p_partkey <= 1000").select("p_partkey", "p_size").collect():
        p.index_query_uid(_size.i64_eq(r["p_size"]), r["p_partkey"])
        if r["p_partkey"] % 5 == 0:
            p.remove_uid(r["p_partkey"])
    return p


QUERIES["holes_ratio"] = lambda spark, sf: spark.createDataFrame([(round(p.holes_ratio(), 9), round(p.compacted().holes_ratio(), 9), str(p)) for p in [_store_of_parts(spark, sf)]], "holes double, compacted double, shown string")
ORACLE_SQL["holes_ratio"] = "SELECT round(avg((p_partkey % 5 = 0)::INT), 9) AS holes, 0.0::DOUBLE AS compacted, 'Percolator-' || count(*) FILTER (p_partkey % 5 <> 0) || 'Qs/3CMs' AS shown FROM part WHERE p_partkey <= 1000"


# -- statistics of a corpus made of a table: a query for each part

def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """A clause for each of size, brand and, for some, a prefix of the name; every fifth is removed."""
    lit = lambda kind, name, val="cast(NULL AS STRING)", num="cast(NULL AS BIGINT)", neg="false": f"named_struct('neg', {neg}, 'kind', '{kind}', 'field', '{name}', 'val', {val}, 'num', {num}, 'lat', cast(NULL AS DOUBLE), 'lng', cast(NULL AS DOUBLE), 'radius', cast(NULL AS BIGINT))"
    clauses = f"filter(array(array({lit('term', 'brand', 'p_brand')}), array({lit('lt', 'size', num='cast(p_size AS BIGINT)')}), CASE WHEN p_partkey % 3 = 0 THEN array({lit('prefix', 'name', 'p_name', neg='p_partkey % 2 = 0')}) END), x -> x IS NOT NULL)"
    return table(spark, sf, "part").selectExpr("p_partkey AS qid", "p_partkey % 5 <> 0 AS active", f"{clauses} AS clauses")


QUERIES["stats_counts"] = lambda spark, sf: stats.corpus_counts(_corpus(spark, sf))
ORACLE_SQL["stats_counts"] = "SELECT count(*) AS n_queries, count(*) FILTER (p_partkey % 5 = 0) AS n_queries_removed, count(*) FILTER (p_partkey % 5 <> 0) AS n_live FROM part"
QUERIES["stats_clauses"] = lambda spark, sf: stats.clause_histogram(_corpus(spark, sf))
ORACLE_SQL["stats_clauses"] = "SELECT CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS n_clauses, count(*) AS n_queries FROM part GROUP BY 1"
QUERIES["stats_prefixes"] = lambda spark, sf: stats.prefix_histogram(_corpus(spark, sf))
ORACLE_SQL["stats_prefixes"] = "SELECT CASE WHEN n < 1 THEN -1 WHEN n >= 100 THEN 4 ELSE floor((n - 1) / 24.75) END::BIGINT AS bin, count(*) AS n FROM (SELECT strlen(p_name) AS n FROM part WHERE p_partkey % 3 = 0) GROUP BY 1"


_EXTRA = "(p_partkey % 3 = 0 AND p_partkey % 2 = 1)::BIGINT"  # an anchor by prefix, beside that by size
QUERIES["stats_preheaters"] = lambda spark, sf: stats.preheater_count(_corpus(spark, sf))
ORACLE_SQL["stats_preheaters"] = f"SELECT 1 + max({_EXTRA}) AS n_preheaters FROM part"
QUERIES["stats_preheaters_per_query"] = lambda spark, sf: stats.preheater_histogram(_corpus(spark, sf))
ORACLE_SQL["stats_preheaters_per_query"] = f"SELECT 1 + {_EXTRA} AS n_preheaters, count(*) AS n_queries FROM part GROUP BY 1"
QUERIES["stats_costs"] = lambda spark, sf: stats.clause_costs(_corpus(spark, sf))
ORACLE_SQL["stats_costs"] = "SELECT p_partkey AS qid, unnest([0, 1, 2])::BIGINT AS at, unnest([10, 1000, CASE WHEN p_partkey % 2 = 0 THEN 100000 ELSE 1000 END])::BIGINT AS cost FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, unnest([0, 1]), unnest([10, 1000]) FROM part WHERE p_partkey % 3 <> 0"
_rounded = lambda df: df.select("what", "count", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "min", "max")
QUERIES["stats_report"] = lambda spark, sf: _rounded(stats.report(_corpus(spark, sf)))
ORACLE_SQL["stats_report"] = f"SELECT what, count(*) AS count, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS stddev, min(n) AS min, max(n) AS max FROM (SELECT 'clauses per query' AS what, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS n FROM part UNION ALL SELECT 'further keys per query', 1 + {_EXTRA} FROM part UNION ALL SELECT 'prefix bytes', strlen(p_name) FROM part WHERE p_partkey % 3 = 0) GROUP BY what"
QUERIES["recommend_clause_matchers"] = lambda spark, sf: stats.recommended_cmcount(_corpus(spark, sf))
ORACLE_SQL["recommend_clause_matchers"] = "SELECT CASE WHEN avg((p_partkey % 3 <> 0)::INT) >= 0.9 THEN 2 ELSE 3 END::BIGINT AS n_clause_matchers FROM part"
QUERIES["recommend_prefix_sizes"] = lambda spark, sf: stats.recommended_prefix_sizes(_corpus(spark, sf))
ORACLE_SQL["recommend_prefix_sizes"] = "SELECT DISTINCT CASE WHEN bin < 0 THEN 0 ELSE ceil(1 + bin * 24.75) END::BIGINT AS prefix_size FROM (" + ORACLE_SQL["stats_prefixes"] + " ORDER BY n DESC, bin DESC LIMIT 4)"
QUERIES["stats_driver"] = lambda spark, sf: spark.createDataFrame([(s.n_queries, s.n_queries_removed, s.n_preheaters, s.clauses_per_query.max(), s.recommended_cmcount()) for s in [_store_of_parts(spark, sf).stats()]], "n_queries bigint, n_queries_removed bigint, n_preheaters bigint, most_clauses bigint, n_clause_matchers bigint")
ORACLE_SQL["stats_driver"] = "SELECT count(*) AS n_queries, count(*) FILTER (p_partkey % 5 = 0) AS n_queries_removed, 1::BIGINT AS n_preheaters, 1::BIGINT AS most_clauses, 1::BIGINT AS n_clause_matchers FROM part WHERE p_partkey <= 1000"
QUERIES["frequent_values"] = lambda spark, sf: spark.createDataFrame([(f, v, round(x, 9)) for (f, v), x in P.frequent_values(docs_of(spark, sf, "events").select("doc_id", F.map_filter("f", lambda k, v: k == "type").alias("f"))).items()], "field string, value string, share double")
ORACLE_SQL["frequent_values"] = "SELECT 'type' AS field, event_type AS value, round(count(*) / (SELECT count(*) FROM events), 9)::DOUBLE AS share FROM events GROUP BY event_type"


# -- streaming

def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """All of ``events`` through a stream, its output read back."""
    key, fields, name, _ = VIEWS["events"]
    schema = table(spark, sf, name).schema
    at = scratch(spark)
    source = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    out = percolate_stream(D.to_documents(source, key, _columns(fields)), enumerate(map(parser.parse_query, _TEXTS)))
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id bigint, qid bigint").parquet(f"{at}/out")


QUERIES["stream_percolate"] = _stream
ORACLE_SQL["stream_percolate"] = ORACLE_SQL["parsed"]
