"""The engine: every kind of atom, strategies against the definition, the store."""

import math
import random

import pytest
from backmatch import Clause, Document, EngineConfig, Percolator, PercolatorError, Query, field, match_all, percolate, search
from backmatch.functions import geo
from backmatch.functions.predicates import text_sql
from backmatch.operators import stats
from backmatch.operators.percolate import candidates, frequent_values, percolate_table, query_frame
from backmatch.plans.anchors import Extractor, choose, combined
from backmatch.sources import documents as D
from backmatch.streaming.percolate import each_batch, percolate_stream
from backmatch.testing import random_cell, random_offer, random_offer_query
from pyspark.sql import functions as F

SHELF, TITLE, PAGES, SPOT, AT = (field(n) for n in ("shelf", "title", "pages", "spot", "at"))
top, low = SHELF.has_value("top"), SHELF.has_value("low")
CELL = geo.parse_cell("8928308280fffff")
UP = [f"{geo.parent(CELL, r):x}" for r in range(10)]

QUERIES = [
    top, low | top, top & TITLE.has_prefix("sea"), ~top, ~(top & low), ~low | TITLE.has_value("sea"), top & ~top,
    TITLE.has_prefix("sea") & ~TITLE.has_prefix("seaside"), TITLE.has_prefix(""), TITLE.has_prefix("été "), ~TITLE.has_prefix(""),
    PAGES.i64_lt(100), PAGES.i64_le(100), PAGES.i64_eq(100), PAGES.i64_ge(100), PAGES.i64_gt(100), ~PAGES.i64_gt(100), PAGES.has_prefix("1") & PAGES.i64_ge(-50),
    SPOT.h3in(UP[9]), SPOT.h3in(UP[6]), ~SPOT.h3in(UP[3]), SPOT.h3in(UP[6]) | AT.latlng_within(37.7, -122.4, 20_000),
    AT.latlng_within(37.7, -122.4, 20_000), AT.latlng_within(-17.7, 179.99, 9_000), AT.latlng_within(89.9, 0, 50_000) & ~top,
    Query((Clause.match_all(),)), Query((Clause.match_all(),)) & top, ~Query((Clause.match_all(),)), Query(), ~Query(), Query((Clause(()),)),
]

DOCUMENTS = [
    [], [("shelf", "top")], [("shelf", "low")], [("shelf", "top"), ("shelf", "low")], [("shelf", "Top")], [("shelf", "")], [("colour", "top")],
    *([("title", t)] for t in ("", "sea", "seaside", "se", "SEA", "été du sud", "été", "e\u0301té ")),
    [("title", "sea"), ("shelf", "top")], [("title", "seaside"), ("title", "seal"), ("shelf", "top")],
    *([("pages", n)] for n in ("100", "0100", "+100", "99", "101", "-50", "-51", " 100", "100 ", "1e2", "100.0", "", "ten", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "１００")),
    [("pages", "7"), ("pages", "700")],
    *([("spot", c)] for c in (UP[9], UP[8], UP[6], UP[5], UP[9].upper(), "8928308280ffffe", "nowhere", "", f"{CELL ^ (3 << 18):x}", f"{CELL ^ (1 << 40):x}")),
    *([("at", p)] for p in ("37.7,-122.4", "37.78,-122.5", "37.9,-122.4", "-17.7,-179.96", "-17.7,179.95", "90,12", "89.8,170", "37.7, -122.4", "37.7", "nan,1", "37.7,237.6")),
    [("spot", UP[7]), ("at", "37.71,-122.41"), ("shelf", "low")],
]


def pairs(df, name="qid"):
    rows = [(r["doc_id"], r[name]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def expected(queries, docs):
    """By the definition of a match in plain Python."""
    return {(d, i) for d, doc in docs for i, q in queries if q.matches(doc)}


CASES = [(i, Document.of(p)) for i, p in enumerate(DOCUMENTS)]
WANT = expected(list(enumerate(QUERIES)), CASES)


@pytest.fixture(scope="module")
def matrix(spark):
    return D.documents(spark, CASES)


def test_the_matrix_means_something():
    """A few matches written out; every satisfiable query matches some of the documents and not all, but for those that must."""
    by = {q: {d for d, i in WANT if i == q} for q in range(len(QUERIES))}
    always, never = {25, 28, 29}, {6, 27, 30}
    for q, found in by.items():
        assert (len(found) == len(CASES)) == (q in always) and (not found) == (q in never), (q, str(QUERIES[q]))
    assert {DOCUMENTS[d][0][1] for d in by[13]} == {"100", "0100", "+100"}
    assert {DOCUMENTS[d][0][1] for d in by[18]} == {UP[9], UP[9].upper()}


@pytest.mark.parametrize("strategy", ["anchor", "cross", "compiled"])
def test_conformance(matrix, strategy):
    assert pairs(percolate(matrix, enumerate(QUERIES), strategy)) == WANT


def test_a_corpus_that_is_a_table(spark, matrix):
    corpus = query_frame(spark, enumerate(QUERIES)).withColumn("active", F.col("qid") != 1)
    want = {(d, q) for d, q in WANT if q != 1}
    assert pairs(percolate_table(matrix, corpus)) == want
    assert pairs(percolate_table(matrix, corpus, EngineConfig(broadcast_bytes=0, n_clause_matchers=1))) == want
    assert percolate_table(matrix, corpus.limit(0)).count() == 0


@pytest.mark.parametrize("optimized", [False, True])
@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_store_over_the_matrix(matrix, n, optimized):
    p = Percolator.builder(n_clause_matchers=n, prefix_sizes=(3, 7))
    ids = [p.add_query(q) for q in QUERIES]
    gone = p.add_query(SHELF.has_prefix(""))
    assert ids == list(range(len(QUERIES))) and p.remove_qid(gone) and not p.remove_qid(gone)
    p = p.optimized(matrix) if optimized else p
    assert p.remove_uid(3) and bool(p.seen) == optimized
    assert pairs(p.percolate(matrix), "uid") == {(d, q) for d, q in WANT if q != 3}


@pytest.mark.parametrize("uids", [["a", "b"], [11, 12], [2**40, 2**41], ["x", 7]])
def test_ids_of_any_type(matrix, uids):
    """Ids of one type come back as they are, of several as text."""
    p = Percolator()
    for u, q in zip(uids, (top, TITLE.has_prefix("sea")), strict=True):
        p.index_query_uid(q, u)
    mixed = len({type(u) for u in uids}) > 1
    shown = [str(u) if mixed else u for u in uids]
    assert pairs(p.percolate(matrix), "uid") == expected(list(zip(shown, (top, TITLE.has_prefix("sea")), strict=True)), CASES)


def test_hashes_are_those_of_spark(spark):
    e = Extractor("T", "näme")
    signed = lambda h: h - (h >> 63 << 64)
    for text in ("", "x", "東京", "a" * 100):
        got = spark.range(1).select(F.xxhash64(F.lit(e.tag()), F.lit(text)).alias("a"), F.xxhash64(F.lit(-5).cast("long"), F.lit(12345).cast("long"))).first()
        assert got[0] == signed(e.hash_of(text)) and got[1] == signed(combined(-5 % 2**64, 12345))
    odd = "it's a \\ \\n % _ \" ü"
    assert spark.sql(f"select {text_sql(odd)}").first()[0] == odd


def test_anchors_combine_clauses(spark):
    """The candidates of a query are the documents that agree with several clauses, and some are found by each number of them."""
    rng = random.Random(1)
    queries = [(i, random_offer_query(rng)) for i in range(400)]
    docs = [(i, random_offer(rng)) for i in range(600)]
    df = D.documents(spark, docs)
    want = expected(queries, docs)
    sizes = []
    for n in (1, 2, 3):
        config = EngineConfig(n_clause_matchers=n)
        assert pairs(percolate(df, queries, config=config)) == want
        sizes.append(candidates(df, queries, config).count())
    assert sizes[0] > 3 * sizes[1] > 3 * sizes[2] >= len(want)
    assert max(map(len, choose(queries).classes)) == 3


def random_values(rng):
    d = Document()
    for _ in range(rng.randrange(0, 6)):
        d.with_value(rng.choice("ABCG"), rng.choice(["a", "ab", "abc", "é", "éa", "éab", "", "7", "007", "-3", "+12", " 7", "99999999999999999999", random_cell(rng), "8a1f09b20007fff", f"{rng.uniform(-90, 90):.4f},{rng.uniform(-180, 180):.4f}", "48.85,2.35", "89.99,10", "0,179.99", "0,-179.99"]))
    return d


def random_literal(rng):
    f = field(rng.choice("ABCG"))
    kind = rng.randrange(5)
    if kind == 0:
        return f.has_value(rng.choice(["a", "ab", "7", "é", ""]))
    if kind == 1:
        return f.has_prefix(rng.choice(["", "a", "ab", "é", "éa", "8a1f", "abcdefghijklmn"]))
    if kind == 2:
        return getattr(f, rng.choice(["i64_lt", "i64_le", "i64_eq", "i64_ge", "i64_gt"]))(rng.choice([-3, 0, 7, 12, 2**63 - 1, -(2**63)]))
    if kind == 3:
        return f.h3in(rng.choice(["891f09b2003ffff", "861f09b27ffffff", "8a1f09b20007fff"]) if rng.random() < 0.7 else random_cell(rng))
    return f.latlng_within(rng.choice([48.86, 89.9, 0.0, -45.0]), rng.choice([2.34, 179.9, -179.95, 10.0]), rng.choice([0, 3000, 50_000, 2_000_000, 12_000_000]))


def random_tree(rng, depth):
    kind = rng.randrange(4) if depth else 0
    if kind == 0:
        return random_literal(rng)
    if kind == 1:
        return ~random_tree(rng, depth - 1)
    x, y = random_tree(rng, depth - 1), random_tree(rng, depth - 1)
    return x & y if kind == 2 else x | y


@pytest.mark.parametrize("seed", range(3))
def test_strategies_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    docs = [(i, random_values(rng)) for i in range(120)]
    queries = [(i, random_tree(rng, 3)) for i in range(80)] + [(100, Query()), (101, match_all())]
    want = {(d, i) for d, doc in docs for i, q in queries if q.matches(doc)}
    df = D.documents(spark, docs)
    assert pairs(percolate(df, queries)) == want
    assert pairs(percolate(df, queries, config=EngineConfig(broadcast_bytes=0, prefix_sizes=(1, 2)))) == want
    assert pairs(percolate(df, queries, "cross")) == want
    assert pairs(percolate(df, queries, "compiled")) == want
    some = queries[seed][1]
    assert {r["doc_id"] for r in search(df, some).collect()} == {d for d, i in want if i == queries[seed][0]}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Texts that look like parts of others, separators, texts too long to be sought in, and integers in several forms.
ODD = ["a", "ab", "a\x1e", "\x1e", "b\x1e\x1cg\x1da", "", "é", "x" * 5000, "a" * 4096, "7", "007", "+7", " 7", "%", "_"]


def odd_cases(spark):
    values = [{"f": [v]} for v in ODD] + [{"g": [v]} for v in ODD] + [{"f": ["b", v], "g": ["7", v]} for v in ODD]
    docs = list(enumerate(values))
    nulls = [(1000, {"f": None, "g": ["a"]}), (1001, {"f": [None, "a"], "g": [None]}), (1002, {}), (1003, None)]
    df = spark.createDataFrame([*docs, *nulls], "doc_id bigint, f map<string,array<string>>")
    known = [(d, Document({k: [v for v in vs or [] if v is not None] for k, vs in (f or {}).items()})) for d, f in docs + nulls]
    atoms = [field(n).has_value(v) for n in "fg" for v in ODD] + [field(n).has_prefix(v) for n in "fg" for v in ODD] + [field(n).i64_eq(k) for n in "fg" for k in (7, -7)] + [field("f").i64_lt(8), field("g").i64_ge(7)]
    rng = random.Random(3)
    some = lambda: rng.choice(atoms)
    mixed = [q for _ in range(30) for q in (some() & some(), some() | some(), (some() | some()) & some() & ~some(), ~some() & ~some(), some() | some() | some())]
    return df, known, list(enumerate([*atoms, *mixed]))


def test_cross_tries_clauses_before_whole_queries(spark):
    """Clauses of texts are tried in generated code first, which loses no match of odd texts, null arrays and null maps."""
    df, known, queries = odd_cases(spark)
    got = percolate(df, queries, "cross")
    assert pairs(got) == expected(queries, known)
    on = plan_of(got).split("NestedLoopJoin", 1)[1].split("\n", 1)[0]
    assert 0 <= on.lower().find("contains(text") < on.find("forall(")
    assert percolate(df, [], "cross").count() == 0


def test_compiled_queries_are_generated_code(spark):
    """Atoms and queries are projections of their own, also where only qid is asked for, and no match of odd texts is lost."""
    df, known, queries = odd_cases(spark)
    got = percolate(df, queries, "compiled")
    assert pairs(got) == expected(queries, known)
    for plan in (plan_of(got), plan_of(got.select("qid"))):
        made = [line.lstrip(" +-:") for line in plan.split("\n") if "coalesce(array_contains(" in line or "CASE WHEN atoms" in line]
        assert [line.split("[", 1)[0].strip() for line in made] == ["Project", "Project"], [line[:200] for line in made]
    assert percolate(df, [], "compiled").count() == 0


def test_exact_where_acceleration_might_not_be(spark):
    """Two bounds on one field, extreme bounds, non-ASCII prefixes, cells and radii on one field, spoofed names."""
    docs = [(0, Document.of([("f", "8")])), (1, Document.of([("f", str(2**63 - 1))])), (2, Document.of([("f", "éab")])), (3, Document.of([("__match_all__", "true"), ("__PREFIX2__f", "éa")])), (4, Document.of([("f", "48.86,2.34")]))]
    queries = list(enumerate([field("f").i64_ge(8) & field("f").i64_le(8), field("f").i64_ge(2**63 - 1), field("f").has_prefix("éa"), field("f").h3in("871f09b20ffffff"), field("f").i64_gt(-(2**63))]))
    assert pairs(percolate(D.documents(spark, docs), queries)) == {(0, 0), (1, 1), (2, 2), (0, 4), (1, 4)}


def test_anchors_prefer_rare_values(spark):
    docs = D.documents(spark, [(i, Document.of([("colour", "blue"), ("taste", f"t{i}")])) for i in range(50)])
    q = [(0, field("colour").has_value("blue") & field("taste").has_value("t3"))]
    seen = frequent_values(docs)
    assert seen[("colour", "blue")] == 1.0
    one = EngineConfig(n_clause_matchers=1)
    assert choose(q, one, seen).classes == [(Extractor("T", "taste"),)]
    assert candidates(docs, q, one).count() == 50 and pairs(percolate(docs, q, config=one, seen=seen)) == {(3, 0)}
    many = [(i, field("colour").has_value("blue" if i % 2 else "red") & field("taste").has_value(f"t{i}")) for i in range(40)]
    assert choose(many, one).classes == [(Extractor("T", "taste"),)]  # queries name more values of it


def test_upsert_errors_and_ratio():
    p = Percolator()
    assert math.isnan(p.holes_ratio())
    p.index_query_uid(top, "x")
    p.index_query_uid(low, "x")
    p.index_query_uid(top, ("t", 1))
    assert len(p) == 2 and p.get_query("x") == low and p.safe_get_query("y") is None and p.holes_ratio() == pytest.approx(1 / 3)
    assert p.stats().n_queries == 3 and p.stats().n_queries_removed == 1
    q = p.compacted()
    assert q.holes_ratio() == 0 and q.add_query(top) == 3  # ids are never used twice
    small = Percolator.builder(max_clauses=1, max_prefix=3, max_literals=2)
    for query, kind in ((top & low, "too_many_clauses"), (SHELF.has_prefix("long"), "prefix_too_long"), (top | low | top, "too_many_literals")):
        with pytest.raises(PercolatorError) as e:
            small.add_query(query)
        assert e.value.kind == kind
        told = small.safe_add_query(query)
        assert isinstance(told, PercolatorError) and told.kind == kind
    assert small.safe_add_query(top) == 0 and small.stats().n_queries == 1 and str(p).startswith("Percolator-2Qs")
    with pytest.raises(KeyError):
        p.get_query("y")


@pytest.mark.parametrize("uids", [["x", "y"], [7, 9]])
def test_save_and_load(spark, matrix, tmp_path, uids):
    p = Percolator(EngineConfig(prefix_sizes=(4, 5)))
    chosen = (19, 22)
    for u, q in zip(uids, chosen, strict=True):
        p.index_query_uid(QUERIES[q], u)
    p.index_query_uid(top, "gone")
    p.remove_uid("gone")
    p = p if uids[0] == "x" else p.optimized(matrix)
    at = str(tmp_path / "corpus")
    p.save(spark, at)
    back = Percolator.load(spark, at)
    assert back.config == p.config and back.queries() == p.queries() and back._next == p._next and back.holes_ratio() == p.holes_ratio() and back.seen == p.seen
    want = {(d, uids[chosen.index(q)]) for d, q in WANT if q in chosen}
    assert pairs(back.percolate(matrix), "uid") == want
    assert {(d, u) for d, u in pairs(Percolator.percolate_saved(matrix, at), "uid")} == {(d, f'"{u}"' if isinstance(u, str) else str(u)) for d, u in want}


def test_statistics_recommend():
    p = Percolator()
    assert p.stats().recommended_cmcount() == 1 and p.stats().recommended_prefix_sizes() == [2, 10, 100, 1000, 2000]
    for n in (3, 4, 30, 60, 61, 62, 99):
        p.add_query(SHELF.has_prefix("ü" * (n // 2) + "x" * (n % 2)))  # lengths in bytes
    assert p.stats().recommended_prefix_sizes() == [1, 26, 51, 76]
    for _ in range(80):
        p.add_query(top & PAGES.i64_lt(9) & ~low)
    s = p.stats()
    assert s.recommended_cmcount() == 3 and s.n_preheaters == 2
    assert (s.clauses_per_query.min(), s.clauses_per_query.max(), s.clauses_per_query.n()) == (1, 3, 87)
    assert "87 added" in str(s) and "3 clauses" in str(s)


def test_statistics_of_a_table_are_those_of_the_driver(spark):
    rng = random.Random(6)
    queries = [random_tree(rng, 3) for _ in range(150)] + QUERIES
    corpus = query_frame(spark, enumerate(queries)).withColumn("active", F.col("qid") % 7 != 0)
    s = stats.Stats.of([(q, i % 7 != 0) for i, q in enumerate(queries)], 2)
    assert tuple(stats.corpus_counts(corpus).first()) == (s.n_queries, s.n_queries_removed, s.n_queries - s.n_queries_removed)
    assert {tuple(r) for r in stats.clause_histogram(corpus).collect()} == set(s.clauses_per_query.counts.items())
    assert {tuple(r) for r in stats.preheater_histogram(corpus, 2).collect()} == set(s.preheaters_per_query.counts.items())
    assert stats.preheater_count(corpus, 2).first()[0] == s.n_preheaters
    assert stats.recommended_cmcount(corpus).first()[0] == s.recommended_cmcount()
    assert sorted(r[0] for r in stats.recommended_prefix_sizes(corpus).collect()) == s.recommended_prefix_sizes()
    told = {r["what"]: r for r in stats.report(corpus, 2).collect()}
    for name, h in (("clauses per query", s.clauses_per_query), ("further keys per query", s.preheaters_per_query), ("prefix bytes", s.prefix_lengths)):
        r = told[name]
        assert (r["count"], r["min"], r["max"]) == (h.n(), h.min(), h.max()) and (r["mean"], r["stddev"]) == pytest.approx((h.mean(), h.stddev()))
    costs = {(r["qid"], r["at"]): r["cost"] for r in stats.clause_costs(corpus).collect()}
    assert costs == {(i, k): stats.clause_cost(c) for i, q in enumerate(queries) for k, c in enumerate(q.clauses)}


def test_documents(spark):
    d = Document.of([("shelf", "top"), ("shelf", "top"), ("title", "")])
    assert d.fv_count() == 3 and d.has_field("title") and not d.has_field("pages") and d.values_of("shelf") == ["top", "top"] and Document().is_empty()
    assert sorted(d.merge_with({"shelf": ["low"]}).field_values()) == [("shelf", "low"), ("shelf", "top"), ("title", "")]
    assert str(Query((d.to_clause(),))) == "(AND (OR shelf=top shelf=top title=))"
    t = spark.createDataFrame([(1, "x", None, ["p", None, "q"]), (2, None, 5, None)], "id int, s string, n int, l array<string>")
    got = {r["doc_id"]: r["f"] for r in D.to_documents(t, "id", {"s": "s", "n": F.col("n"), "l": "l"}).collect()}
    assert got == {1: {"s": ["x"], "l": ["p", "q"]}, 2: {"n": ["5"]}}


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(i, {"shelf": ["top" if i % 2 else "low"]}) for i in range(10)], f"doc_id bigint, f {D.FIELDS}").write.parquet(path)
    source = spark.readStream.schema(f"doc_id bigint, f {D.FIELDS}").parquet(path)
    q = percolate_stream(source, [(0, top), (1, ~top)]).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert pairs(spark.table("found")) == {(i, 1 - i % 2) for i in range(10)}
    seen = []
    each_batch(source, lambda: [(5, top)], lambda df, i: seen.extend(pairs(df))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert set(seen) == {(i, 5) for i in range(1, 10, 2)}
    with pytest.raises(ValueError, match="stream"):
        percolate_stream(spark.read.parquet(path), [])


def test_plan_of_the_anchor_join(matrix, capsys):
    percolate(matrix, enumerate(QUERIES)).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
