"""Query algebra, display and the language."""

import random

import pytest
from backmatch import Clause, Query, QueryParseError, field, match_all, parse_query
from backmatch.functions import geo, values
from backmatch.parser import parse_ast
from backmatch.query import QueryTooLarge
from backmatch.testing import random_document, random_query, random_query_string

TREE, LEAF, ROOT = field("tree"), field("leaf"), field("root")
oak, elm, round_, deep = TREE.has_value("oak"), TREE.has_value("elm"), LEAF.has_value("round"), ROOT.i64_gt(7)

#: How each kind of atom is written.
WRITTEN = [
    (oak, "tree=oak"),
    (LEAF.has_prefix("ro"), "leaf=ro*"),
    (ROOT.i64_eq(30), "root==30"),
    (ROOT.i64_lt(30), "root<30"),
    (ROOT.i64_le(30), "root<=30"),
    (ROOT.i64_ge(-1), "root>=-1"),
    (deep, "root>7"),
    (field("spot").h3in("8928308280fffff"), "spot=H3IN=8928308280fffff"),
    (field("at").latlng_within(52.5, -13.25, 40), "at LATLNG_WITHIN (52.5000000000, -13.2500000000),40"),
]


@pytest.mark.parametrize(("query", "written"), WRITTEN)
def test_atoms_are_written(query, written):
    assert str(query) == f"(AND (OR {written}))"
    assert str(~query) == f"(AND (OR ~{written}))"
    assert str(~~query) == str(query)


@pytest.mark.parametrize(
    ("query", "written"),
    [
        (match_all(), "(AND )"),
        (~match_all(), "(AND )"),
        (oak & ~deep, "(AND (OR tree=oak) (OR ~root>7))"),
        (deep | oak | round_, "(AND (OR leaf=round root>7 tree=oak))"),  # by field, then value
        (oak | elm | ~elm, "(AND (OR tree=elm ~tree=elm tree=oak))"),
        ((oak & deep) | round_, "(AND (OR leaf=round tree=oak) (OR leaf=round root>7))"),
        (~(oak & (deep | round_)), "(AND (OR ~root>7 ~tree=oak) (OR ~leaf=round ~tree=oak))"),
        (oak & oak, "(AND (OR tree=oak) (OR tree=oak))"),
    ],
)
def test_formulas_are_written(query, written):
    assert str(query) == written


def test_random_queries_follow_their_formula():
    """The normal form has the value of the formula it was made of, for random formulas and documents."""
    rng = random.Random(3)

    def holds(node, doc):
        name = type(node).__name__
        if name == "Not":
            return not holds(node.of, doc)
        if name == "Both":
            return all(holds(x, doc) for x in (node.left, node.right)) if node.op == "AND" else any(holds(x, doc) for x in (node.left, node.right))
        return node.to_query().matches(doc)

    for _ in range(400):
        ast = parse_ast(random_query_string(rng, 4))
        names = [lit.field for c in ast.to_query().clauses for lit in c.literals]
        atoms = [lit for c in ast.to_query().clauses for lit in c.literals]
        for _ in range(4):
            doc = random_document(rng, names)
            for lit in atoms:
                if rng.random() < 0.4 and lit.val is not None:
                    doc.with_value(lit.field, lit.val)
                elif rng.random() < 0.4 and lit.num is not None and lit.kind != "h3":
                    doc.with_value(lit.field, lit.num + rng.choice((-1, 0, 1)))
            assert ast.to_query().matches(doc) == holds(ast, doc)


def test_clause_operations():
    three = Clause.from_clauses([*oak.clauses, *deep.clauses, *oak.clauses])
    assert [str(x) for x in three.literals] == ["tree=oak", "root>7", "tree=oak"]
    assert [str(x) for x in three.cleansed().literals] == ["tree=oak", "root>7"]
    assert str(three.negate()) == "(AND (OR ~tree=oak) (OR ~root>7) (OR ~tree=oak))"
    assert Query((Clause.match_all(),)).matches({}) and not (~Query((Clause.match_all(),))).matches({})
    assert oak & elm == oak & elm and oak & elm != elm & oak
    assert [p.val for p in (LEAF.has_prefix("f") | ~LEAF.has_prefix("g") & oak).prefix_queries()] == ["f", "g", "f"]


def test_negation_is_true_on_missing_fields():
    assert (~oak).matches({}) and not oak.matches({}) and not (~oak).matches({"tree": ["ash", "oak"]})


def test_growth_is_bounded(monkeypatch):
    monkeypatch.setattr(Query, "MAX_LITERALS", 500)
    with pytest.raises(QueryTooLarge):
        Query.from_or([oak & round_ & deep & ~elm] * 6)


@pytest.mark.parametrize(
    ("text", "query"),
    [
        ("tree:oak", oak),
        ("tree:42", TREE.has_value("42")),
        ("tree:0042", TREE.has_value("42")),
        ("tree:oak OR root>7", oak | deep),
        ("tree:oak AND leaf:round OR root>7", (oak & round_) | deep),
        ("root>7 OR leaf:round AND tree:oak", deep | (round_ & oak)),
        ("tree:oak AND ( leaf:round OR root > 7 )", oak & (round_ | deep)),
        ("NOT leaf:round AND tree:oak", ~round_ & oak),
        ("NOT (leaf:round AND tree:oak)", ~(round_ & oak)),
        (r'leaf:"half \"moon\" \\ x"', LEAF.has_value('half "moon" \\ x')),
        (r'leaf:"ro u"* AND NOT tree:el*', LEAF.has_prefix("ro u") & ~TREE.has_prefix("el")),
        ('leaf:""*', LEAF.has_prefix("")),
        ("root<30", ROOT.i64_lt(30)),
        ("root <=30", ROOT.i64_le(30)),
        ("root= 30", ROOT.i64_eq(30)),
        ("root>=-30", ROOT.i64_ge(-30)),
        ("root<deep", ROOT.has_value("deep")),
        ('root>"7"', ROOT.has_value("7")),
        ("root=9223372036854775808", ROOT.has_value("9223372036854775808")),
        ("spot H3IN 8928308280fffff", field("spot").h3in("8928308280fffff")),
        ("spot H3IN nowhere", field("spot").has_value("nowhere")),
        ("spot H3INnowhere", field("spot").has_value("nowhere")),
        ("at LLWITHIN 52.5,-13.25,40", field("at").latlng_within(52.5, -13.25, 40)),
        ("at LLWITHIN 52.5,-13.25", field("at").has_value("52.5,-13.25")),
        ("OR:oak", field("OR").has_value("oak")),
        ("NOT NOT NOT tree:oak", ~oak),
    ],
)
def test_parse(text, query):
    assert parse_query(text) == query


@pytest.mark.parametrize("text", ["oak", "  ", "tree:oak:elm", "tree:oak ORleaf:x", "NOT", "((tree:oak)", "tree:oak)", 'tree:"oak', "tree<", "=oak", "tree:oak AND", "tree:oak elm"])
def test_parse_errors(text):
    with pytest.raises(QueryParseError) as e:
        parse_query(text)
    assert e.value.messages


def test_strict():
    assert parse_query("root<5", strict=True) == ROOT.i64_lt(5)
    for text in ("root<five", "spot H3IN nowhere", "root>5*"):
        with pytest.raises(QueryParseError):
            parse_query(text, strict=True)


def test_random_queries_parse():
    rng = random.Random(0)
    for _ in range(1500):
        ast = parse_ast(random_query_string(rng))
        assert str(parse_ast(str(ast))) == str(ast)
        assert random_query(rng).clauses


def test_integers():
    assert [values.parse_int(s) for s in ("00070", "+8", "-00", str(-(2**63)))] == [70, 8, 0, -(2**63)]
    assert all(values.parse_int(s) is None for s in ("7 ", "\t7", "7.0", "", "-", "7e1", str(-(2**63) - 1), "７"))


def test_cells():
    p = geo.parse_cell
    cell = p("8928308280fffff")
    assert geo.resolution(cell) == 9 and geo.parent(cell, 9) == cell and geo.parent(cell, 10) is None
    up = geo.parent(cell, 5)
    assert geo.resolution(up) == 5 and p(f"{up:x}") == up and geo.parent(cell ^ (1 << 40), 5) != up
    assert p("xyz") is None and p("") is None and p("0") is None and p("f" * 16) is None and p("8928308280fffff0") is None


def test_distance():
    berlin, potsdam = (52.52, 13.405), (52.39, 13.065)
    assert 26_000 < geo.distance(berlin, potsdam) < 28_000 and geo.distance(berlin, berlin) == 0
    assert geo.distance((0, 179.9), (0, -179.9)) < 23_000
    assert geo.parse_point("52.5,-13") == (52.5, -13.0) and geo.parse_point("52.5;13") is None and geo.parse_point("inf,1") is None
