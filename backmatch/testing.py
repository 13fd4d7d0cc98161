"""Random queries and documents for tests and benchmarks, drawn from the language's grammar.

A query is grown from the leaves: a row of atoms is joined pair by pair, and
any part may be negated on the way, so its size is the number of atoms.
Names and bare values are made of syllables in lower case and never keywords.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.geo import PENTAGONS
from .parser import Atom, Both, Not, Value
from .query import Query
from .sources.documents import Document

SYLLABLES = tuple(c + v for c in "bdfklmnprstvz" for v in "aeiou")
#: Pieces of quoted text; some need an escape.
PIECES = (" ", "-", "'", '"', "\\", "(", ")", "*", ":", "<", "=", "AND", "NOT", "é", "ß", "東", "0", "12")


def random_name(rng: random.Random) -> str:
    return "".join(rng.sample(SYLLABLES, rng.choice((1, 2, 2, 3)))) + rng.choice(("", "", "_2", "9"))


def random_cell(rng: random.Random, resolution: int | None = None) -> str:
    """A cell of any resolution from 4 to 12, below a base cell that is no pentagon."""
    res = rng.randint(4, 12) if resolution is None else resolution
    base = rng.randrange(122)
    while base in PENTAGONS:
        base = rng.randrange(122)
    digits = "".join(str(rng.randrange(7)) for _ in range(res)).ljust(15, "7")  # octal, as each takes three bits
    return f"{(1 << 59) + (res << 52) + (base << 45) + int(digits, 8):x}"


def random_point(rng: random.Random) -> str:
    return f"{rng.triangular(-89, 89, 45):.3f},{rng.triangular(-179, 179, 5):.3f}"


def random_text(rng: random.Random) -> str:
    words = [random_name(rng) for _ in range(rng.randint(1, 3))]
    return "".join(w + rng.choice(PIECES) for w in words) if rng.random() < 0.4 else words[0]


def random_number(rng: random.Random) -> int:
    """Of any size: each number of digits is as likely."""
    return rng.choice((-1, 1)) * rng.randrange(10 ** rng.randint(1, 12))


def random_atom(rng: random.Random) -> Atom:
    text = lambda: Value("term", random_text(rng))
    number = lambda: Value("integer", random_number(rng))
    kinds = {
        ":": lambda: rng.choice((text, text, number, lambda: Value("prefix", random_text(rng))))(),
        "H3IN": lambda: Value("term", random_cell(rng)),
        "LLWITHIN": lambda: Value("term", f"{random_point(rng)},{10 ** rng.randint(0, 6)}"),
        **{op: number for op in ("<", "<=", "=", ">=", ">")},
    }
    op, of = rng.choice(list(kinds)), rng.choice(list(kinds)) if rng.random() < 1 / 12 else None  # a value of another kind at times
    return Atom(random_name(rng), op, kinds[of or op]())


def random_ast(rng: random.Random, atoms: int | None = None, atom: Callable[[random.Random], Atom] = random_atom):
    """A formula of some atoms; ``atom`` draws each of them."""
    parts: list = [atom(rng) for _ in range(rng.randint(1, 4) if atoms is None else atoms)]
    while True:
        i = rng.randrange(len(parts))
        if rng.random() < 0.15:
            parts[i] = Not(parts[i])
        if len(parts) == 1:
            return parts[0]
        if i + 1 < len(parts):
            parts[i : i + 2] = [Both(rng.choice(("AND", "OR")), parts[i], parts[i + 1])]


def random_query(rng: random.Random, atoms: int | None = None) -> Query:
    return random_ast(rng, atoms).to_query()


def random_query_string(rng: random.Random, atoms: int | None = None) -> str:
    return str(random_ast(rng, atoms))


def random_document(rng: random.Random, names: list[str]) -> Document:
    """A few values of any kind in some of the fields ``names``."""
    makers = (random_text, random_cell, random_point, lambda r: str(random_number(r)))
    return Document.of((rng.choice(names), rng.choice(makers)(rng)) for _ in range(rng.randrange(6)))


# -- a corpus of offers: place, flavour, one more attribute and a limit of cost

FLAVOURS = ("sweet", "sour", "salt", "bitter", "hot")
#: The attributes of which an offer has one: their values, and whether queries ask for a prefix.
ATTRIBUTES = {
    "shade": (tuple(a + b for a in ("red", "green", "grey", "blue") for b in ("", "ish", "ish-dark", "ish-dark-spotted")), True),
    "grade": (("low", "mid", "high"), False),
    "warmth": (("frozen", "cool", "mild", "warm", "boiling"), False),
    "label": (tuple(f"label-{i}" for i in range(100)), False),
}
PLACES, COSTS = 250, (10_000, 100_000)


def random_offer_query(rng: random.Random) -> Query:
    from .query import field

    name = rng.choice(list(ATTRIBUTES))
    values, by_prefix = ATTRIBUTES[name]
    value = rng.choice(values)
    third = field(name).has_prefix(value[: rng.randint(2, len(value))]) if by_prefix else field(name).has_value(value)
    return field("place").has_value(f"place-{rng.randrange(PLACES)}") & field("flavour").has_value(rng.choice(FLAVOURS)) & third & field("cost").i64_lt(rng.randrange(*COSTS))


def random_offer(rng: random.Random) -> Document:
    name = rng.choice(list(ATTRIBUTES))
    return Document.of([("place", f"place-{rng.randrange(PLACES)}"), ("flavour", rng.choice(FLAVOURS)), (name, rng.choice(ATTRIBUTES[name][0])), ("cost", str(rng.randrange(*COSTS)))])


def offers(ids: DataFrame, key: str) -> DataFrame:
    """doc_id and f as ``random_offer`` makes them, drawn from hashes of the ids where they are."""
    draw = lambda salt, n: F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(n)).cast("int")
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), draw(salt, len(xs)) + 1)
    names = list(ATTRIBUTES)
    third = F.struct(pick("name", names).alias("name"), F.element_at(F.array(*(pick("value", ATTRIBUTES[n][0]) for n in names)), draw("name", len(names)) + 1).alias("value"))
    fields = {"place": F.concat(F.lit("place-"), draw("place", PLACES)), "flavour": pick("flavour", FLAVOURS), "cost": (F.lit(COSTS[0]) + draw("cost", COSTS[1] - COSTS[0])).cast("string")}
    entries = [F.struct(F.lit(k).alias("k"), F.array(v).alias("v")) for k, v in fields.items()] + [F.struct(third["name"].alias("k"), F.array(third["value"]).alias("v"))]
    return ids.select(F.col(key).cast("bigint").alias("doc_id"), F.map_from_entries(F.array(*entries)).alias("f"))
