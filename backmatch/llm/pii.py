"""Operator 3, personal data by weak supervision, in SQL functions only.

Matches of the base patterns that pass their checks are always reported.
Further candidates (social security and bank account numbers, national phone
numbers, long numbers without a card's check digit, titled names) and the base
ones go through labelers that vote yes, no or nothing: the shape of the match,
a gazetteer, the words before it, and whether candidates of other kinds stand
in the same document.

Candidates are reduced to counts of (kind, votes, length class), a table of
bounded size.  Expectation-maximisation on these counts estimates how
reliable each labeler is, without labels.  Its posteriors train a logistic
span classifier over the same features, which becomes one SQL expression that
gives every candidate a probability; one that isn't of a base pattern is
reported when it is one half or more.

Defined results: a null text is empty and has no spans; very long texts are
scanned whole; repeated rows are each scanned; without candidates nothing is
fitted and nothing is added; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .spans import EMAIL, IP, Kind, counted, is_ip, joined, part_rows

_digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
_dotted = lambda t: t.contains(".")
_number = lambda t: t.rlike("[0-9][ -]?[0-9]")

#: Fixed values of the gazetteer labeler.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "mlle", "monsieur", "madame", "señor", "señora", "sr", "sra")
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "info", "eu")
ISSUERS = r"^(?:4|5[1-5]|3[47]|6)"
BANK_COUNTRIES = ("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PT", "IE", "PL")

KINDS = [
    Kind("email", EMAIL, guard=lambda t: t.contains("@")),
    Kind("ip", IP, is_ip, _dotted),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", lambda m: F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m)), _number),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), lambda t: t.contains("+")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", guard=_number),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", guard=_number),
    Kind("tel", r"(?<!\+[0-9]{1,3}\x20)(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", guard=_number),
    Kind("number", r"(?<![0-9A-Za-z.+-])[0-9]{13,19}(?![0-9A-Za-z.-])", lambda m: ~F.call_function("luhn_check", m), _number),
    Kind("name", rf"(?<![\p{{L}}])(?i:{'|'.join(TITLES)})\.\x20\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+)?", guard=_dotted),
]
NAMES = [k.name for k in KINDS]
BASE = 4
CONTEXT = 40
LABELERS = 4
#: Words before a match that speak for its kind, and words that speak against all kinds.
FOR = {"email": "mail|contact|reach|write", "ip": "ip|host|server|address", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax", "ssn": "ssn|social|security", "iban": "iban|account|bank|konto", "tel": "phone|tel|call|mobile|fax", "number": "card|visa|credit|account|konto|id|customer", "name": "name|by|from|with|contact"}
AGAINST = r"version|isbn|invoice|order|figure|page|section|build"


def _shape(kind: str, m: Column) -> Column:
    """A long number without a check digit has the wrong shape; the other labelers may still speak for it."""
    strict = {"email": m.rlike(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$"), "ip": ~m.rlike(r"^0"), "card": ~m.rlike(r"^0"), "phone": m.rlike(r"^\+[1-9]"), "ssn": ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), "iban": m.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]"), "tel": ~m.rlike(r"^\(?[01]"), "number": F.lit(False), "name": m.rlike(r"\p{Ll}{2}$")}[kind]
    return F.when(strict, 1).otherwise(-1)


def _gazetteer(kind: str, m: Column) -> Column:
    known = {"email": F.lower(F.substring_index(m, ".", -1)).isin(*TOP_LEVEL), "card": m.rlike(ISSUERS), "number": m.rlike(ISSUERS), "phone": m.rlike(r"^\+(?:1|33|34|39|4[0-9])"), "iban": F.left(m, F.lit(2)).isin(*BANK_COUNTRIES), "name": F.lower(F.substring_index(m, ".", 1)).isin(*TITLES)}.get(kind)
    return F.lit(0) if known is None else F.when(known, 1).otherwise(0 if kind in ("email", "phone") else -1)


def _context(kind: str, before: Column) -> Column:
    return F.when(before.rlike(rf"\b(?:{FOR[kind]})\b[^.]*$"), 1).when(before.rlike(rf"\b(?:{AGAINST})\b[^.]*$"), -1).otherwise(0)


def votes(parts: DataFrame) -> DataFrame:
    """``parts`` with v0 .. v3 (-1, 0, 1) and a length class for each candidate."""
    pick = lambda f: F.coalesce(*(F.when(F.col("kind") == i, f(n)) for i, n in enumerate(NAMES)))
    m, b = F.col("match"), F.col("before")
    near = parts.where("kind is not null").groupBy("row").agg((F.countDistinct("kind") > 1).cast("int").alias("v3"))
    got = parts.where("kind is not null").join(near, "row")
    return got.select("row", "doc_id", "kind", "start", "end", pick(lambda n: _shape(n, m)).alias("v0"), pick(lambda n: _gazetteer(n, m)).alias("v1"), pick(lambda n: _context(n, b)).alias("v2"), "v3", F.least(F.floor(F.length("match") / 8), F.lit(4)).cast("int").alias("size"))


def estimate(kind: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the patterns and the labelers' reliabilities, by expectation-maximisation.

    A labeler that votes is right with its reliability; each kind has its own prior, which begins
    and is kept higher for kinds that have passed a base pattern's check.
    """
    start = np.where(np.arange(len(NAMES)) < BASE, 0.9, 0.3)
    right, prior = np.full(v.shape[1], 0.75), start.copy()
    p = np.full(len(n), 0.5)
    for _ in range(rounds):
        lod = np.log(prior[kind] / (1 - prior[kind])) + v @ np.log(right / (1 - right))
        p = 1 / (1 + np.exp(-np.clip(lod, -30, 30)))
        for j in range(v.shape[1]):
            agree, voted = (n * np.where(v[:, j] > 0, p, 1 - p) * (v[:, j] != 0)).sum(), (n * (v[:, j] != 0)).sum()
            right[j] = np.clip((agree + 3) / (voted + 4), 0.55, 0.99)
        for k in range(len(NAMES)):
            of = kind == k
            prior[k] = np.clip(((n * p)[of].sum() + 2 * start[k]) / (n[of].sum() + 2), 0.02, 0.98)
    return p, right


def train(x: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic classifier fitted to soft labels p with counts n."""
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-x @ w))
        h = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (share * (p - q)) - 1e-3 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(kind, v, size, one):
    """Indicators of kind, votes and length class; ``one`` turns a condition into a number."""
    return [one(kind == k) for k in range(len(NAMES))] + [one(v[j] == s) for j in range(LABELERS) for s in (1, -1)] + [one(size == s) for s in range(5)]


def fit(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classifier's weights and the labelers' reliabilities for rows of kind, votes, length class, count."""
    kind, v, size, n = counts[:, 0], counts[:, 1 : 1 + LABELERS], counts[:, 1 + LABELERS], counts[:, 2 + LABELERS].astype(float)
    p, right = estimate(kind, v, n)
    return train(np.array(_features(kind, v.T, size, lambda x: x.astype(float))).T, p, n), right


def personal_parts(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, p (the classifier's probability), reliabilities (of the labelers) of what is reported,
    and a row with null kind for each document without any."""
    parts = checkpointed(part_rows(docs, KINDS, CONTEXT))
    seen = checkpointed(votes(parts))
    votes_ = [f"v{j}" for j in range(LABELERS)]
    counts = seen.groupBy("kind", *votes_, "size").count().collect()  # at most kinds x 3^4 x 5 rows
    none = parts.where("kind is null").select("row", "doc_id", "kind", "start", "end", F.lit(None).cast("double").alias("p"))
    w, right = fit(np.array([[int(x) for x in r] for r in counts])) if counts else (np.zeros(len(NAMES) + 2 * LABELERS + 5), np.zeros(0))
    terms = _features(F.col("kind"), [F.col(v) for v in votes_], F.col("size"), lambda x: x.cast("double"))
    lod = sum((t * F.lit(float(a)) for t, a in zip(terms, w, strict=True)), F.lit(0.0))
    found = seen.withColumn("p", 1 / (1 + F.exp(-lod)))
    found = found.select("row", "doc_id", F.when((F.col("kind") < BASE) | (F.col("p") >= 0.5), F.col("kind")).alias("kind"), "start", "end", "p")
    return none.unionByName(found).withColumn("reliabilities", F.lit(",".join(f"{x:.3f}" for x in right)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: n_added, the spans that the classifier added; probabilities of all spans in their
    order; the labelers' reliabilities."""
    span = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end", "p"))
    got = personal_parts(table(spark, sf_dir, "documents")).groupBy("row", "reliabilities").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    counts = [counted(F.col("spans"), i).alias(f"n_{NAMES[i]}") for i in range(BASE)]
    told = F.array_join(F.transform("spans", lambda s: F.call_function("format_number", s["p"], F.lit("0.000"))), ",")
    return got.select("doc_id", *counts, F.sha2(joined(base, NAMES), 256).alias("base_sha256"), joined(F.col("spans"), NAMES).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"), told.alias("probabilities"), "reliabilities")
