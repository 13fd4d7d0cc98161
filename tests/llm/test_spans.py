"""Secret scan and personal data against Python's regular expressions."""

import hashlib
import random
import re

import duckdb
import numpy as np
from backmatch.llm import pii, queries, secrets
from pyspark.sql import functions as F

from .conftest import TEXTS


def secret_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def luhn(x):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(x))) % 10 == 0


def pii_base(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def fuzz(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


SECRET_PARTS = ["token", "Secret", "api_key", "APIKEY", "password", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é😀", "x", "\n", "longvalue123", "user=bob", "https://h/x"]
PII_PARTS = ["a@b.com", "@", ".", "+", "1", "22", "255", "256", "4111111111111111", "4111 1111 1111 1111", "-", " ", "(", ")", "x.y@z", ".de", "+49 30 1234567", "00", "é", "😀", "\n", "Mr. Smith Jones", "078-05-1120"]


def by_text(spark, op, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return op(docs)


def test_secret_spans_equal_brute_force(spark):
    texts = fuzz(SECRET_PARTS, 400, 1) + [t or "" for _, t in TEXTS]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < secrets.STRONG] for r in by_text(spark, secrets.secret_spans, texts).collect()}
    assert got == {i: secret_base(t) for i, t in enumerate(texts)}


def test_pii_base_equals_brute_force(spark):
    texts = fuzz(PII_PARTS, 500, 2) + ["1" * 50_000, "1 " * 20_000, "a.b" * 20_000 + "@", "a@b.c+d@e.f"] + [t or "" for _, t in TEXTS]
    rows = by_text(spark, pii.personal_parts, texts).where(F.col("kind") < pii.BASE).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["kind"], r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {i: b for i, t in enumerate(texts) if (b := pii_base(t))}


def weak_candidates(t):
    """Spans of the weak kinds by Python's expressions: (kind name, start, end)."""
    names = {"ident": r"""(?i:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "opaque": r"[A-Za-z0-9+/_=-]{20,}", "endpoint": r"""(?i:https?|ftp|sftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", "userinfo": r"""://[^\x00-\x20"'<>/@:]+:[^\x00-\x20"'<>/@]{3,}@""", "account": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "host": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"}
    for name, pattern in names.items():
        for m in re.finditer(pattern, t):
            x = m[0]
            if name == "opaque" and not all(re.search(c, x) for c in ("[0-9]", "[A-Z]", "[a-z]")):
                continue
            if name == "host" and any(int(p) > 255 for p in x.split(".")):
                continue
            yield name, m.start(), m.end()


def linked(t):
    """All reported spans, every pair of parts compared."""
    base = [(secrets.NAMES[k], s, e) for s, k, e in secret_base(t)]
    weak = list(weak_candidates(t))
    out = set(base)
    for n, s, e in weak:
        for m, a, b in base + weak:
            gap = max(a - e, s - b)
            if secrets.ROLES[m] in secrets.NEEDS[n] and gap <= secrets.SCOPE and (gap >= 0 or "userinfo" in (n, m)):
                out.add((n, s, e))
    return sorted((s, secrets.NAMES.index(n), e) for n, s, e in out)


WEAK_PARTS = [*SECRET_PARTS, "aB3" * 9, "login: carol", " filler" * 20, " filler" * 35, "10.1.2.300", "10.1.2.30", "me@mail.example.com", "postgres://bob:hunter2x@db.host/x", "redis://a:b@h", "user_id=77x9"]


def test_links_equal_brute_force(spark):
    texts = fuzz(WEAK_PARTS, 500, 4) + ["deadbeef" * 4 + " x" * n + " https://host/x" for n in (98, 99, 100, 101)] + [t or "" for _, t in TEXTS]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in by_text(spark, secrets.secret_spans, texts).collect()}
    assert got == {i: linked(t) for i, t in enumerate(texts)}
    kinds = {k for spans in got.values() for _, k, _ in spans}
    assert kinds == set(range(len(secrets.NAMES)))


def test_weak_parts_need_company(spark):
    opaque = "aB3" * 9
    far = " filler" * 60
    texts = [opaque, f"user=bob {opaque}", f"user=bob{far}{opaque}", "see https://host/x", f"https://host/x {opaque}", "login: carol", "login: carol password=correcthorse", "postgres://app:SECRET@host"]
    got = {r["doc_id"]: sorted(secrets.NAMES[s["kind"]] for s in r["spans"]) for r in by_text(spark, secrets.secret_spans, texts).collect()}
    assert got == {0: [], 1: ["ident", "opaque"], 2: [], 3: [], 4: ["endpoint", "opaque"], 5: [], 6: ["assign", "ident"], 7: ["endpoint", "userinfo"]}


def write_documents(spark, at, texts):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, kind int, row int")
    df.repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_secret_rows_equal_brute_force(spark, tmp_path):
    """All columns of the query, also by its SQL."""
    texts = fuzz(WEAK_PARTS, 150, 5) + [t for _, t in TEXTS]
    at = write_documents(spark, tmp_path, texts)
    shown = lambda spans: ",".join(f"{secrets.NAMES[k]}:{s}:{e}" for s, k, e in spans)
    want = []
    for i, t in enumerate(texts):
        base = secret_base(t or "")
        want.append((i, *(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(linked(t or ""))))
    got = secrets.op1_secret_scan(spark, at)
    assert sorted(map(tuple, got.collect())) == want
    duckdb.execute(f"create or replace temp view documents as select * from '{at}/documents.parquet/*.parquet'")
    found = duckdb.execute(queries.ORACLE_SQL["op1_secret_scan"])
    assert [d[0] for d in found.description] == got.columns and sorted(found.fetchall()) == want


def test_personal_rows_equal_brute_force(spark, tmp_path):
    texts = fuzz(PII_PARTS, 150, 6) + [t for _, t in TEXTS]
    at = write_documents(spark, tmp_path, texts)
    rows = {r["doc_id"]: r for r in pii.op3_pii(spark, at).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base, r = pii_base(t or ""), rows[i]
        shown = [f"{pii.NAMES[k]}:{s}:{e}" for k, s, e in base]
        assert [r[f"n_{n}"] for n in pii.NAMES[:4]] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans[: len(shown)] == shown and len(spans) == len(shown) + r["n_added"]
        assert len(r["probabilities"].split(",")) == max(1, len(spans)) and r["reliabilities"].count(",") == 3


def test_odd_inputs(spark, docs, no_docs):
    clash = docs.withColumnsRenamed({"score": "row", "key": "__id"}).selectExpr("*", "1 AS p", "2 AS v0", "3 AS __marks", "4 AS hash")
    for df in (docs, clash):
        assert secrets.secret_spans(df).count() == len(TEXTS)
        assert pii.personal_parts(df).select("row").distinct().count() == len(TEXTS)
        assert secrets.redact(df).columns == df.columns and secrets.redact(df).count() == len(TEXTS)
    assert secrets.secret_spans(no_docs).count() == 0
    assert pii.personal_parts(no_docs).count() == 0
    long = spark.createDataFrame([(1, "x " * 400_000 + "password=hunter22hunter call +1 (988) 555-2485")], "doc_id bigint, text string")
    assert [s["start"] for s in secrets.secret_spans(long).first()["spans"]] == [800_000]
    assert [(r["kind"], r["start"]) for r in pii.personal_parts(long).collect()] == [(3, 800_029)]


def test_redaction(spark, docs, no_docs):
    out = {(r["doc_id"], r["text"]) for r in secrets.redact(docs).collect()}
    assert next(t for i, t in out if i == 8) == 'key [SECRET] [SECRET] and [SECRET]" end'
    assert {x for x in out if x[0] != 8} == {(i, t) for i, t in TEXTS if i != 8}
    assert secrets.redact(no_docs).count() == 0
    rows = [(1, "password=hunter22hunter", 1), (1, "nothing here", 2), (None, "token: abcdefgh1", 3), (2, "mail a@b.com to 10.0.0.1 password=hunter22hunter", 4)]
    sized = spark.createDataFrame([(i, t, 7) for i, t, _ in rows], "doc_id bigint, text string, n_chars bigint")
    assert all(r["n_chars"] == len(r["text"]) for r in secrets.redact(sized).collect())
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `a b` int")
    assert [r["text"] for r in secrets.redact(df).orderBy("`a b`").collect()] == ["[SECRET]", "nothing here", "[SECRET]", "mail a@b.com to 10.0.0.1 [SECRET]"]


def test_the_classifier_decides_about_weak_candidates(spark):
    """National numbers with words that speak for them are added, those of versions and invoices aren't."""
    rng = random.Random(9)
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    texts, real = [], []
    for i in range(400):
        yes = i % 2 == 0
        person = f"write to p{i}@mail.com or +1 (988) 555-{rng.randrange(1000, 9999)}, " if yes else ""
        texts.append(f"{person}{rng.choice(('phone', 'call', 'mobile')) if yes else rng.choice(('invoice', 'version', 'order'))} {number() if yes else '1' + number()[1:]} end")
        real.append(yes)
    got = {r["doc_id"]: r["kind"] for r in by_text(spark, pii.personal_parts, texts).where(F.col("kind") == pii.NAMES.index("tel")).collect()}
    assert set(got) == {i for i, yes in enumerate(real) if yes}


def test_training_follows_soft_labels():
    rng = np.random.default_rng(3)
    x = (rng.random((500, 4)) < 0.5).astype(float)
    x[:, 0] = 1
    w = np.array([-1.0, 2.0, -1.5, 0.5])
    p, n = 1 / (1 + np.exp(-x @ w)), rng.integers(1, 50, 500).astype(float)
    got = pii.train(x, p, n)
    assert np.abs(1 / (1 + np.exp(-x @ got)) - p).max() < 0.03
    assert np.abs(pii.train(x, np.full(500, 0.5), n)).max() < 1e-6


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.5
    say = lambda acc: np.where(rng.random(4000) < acc, y, ~y) * 2 - 1
    v = np.stack([say(0.95), say(0.7), say(0.85), np.zeros(4000, int)], 1)
    p, right = pii.estimate(np.zeros(4000, int), v, np.ones(4000))
    assert right[0] > right[2] > right[1]
    assert ((p > 0.5) == y).mean() > 0.93
