"""SimHash, language, fingerprints, decontamination and quality."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from backmatch.llm import buckets, components, decontamination, fingerprints, language, quality, simhash

from pyspark.sql import functions as F

from .conftest import TEXTS


def print_of(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(prints, limit):
    name = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit:
                a, b = sorted((name[i], name[j]))
                name = [a if x == b else x for x in name]
    return name


def test_trie_equals_brute_force():
    rng = np.random.default_rng(0)
    for k in range(25):
        base = rng.integers(0, 2**63, 15, dtype=np.uint64)
        x = base[rng.integers(0, 15, 200)]
        for _ in range(k % 6):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
        x = np.unique(x)
        assert simhash.trie_classes(np.zeros(len(x), int), x, x[:, None], 64, 3, 3).tolist() == classes(x.tolist(), 3)


def test_trie_on_equal_words_of_a_dense_group():
    """Prints beyond the trie's word decide; many rows share one word."""
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, (1, 4), dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (3000, 4), dtype=np.uint64))
    prints[:, 0] = 5
    got = simhash.trie_classes(np.zeros(3000, int), np.full(3000, 5, np.uint64), prints, 32, 3, 6)
    assert set(got.tolist()) == {0}


def test_simhash_classes(spark, docs, no_docs):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(12)]
    for t in list(texts):
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (int.from_bytes(r["print"], "little"), r["component_id"]) for r in simhash.near_duplicate_classes(df).collect()}
    prints = [print_of(t) for t in texts]
    assert got == dict(enumerate(zip(prints, classes(prints, 3), strict=True)))
    rows = simhash.near_duplicate_classes(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert (by[1], by[2], by[3], by[4], by[5], by[6], by[None]) == (1, 1, 1, 4, 4, 4, None)
    assert simhash.near_duplicate_classes(no_docs).count() == 0


def test_similar_documents(spark, docs, no_docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(250)] for _ in range(40)]
    rows = []
    for i, w in enumerate(base):
        rows.append((i * 10, " ".join(w)))
        for k in range(1, 4):
            v = list(w)
            for at in rng.sample(range(250), 3):  # at most 15 of 246 shingles change
                v[at] = f"edit{rng.random()}"
            rows.append((i * 10 + k, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash.keep_representatives(df).collect()}
    assert {i * 10 for i in range(40)} <= kept and len(kept) <= 41
    out = simhash.keep_representatives(docs)
    assert out.columns == docs.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert ids == sorted([1, 4, 7, 8, 9, 10, None], key=str)
    assert simhash.keep_representatives(no_docs).count() == 0


def exact_components(texts):
    """The first text of each one's component, linked at a similarity of 0.8 of five-word shingle sets."""
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    comp = np.arange(len(sets))
    links = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 and sets[i] and sets[j]]
    return simhash._connect(comp, *np.array(links).T).tolist()


def test_similarity_decides_links(spark):
    """Pairs on both sides of 0.8, also of short sets; what the fingerprints say doesn't count."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in [8, 9, 12, 14, 20, 23, 24, 27, *[rng.randrange(30, 400) for _ in range(40)]]:
        base = [rng.choice(words) for _ in range(n)]
        texts.append(" ".join(base))
        for share in (0.05, 0.08, 0.1, 0.11, 0.12, 0.15, 0.2):  # one run that's other, J = (1 - s) / (1 + s) or so
            v = list(base)
            k = max(1, round((n - 4) * share))
            v[n - k :] = [f"edit{rng.random()}" for _ in range(k)]
            texts.append(" ".join(v))
        texts.append(" ".join(base[: -max(1, round((n - 4) * 0.2))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(df).collect()}
    assert got == dict(enumerate(exact_components(texts)))


def test_rows_of_one_id(spark):
    """Repeated rows are one, rows with other texts are rows of their own, rows without an id come last."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, 1), (1, a, 2), (1, b, 3), (1, b + " more", 4), (2, c, 5), (3, a + " more", 6), (None, c + " more", 7), (None, "alone as can be", 8), (None, "alone as can be", 9), (2, "quite another text", 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, hash int")
    out = simhash.keep_representatives(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    one_b = [t for i, t in got if i == 1 and t != a]
    assert len(one_b) == 1 and one_b[0] in (b, b + " more")
    assert got == sorted([(1, a), (1, one_b[0]), (2, c), (2, "quite another text"), (None, "alone as can be")], key=str)
    near = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicate_classes(df.where("doc_id is null")).collect()}
    assert near == {(None, None)}


def edits(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randrange(1, most)):
            w[at] = f"edit{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_large_buckets_are_dealt_in_blocks(spark):
    """With a bound of a few rows for each task, the classes are those of brute force all the same."""
    rng = random.Random(12)
    texts = [t for _ in range(4) for base in [[f"w{rng.randrange(3000)}" for _ in range(120)]] for t in edits(rng, base, 40, 5)]
    texts += [" ".join(f"w{rng.randrange(3000)}" for _ in range(100)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(df, limit=20_000).collect()}
    assert got == dict(enumerate(exact_components(texts)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_classes(df, limit=4000).collect()}
    assert got == dict(enumerate(classes([print_of(t) for t in texts], 3)))


def test_blocks_let_all_pairs_of_strangers_meet(spark):
    rng = random.Random(13)
    rows = [(rng.randrange(3), i, bytes([rng.randrange(30)])) for i in range(300)]
    df = spark.createDataFrame(rows, "key bigint, node bigint, print binary")
    got, links = buckets.dealt(df, F.lit(50), "print", lambda d: d.withColumn("hit", F.col("print") == F.col("centre")), limit=1000)
    groups = {}
    for r in got.collect():
        groups.setdefault((r["key"], r["part"]), set()).add(r["node"])
    linked = {frozenset((r["u"], r["v"])) for r in links.collect()}
    assert max(map(len, groups.values())) < 60
    met = {frozenset((a, b)) for g in groups.values() for a in g for b in g}
    for k in range(3):
        own = [(n, p) for key, n, p in rows if key == k]
        first = min(own)
        for n, p in own:
            assert (p == first[1]) == (n == first[0] or frozenset((n, first[0])) in linked)
        assert all(frozenset((a, b)) in met for a, p in own for b, q in own if first[1] not in (p, q) or (p == first[1]) != (q == first[1]))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    name = {}
    find = lambda x: x if name.setdefault(x, x) == x else find(name[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        name[b] = a
    df = spark.createDataFrame([*edges, (5, None), (7, 7)], "u bigint, v bigint")
    for hub in (None, 3):
        got = {r["node"]: r["component"] for r in components.components(df, hub).collect()}
        assert got == {x: find(x) for x in name if find(x) != x}
    assert components.components(df.limit(0)).count() == 0


# -- language


def brute_phrases(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_equal_brute_force():
    rng = random.Random(4)
    sample = "".join(rng.choice("abcd ") for _ in range(400))
    p = language.Parser((("x", sample), ("y", "zzz yyy")))
    fold = lambda s: " ".join(s.split(" "))
    for _ in range(50):
        t = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 200)))
        got, n = p.phrases([t])
        assert n[0] == len(t)
        assert got[0, 0] == brute_phrases(fold(t), " ".join(sample.split()))


def test_language_held_out(spark, no_docs):
    rng = random.Random(5)
    tongue = {"aa": ["th", "er", "on", "an"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["eau", "ou", "é", "tion"]}
    rows = [(i, " ".join("".join(rng.choice(tongue[g]) for _ in range(3)) for _ in range(30)), g) for i in range(300) for g in [rng.choice(list(tongue))]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify_languages(df).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    real = [(i, g) for i, _, g in rows if i < 300]
    assert np.mean([got[i]["lang_pred"] == g for i, g in real]) > 0.98
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify_languages(no_docs).count() == 0
    planes = spark.createDataFrame([(1, "\U00031350\U00031351"), (2, "\U0001d400 x"), (3, "مرحبا")], "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    assert all(r["lang_pred"] in tongue and 0 < r["score"] <= 1 for r in language.identify_languages(planes, language.sample(df)).collect())
    assert language.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).first()["lang_pred"] == "und"


def test_the_sample_is_bounded(spark):
    """Thousands of rows of one id, or of one long text, count once; long texts serve only where there are no others."""
    rows = [(8, "same text again", "aa")] * 3000 + [(8, f"other text {i}", "bb") for i in range(3000)] + [(9, "x" * 50_000, "aa"), (13, "y" * 50_000, "cc"), (16, "word " * 100, "bb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in (8, 9, 13, 16))
    got = dict(language.sample(df))
    assert got["aa"].split("\n") == ["same text again", "x" * language.SAMPLE_TEXT] and got["cc"] == "y" * language.SAMPLE_TEXT
    assert len(got["bb"].split("\n")) <= language.SAMPLE_DOCS and len(got["bb"]) <= language.SAMPLE_CHARS + language.SAMPLE_DOCS


def test_an_alphabet_of_thousands_of_letters():
    rng = random.Random(2)
    sample = "".join(chr(0x4E00 + int(3000 * rng.random() ** 2)) for _ in range(12_000))
    p = language.Parser((("zh", sample), ("en", "the quick brown fox " * 20)))
    assert len(p.tables[0].owner) < 200_000  # transitions, not states times letters
    for _ in range(20):
        at = rng.randrange(11_000)
        t = sample[at : at + 50] + chr(0x4E00 + rng.randrange(3000)) + sample[at // 2 : at // 2 + 30]
        assert p.phrases([t])[0][0, 0] == brute_phrases(t, sample)
    assert p.predict([sample[500:600], "the brown fox"])[0] == ["zh", "en"]


# -- fingerprints


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_fingerprints_equal_brute_force(spark, parts):
    rng = random.Random(6)
    rows = [(i * 3, "".join(rng.choice("aB é\n😀") for _ in range(rng.randrange(0, 30)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.digest(t)[0] and r["edited_fingerprint"] == fingerprints.digest(e)[0]
        assert r["near_edited"] == float(fingerprints.canonical(t) == fingerprints.canonical(e))
        assert r["near_next"] == float(fingerprints.canonical(t) == fingerprints.canonical(nxt))


@pytest.mark.parametrize("some_null", [False, True])
def test_an_id_of_many_rows_is_split(spark, some_null):
    """Ranges of a few rows; a third of the rows share an id, with texts that differ; some have none."""
    rng = random.Random(7)
    rows = [(rng.choice((50, rng.randrange(100), None if some_null else 7)), "".join(rng.choice("aB é\n😀") for _ in range(rng.randrange(1, 30)))) for _ in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + [next(r for r in order if r[0] is not None)], strict=True):
        half = len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    out = fingerprints.fingerprints(df, range_chars=100)
    assert out.rdd.getNumPartitions() > 15
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in out.collect()), key=str) == sorted(want, key=str)
    sizes = [len(p) for p in out.select("doc_id").rdd.glom().collect()]
    assert max(sizes) < 40


def test_all_ids_null(spark):
    df = spark.createDataFrame([(None, "abcd"), (None, "efgh")], "doc_id bigint, text string")
    assert {r["edited_sha256"] for r in fingerprints.fingerprints(df).collect()} == {hashlib.sha256(x).hexdigest() for x in (b"abef", b"efab")}


def test_canonical_form():
    assert fingerprints.canonical("  ﬁn\n STRASSE  É") == fingerprints.canonical("FIN straße é")
    assert fingerprints.canonical("a b") != fingerprints.canonical("ab")


def test_fingerprint_rows(spark, docs, no_docs):
    assert fingerprints.fingerprints(docs).count() == len(TEXTS)
    assert fingerprints.fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")
    r = fingerprints.fingerprints(one).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0 and r[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_exact_classes(spark):
    df = spark.createDataFrame([(4, "A  b"), (2, "a b"), (9, "c"), (7, None), (8, " ")], "doc_id bigint, text string")
    found = fingerprints.canonical_texts(df).select("doc_id", "fingerprint")
    own = {r["class_id"] for r in fingerprints.exact_classes(df, found).collect()}
    assert own == {2, 9, 7}
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.with_classes(df, found).collect()}
    assert got == {4: 2, 2: 2, 9: 9, 7: 7, 8: 7}


def test_bytes_decide_in_a_bucket(spark, monkeypatch):
    """With fingerprints that all collide, the canonical bytes still tell texts apart."""
    def colliding(docs):
        return docs.select("doc_id", F.lit("0").alias("fingerprint"), F.coalesce("text", F.lit("")).alias("canonical"))

    monkeypatch.setattr(fingerprints, "canonical_texts", colliding)
    df = spark.createDataFrame([(4, "x"), (2, "y"), (9, "x"), (7, "y"), (8, "z")], "doc_id bigint, text string")
    found = colliding(df).select("doc_id", "fingerprint")
    assert {r["doc_id"]: r["class_id"] for r in fingerprints.with_classes(df, found).collect()} == {4: 4, 9: 4, 2: 2, 7: 2, 8: 8}


# -- decontamination


def question(name, n, unit="km"):
    return f"Yesterday we learned that {name} walked {n} {unit} before breakfast and then walked {n} {unit} again, how far was it altogether for {name} on that day?"


def test_reparameterised_questions(spark, no_docs):
    bench = spark.createDataFrame([(1, question("Alice", 12)), (2, "a plain passage of benchmark words without any number in it that goes on for some time"), (3, None), (4, "four short plain words"), (5, "very rare"), (6, "?!"), (7, "unheardof")], "item_id bigint, text string")
    pad = " ".join(f"filler{chr(97 + i % 26)}" for i in range(300))
    rows = [
        (10, f"{pad}. {question('Alice', 12)} {pad}"),
        (11, f"{pad}. {question('Robert', 85, 'miles')} {pad}"),
        (12, f"{pad}. {question('Alice', 12).replace('12 km again', '99 km again')} {pad}"),
        (13, f"{pad} A PLAIN passage, of benchmark words; without any number in it that goes on for some time! {pad}"),
        (14, pad),
        (15, "without any number in it"),
        (16, f"{pad} four short plain words {pad}"),
        (17, None),
        (18, ""),
        (13, pad),
        (19, f"{pad} Very, rare {pad}"),
        (20, f"{pad} rare unheardof"),
        (None, f"{pad} four short plain words"),
        (None, pad),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS hash")
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontamination.contamination(df, bench).collect()}
    assert got == {(10, 1): True, (11, 1): False, (13, 2): True, (16, 4): True, (19, 5): True, (20, 7): True, (None, 4): True}
    left = decontamination.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == [12, 13, 14, 15, 17, 18, None]
    assert decontamination.contamination(no_docs, bench).count() == 0
    assert decontamination.contamination(df, bench.limit(0)).count() == 0


PAD = " ".join(f"filler{chr(97 + i % 26)}" for i in range(60))


def found(spark, docs, items):
    """Indexes of (document, item) pairs."""
    df, bench = (spark.createDataFrame(list(enumerate(x)), f"{k} bigint, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))
    return {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontamination.contamination(df, bench).collect()}


def test_every_place_is_compared(spark):
    q = question("Alice", 12)
    other = q.replace("12 km again", "99 km again")
    assert found(spark, [f"{PAD}. {other} {PAD}. {q} {PAD}", f"{PAD}. {q} {PAD}. {other} {PAD}", f"{PAD}. {other} {PAD}. {other} {PAD}"], [q]) == {(0, 0): True, (1, 0): True}


def test_long_passages_are_found(spark):
    """13 tokens running are enough, 12 of a long item aren't; values outside of them don't count."""
    item = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)).split()
    slotted = [*item[:20], "12", *item[20:40], "12", *item[40:]]
    docs = [f"{PAD} {' '.join(w)} {PAD}" for w in (item[7:20], item[7:19], item[20:49], [*item[:7], "x", *item[8:15]])]
    assert found(spark, docs, [" ".join(item)]) == {(0, 0): True, (2, 0): True}
    near = " ".join([*slotted[14:27], *["other"] * 14, "99"])  # 12 inside, another number where the item has 12 again
    assert found(spark, [f"{PAD} {near} {PAD}"], [" ".join(slotted)]) == {(0, 0): True}


def test_names_after_units(spark):
    """A name behind a unit doesn't shift the values of the names further on."""
    item = "In the yard stood Alice with a ladder while Bob painted the fence, then Bob went home and Alice cleaned the brushes with care"
    assert found(spark, [f"{PAD} for 3 hours Carol drove 5 km Berlin was far {PAD}. {item} {PAD}"], [item]) == {(0, 0): True}


def test_items_of_numbers_and_units(spark):
    """Found verbatim and with other parameters; rows of numbers verbatim only."""
    items = ["Is 12 + 30 + 7 + 9 equal to 58?", "Convert 5 km to 3 m", "11 12 13 14 15 16 17 18 19 20"]
    docs = [f"{PAD}. {t} {PAD}" for t in (*items, "Is 1 + 2 + 3 + 4 equal to 10?", "Convert 8 miles to 2 cm", "21 22 23 24 25 26 27 28 29 30", "Is 5 + 5 + 6 + 7 equal to 23 or 1 2 3 4 5 km")]
    assert found(spark, docs, items) == {(0, 0): True, (1, 1): True, (2, 2): True, (3, 0): False, (4, 1): False, (6, 0): False}


def test_capitalised_items_inside_a_sentence(spark):
    items = ["Which ocean is the deepest of them all?", "Which river is longest?", "New York has how many bridges over the water?"]
    docs = [f"{PAD}{before}{t} {PAD}" for t in items for before in (" the page says ", ". ", ' says "')]
    assert found(spark, docs + items, items) == {(i, k): True for k in range(3) for i in (3 * k, 3 * k + 1, 3 * k + 2, 9 + k)}


def random_item(rng, n):
    """Tokens of any kind: words, names, numbers, units, signs."""
    kinds = [lambda: f"w{rng.randrange(50)}x".translate({ord(str(d)): chr(97 + d) for d in range(10)}), lambda: rng.choice(("Anna", "Bo", "Carla")), lambda: str(rng.randrange(200)), lambda: f"{rng.randrange(50)} {rng.choice(('km', 'kg', 'hours', '%'))}", lambda: rng.choice(("+", "-", "=", "?"))]
    weight = [rng.random() ** 2 for _ in kinds]
    text = " ".join(f() for f in rng.choices(kinds, weight, k=n))
    return text if any(map(str.isalnum, text)) else text + " 7"


def test_every_item_is_found_verbatim(spark):
    """Random items of 1 to 60 tokens, from no number to nothing else, pasted into running text."""
    rng = random.Random(21)
    items = [random_item(rng, rng.choice((1, 2, 3, 4, 5, 7, 8, 9, 13, 20, 40, 60))) for _ in range(120)]
    docs = [f"{PAD}{rng.choice((' ', '. ', ' said: ', ' Then '))}{t}{rng.choice((' ', '. ', ', '))}{PAD}" for t in items]
    got = found(spark, docs, items)
    assert {i for i, k in got if i == k} == set(range(len(items))), [(items[i], docs[i]) for i in range(len(items)) if (i, i) not in got]


def test_recall_of_other_parameters(spark):
    """Questions with other names, numbers and units: at least nine in ten are found."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(3, 8)))
    names, units = ["Anna", "Bert", "Carla", "David", "Emma", "Frank"], ["km", "kg", "hours", "days"]
    items, docs = [], []
    for _ in range(60):
        parts = [rng.choice(("{n}", "{k} {u}", "{k}", None)) if rng.random() < 0.25 else word() for _ in range(30)] + ["{n}", "then", "{n}", word(), word()]
        form = " ".join(["when", *(p or word() for p in parts)])
        put = lambda n, k, u: form.format(n=n, k=k, u=u)  # noqa: E731, B023
        items.append(put("Anna", 12, "km"))
        docs.append(f"{PAD}. {put(rng.choice(names[1:]), rng.randrange(100), rng.choice(units))} {PAD}")
    got = found(spark, docs, items)
    assert sum((i, i) in got for i in range(60)) >= 54


# -- quality


def test_quality_held_out(spark, docs, no_docs):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(10, 120))]
        rows.append((i, " ".join(w) + "." if good else "!! ".join(x.upper() for x in w) if rng.random() < 0.5 else " ".join([w[0]] * 40)))
        labels.append((i, int(good)))
    rows += [(5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS quality", "'x' AS y")
    lab = spark.createDataFrame(labels + [(3, None), (9999, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(df, lab).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([got[i]["predicted"] == dict(labels)[i] for i in held]) > 0.97
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert quality.score_quality(no_docs, lab).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, lab.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score_quality(df, lab.where("quality = 1")).collect()} == {1.0}


def plain_statistics(t):
    """The statistics by their definition, one character or word at a time."""
    b = t.encode()
    w = b.split()
    share = lambda k, of, least: np.log((k + least) / (of + 1))
    count = lambda chars: sum(chr(c) in chars for c in b)
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,!?'-")
    space, line = count(" \t"), count("\n\r")
    again = sum(w[i] == w[i - 1] for i in range(1, len(w)))
    top = max((w.count(x) for x in set(w)), default=0)
    inner = sum(b[i : i + 1] == b"," and b[i + 1 : i + 2] not in (b" ", b"\n") for i in range(len(b)))
    return [np.log(len(b) + 1), share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len(b), 0.5), share(count("0123456789"), len(b), 0.5), share(count(".,"), len(b), 0.5), share(count("!?"), len(b), 0.2), share(count(marks), len(b), 0.2), share(space, len(b), 0.5), share(line, len(b), 0.5), np.log((len(b) - space - line + 1) / (len(w) + 1)), np.log(len(set(w)) + 1) / np.log(len(w) + 2), share(again, len(w), 0.2), share(top, len(w), 0.5), share(inner, len(w), 0.2)]


def test_statistics_equal_their_definition():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice(["a", "B", "7", ", ", ",", ".", "! ", "#", " ", "  ", "\n", "é", "😀", "the ", "the ", "'"]) for _ in range(rng.randrange(0, 60)))
        assert np.allclose(quality.statistics(t), plain_statistics(t)), t


def test_fit_equals_its_definition(spark):
    """Means and shrunken covariances from one aggregation are those of the rows themselves."""
    rng = np.random.default_rng(2)
    n, k = len(quality.FEATURES), 120
    x, y = rng.normal(size=(k, n)) @ rng.normal(size=(n, n)), rng.integers(0, 2, k)
    found = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, x array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id bigint, quality int")
    use = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(k)])
    m = quality.fit(found, labels)
    cov = {c: np.cov(x[use & (y == c)].T, bias=True) for c in (0, 1)}
    size = {c: (use & (y == c)).sum() for c in (0, 1)}
    pooled = sum(cov[c] * size[c] for c in cov) / use.sum()
    pooled = (1 - quality.TO_IDENTITY) * pooled + quality.TO_IDENTITY * (np.trace(pooled) / n + 1e-6) * np.eye(n)
    for c in cov:
        a = max(quality.TO_POOLED, n / (n + size[c]))
        want = (1 - a) * cov[c] + a * pooled
        assert np.allclose(m.means[c], x[use & (y == c)].mean(0))
        assert np.allclose(np.linalg.inv(m.factors[c]) @ np.linalg.inv(m.factors[c]).T, want)
        assert np.isclose(m.weights[c], np.log(size[c] / use.sum()) - np.linalg.slogdet(want)[1] / 2)


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i % 977}" for i in range(15_000)) + " ."
    df = spark.createDataFrame([(1, long, 5.0, 6, 7), (2, None, 1.0, 2, 3)], "doc_id bigint, text string, score double, x int, y int")
    lab = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    assert quality.score_quality(df, lab).columns == ["doc_id", "held_out", "score", "predicted"] and quality.score_quality(df, lab).count() == 2
    assert quality.keep_good(df, lab).columns == df.columns
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(500, 540)))], "item_id bigint, text string")
    clash = df.selectExpr("*", "1 AS values", "2 AS text_hash", "3 AS at")
    assert [tuple(r)[:2] for r in decontamination.contamination(clash, bench).collect()] == [(1, 1)]
    assert [r["doc_id"] for r in decontamination.drop_contaminated(clash, bench).collect()] == [2]


def test_score_equals_the_densities():
    rng = np.random.default_rng(9)
    n = len(quality.FEATURES)
    a, b = rng.normal(size=(n, n)), rng.normal(size=(n, n))
    covs, means = [a @ a.T + np.eye(n), b @ b.T + np.eye(n)], [rng.normal(size=n), rng.normal(size=n)]
    f = [np.linalg.inv(np.linalg.cholesky(c)) for c in covs]
    m = quality.Model(tuple(means), tuple(f), tuple(np.log(0.5) - np.log(np.diag(np.linalg.cholesky(c))).sum() for c in covs))
    x = rng.normal(size=(20, n))
    d = [-0.5 * (np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu) + np.linalg.slogdet(c)[1]) for mu, c in zip(means, covs, strict=True)]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-np.clip((d[1] - d[0]) / n, -40, 40))))
