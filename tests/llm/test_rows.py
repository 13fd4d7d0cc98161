"""The registered queries over written tables: every column of every row against brute force."""

import hashlib
import random
import zlib

import pytest
from backmatch.llm import byte_bpe, fingerprints, language, quality, simhash, token_counts
from backmatch.llm.token_counts import default_path

from .conftest import TEXTS
from .test_documents import classes, print_of
from .test_tokens import reference


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    words = ["alpha", "Beta", "gamma,", "délta", "x1", "123", "don't", "ünd", "\n", "的", "😀", "the", "of"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += [t + " end" for t in texts[:10]] + texts[:10] + [t for _, t in TEXTS if t is None or len(t) < 1000]
    order = list(range(0, 3 * len(texts), 3))
    rng.shuffle(order)
    return list(zip(order, texts, strict=True))


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame([(i, t, "ab"[i % 2] if i % 5 else None, "s", len(t or ""), 1, 2.0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, print int, score double")
    df.repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 3 % 2, 0) for i, _ in rows if i % 2], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def collected(df):
    got = {r["doc_id"]: r.asDict() for r in df.collect()}
    return got


def test_token_counts(spark, rows, tables):
    own = token_counts.Counter(default_path())
    want = {}
    for i, t in rows:
        n = len(own.tokenizer.encode(t or "", add_special_tokens=False))
        want[i] = {"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": n, "over_limit": n > 2048}
    assert collected(token_counts.op2_token_counts(spark, tables)) == want


def test_simhash(spark, rows, tables):
    prints = [print_of(t) for _, t in rows]
    comp = classes(prints, 3)
    least = {c: min(i for (i, _), k in zip(rows, comp, strict=True) if k == c) for c in set(comp)}
    want = {i: {"doc_id": i, "fingerprint": f"{p:016x}", "component_id": least[c]} for (i, _), p, c in zip(rows, prints, comp, strict=True)}
    assert collected(simhash.op5_simhash(spark, tables)) == want


def test_byte_bpe(spark, rows, tables):
    other, own = reference(), byte_bpe.codec()
    got = collected(byte_bpe.op7_byte_bpe(spark, tables))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        e = own.tokenizer.encode(t or "", add_special_tokens=False)
        offsets = b"".join(x.to_bytes(4, "little") for pair in e.offsets for x in pair)
        assert got[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids)).encode()), "decoded_sha256": sha((t or "").encode()), "offsets_sha256": sha(offsets)}


def test_fingerprints(spark, rows, tables):
    order = sorted((i, t or "") for i, t in rows)
    canon = {i: fingerprints.canonical(t) for i, t in order}
    want = {}
    for (i, t), (j, nxt) in zip(order, order[1:] + order[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want[i] = {"doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "fingerprint": fingerprints.digest(t)[0], "edited_fingerprint": fingerprints.digest(e)[0], "near_edited": float(canon[i] == fingerprints.canonical(e)), "near_next": float(canon[i] == canon[j]), "class_id": min(k for k in canon if canon[k] == canon[i])}
    assert collected(fingerprints.op8_fingerprints(spark, tables)) == want


def test_folds_of_the_learned_queries(spark, rows, tables):
    """held_out by the id alone; scores and labels in range."""
    got, found = collected(language.op6_language(spark, tables)), collected(quality.op10_quality(spark, tables))
    assert set(got) == set(found) == {i for i, _ in rows}
    for i, t in rows:
        crc = zlib.crc32(str(i).encode())
        assert got[i]["held_out"] == (crc % 4 == 2) and found[i]["held_out"] == (crc % 3 == 1)
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or ""))) and got[i]["lang_pred"] in ("a", "b", "und")
        assert 0 <= got[i]["score"] <= 1 and 0 <= found[i]["score"] <= 1 and found[i]["predicted"] == (found[i]["score"] >= 0.5)
