"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from backmatch.llm import byte_bpe, token_counts
from backmatch.llm.token_counts import default_path

from .conftest import TEXTS

ALPHABET = [*"abcAB'sré ñ  \n\t\r 12中́😀.,!\x1c\x85　ß²_-", "<|endoftext|>", "  ", "   ", "\n\n", " \n", "'s", "'ll", "123", " <|startoftext|> ", "word", " Wörter"]


def fuzz(n=1500, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)] + [t or "" for _, t in TEXTS]


def test_counts_equal_the_library():
    own, texts = token_counts.counter(default_path()), fuzz()
    assert own.count(texts) == [len(e) for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces_are_cut_safely():
    own, text = token_counts.Counter(default_path()), "ab1c2" * 40_000
    assert len(token_counts.pieces(text)) > 1
    assert own.count([text]) == [len(own.tokenizer.encode(text, add_special_tokens=False))]


def test_every_safe_boundary_changes_nothing(monkeypatch):
    """All texts cut wherever long pieces may be."""
    monkeypatch.setattr(token_counts, "LONG_PIECE", 3)
    rng = random.Random(8)
    parts = [*"abZΣσ07'<|>_.,:;-!?@[]{}~`^%$#&*()+=/\\\"", "é", "\u0301", "中", "ß", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", " ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(4, 40))) for _ in range(3000)]
    own = token_counts.Counter(default_path())
    assert sum(map(len, map(token_counts.pieces, texts))) > 12_000
    assert own.count(texts) == [len(e) for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_batches_are_balanced_by_bytes():
    got = list(token_counts.balanced(["aé" * 10] * 9 + ["x" * 100], 64))
    assert sum(got, []) == ["aé" * 10] * 9 + ["x" * 100]
    assert all(sum(len(t.encode()) for t in g) <= 64 or len(g) == 1 for g in got)


def test_count_rows(docs, no_docs):
    rows = token_counts.token_counts(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["n_tokens"] == by[5]["n_tokens"] == by[5]["n_bytes"] == 0
    assert by[7]["over_limit"] and not by[1]["over_limit"]
    assert by[10]["n_bytes"] == len(TEXTS[10][1].encode())
    assert token_counts.token_counts(no_docs).count() == 0


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_and_decode():
    own, other = byte_bpe.codec(), reference()
    for t in fuzz(3000, 4):
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t), t
        assert own.decode_bytes(ids) == t.encode()
        assert "".join(own.decode_stream(ids)) == t


def test_parts_and_groups_change_nothing(monkeypatch):
    own, other = byte_bpe.codec(), reference()
    texts = fuzz(600, 5)
    want = [other.encode_ordinary(t) for t in texts]
    for size in (1, 7, 90):
        monkeypatch.setattr(byte_bpe, "TOGETHER", size)
        assert [*own.encode_batch(texts)] == want
        assert all("".join(byte_bpe.parted(t, size)) == t for t in texts)
    assert any(len(byte_bpe.parted(t, 7)) > 2 for t in texts)
    assert max(map(len, byte_bpe.parted("ab " * 1000, 90))) < 100


def test_offsets_and_split_characters():
    own = byte_bpe.codec()
    for text in ["a😀b 中文", "", *fuzz(500, 6)]:
        e = own.tokenizer.encode(text, add_special_tokens=False)
        assert e.ids == own.encode(text)
        assert own.offsets(text, e.ids).tolist() == [list(x) for x in e.offsets], text
    ids = own.encode("😀")
    assert len(ids) > 1 and own.decode(ids[:1]) == "�" and list(own.decode_stream(ids))[-1] == "😀"


def test_document_rows(docs, no_docs):
    rows = byte_bpe.encode_documents(docs, ids=True, keep=("lang", "score"), offsets=True).collect()
    assert len(rows) == len(TEXTS)
    own = byte_bpe.codec()
    for r in rows:
        if r["doc_id"] not in (None, 3):
            t = dict(TEXTS)[r["doc_id"]] or ""
            assert r["n_tokens"] == len(r["ids"])
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
            assert r["score"] == 7
            assert r["offsets_sha256"] == hashlib.sha256(own.offsets(t, r["ids"]).tobytes()).hexdigest()
    assert byte_bpe.encode_documents(no_docs).count() == 0
