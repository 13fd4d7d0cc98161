"""Operator 7, byte-level BPE encoding and decoding.

The ``tokenizers`` library encodes Arrow batches.  Its vocabulary writes each
byte as one printable character; ids are turned back into bytes through the
reverse of that table, so characters split over tokens come back whole.  The
merges are derived from a rank file, so the same ranks serve any library.
Offsets in code points follow from the tokens' bytes: a character split over
tokens is in the range of each.

Texts go to the library whole, in groups of about equal size.  A single space
between two non-space characters always begins a new match of the pattern, so
a very long text is cut at such spaces and the ids of its parts follow each
other; they are those of encoding it in one go.

Defined results: null text is an empty text (no ids, the digests of nothing);
very long texts are encoded whole; repeated rows are each encoded; extra
columns are ignored, also those that ``keep`` doesn't name; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches, lean, table
from .token_counts import default_path

RANKS = "byte_bpe_50k.tiktoken"
#: Code points of texts that are encoded together, and of the parts of a longer one.
TOGETHER = 1 << 18


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself,
    the rest is numbered from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of several bytes, in rank order: what is left of the
    token when only lower ranks have been merged."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(rank, 0))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encode and decode with one rank file; ``pattern`` splits texts before merging."""

    def __init__(self, path: str, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_characters()
        written = lambda b: "".join(chars[x] for x in b)
        self.tokenizer = Tokenizer(models.BPE(vocab={written(t): r for t, r in ranks.items()}, merges=[(written(a), written(b)) for a, b in merges(ranks)]))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern or public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(chars)}
        # from the written form back to bytes, as the library hands tokens out
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}
        self.size_of = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, t in self.bytes_of.items():
            self.size_of[i] = len(t)
        self.decimal = {i: str(i) for i in self.bytes_of}

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        ids: list[int] = []  # of the parts of a text so far
        for group in grouped([parted(t, TOGETHER) for t in texts], TOGETHER):
            found = self.tokenizer.encode_batch_fast([p for p, _ in group], add_special_tokens=False)
            for (_, last), e in zip(group, found, strict=True):
                ids += e.ids
                if last:
                    yield ids
                    ids = []

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def written_ids(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> np.ndarray:
        """Start and end in code points of each id of a text; a character split over tokens is in the range of each."""
        size = self.size_of[np.array(ids, np.int64)]
        end = np.cumsum(size)
        start = end - size
        if not text.isascii():
            octets = np.frombuffer(text.encode(), np.uint8)
            at = np.cumsum((octets & 0xC0) != 0x80)  # the number of the character that a byte is of, from 1
            start, end = at[start] - 1, at[end - 1]
        return np.stack([start, end], 1).astype("<i4")

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text for each id in turn; an incomplete character waits for its other bytes."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield held.decode(self.bytes_of[i])
        if rest := held.decode(b"", final=True):
            yield rest


#: A space that always begins a match.
_BEGINS = re.compile(r"(?<=\S) (?=\S)")


def parted(text: str, size: int) -> list[str]:
    """Parts of about ``size`` code points, each but the first with its leading space; one where there is no such space."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while (m := _BEGINS.search(text, at + size)) is not None:
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def grouped(texts: list[list[str]], size: int) -> Iterator[list[tuple[str, bool]]]:
    """The parts of all texts in groups of at most ``size`` code points, but for longer parts, which go alone; with
    whether a part is its text's last."""
    group: list[tuple[str, bool]] = []
    held = 0
    for parts in texts:
        for k, p in enumerate(parts, 1):
            if group and held + len(p) > size:
                yield group
                group, held = [], 0
            group.append((p, k == len(parts)))
            held += len(p)
    if group:
        yield group


_CODECS: dict[tuple[str, str | None], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """One per worker process."""
    key = (path or default_path(RANKS), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = False, keep: tuple[str, ...] = (), offsets: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, with ``ids`` the ids too, with ``offsets`` offsets_sha256, a digest
    of the ids' starts and ends as 32-bit little-endian numbers; the columns in ``keep`` are carried along."""
    path = path or default_path(RANKS)
    arrow_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = "doc_id long, " + "".join(f"`{k}` {kinds[k]}, " for k in keep) + "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", offsets_sha256 string" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = [[], [], [], [], []]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for t, got in zip(texts, own.encode_batch(texts), strict=True):
                rows[0].append(len(got))
                rows[1].append(digest(own.written_ids(got).encode()))
                rows[2].append(digest(own.decode_bytes(got)))
                if ids:
                    rows[3].append(pa.array(got, pa.int32()))
                if offsets:
                    rows[4].append(digest(own.offsets(t, got).tobytes()))
            more = [pa.ListArray.from_arrays(pa.array([0, *_running(len(x) for x in rows[3])], pa.int32()), pa.concat_arrays(rows[3]) if rows[3] else pa.array([], pa.int32()))] if ids else []
            if offsets:
                more.append(pa.array(rows[4], pa.string()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(b.column(i + 2) for i in range(len(keep))), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), *more],
                ["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["offsets_sha256"] * offsets],
            )

    return docs.select("doc_id", "text", *keep).mapInArrow(lean(run), schema)


def _running(lengths: Iterable[int]) -> Iterator[int]:
    n = 0
    for x in lengths:
        n += x
        yield n


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), offsets=True)
