"""Operator 2, token counts.

Arrow batches of texts go through the ``tokenizers`` library and only lengths
come back.  The tokenizer never lets a token span white space, so a text is
cut there: each distinct piece is encoded once per worker and its length kept
in a bounded table.  Pieces that are not known yet are encoded in batches of
about equal bytes; very long pieces are cut once more beside digits and ASCII
marks.  A long run of letters alone is one word for the tokenizer and stays
whole.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
are each counted; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches, lean, table

VOCABULARY = "word_bpe_49k.json"
CONTEXT = 2048
#: Bytes handed to the tokenizer at once; pieces kept per worker; longest piece kept.
BATCH_BYTES, KEPT, KEPT_CHARS, LONG_PIECE = 1 << 19, 400_000, 48, 1 << 16

_MARK = r"[!-&(-/:;=?@\[-`{}~]"  # ASCII marks that no contraction and no special token has
#: Nothing joins between a digit and an ASCII letter or digit, as digits are single tokens, or between an ASCII
#: letter or digit and a mark, as runs of letters and of marks are apart; no normalisation composes across these.
_SAFE = re.compile(rf"(?<=[0-9])(?=[0-9A-Za-z])|(?<=[0-9A-Za-z])(?={_MARK})|(?<={_MARK})(?=[0-9A-Za-z])")


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(text: str) -> list[str]:
    """Cut at ASCII white space, and long pieces at the other safe boundaries; order is kept."""
    found = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    if len(text) > LONG_PIECE and any(len(p) > LONG_PIECE for p in found):
        found = [q for p in found for q in (_SAFE.split(p) if len(p) > LONG_PIECE else (p,))]
    return found


def balanced(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive groups of about ``limit`` bytes; a longer text goes alone."""
    group: list[str] = []
    held = 0
    for t in texts:
        n = len(t.encode())
        if group and held + n > limit:
            yield group
            group, held = [], 0
        group.append(t)
        held += n
    if group:
        yield group


class Counter:
    """Token counts of whole texts, equal to encoding each text in one go."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept: dict[str, int] = {"": 0}

    def _learn(self, new: set[str]) -> dict[str, int]:
        lengths: dict[str, int] = {}
        for group in balanced(sorted(new)):
            for t, e in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True):
                lengths[t] = len(e)
        return lengths

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for t in texts:
            cut = pieces(t)
            kept = self.kept
            if new := {p for p in cut if p not in kept}:
                if len(kept) + len(new) > KEPT:
                    kept = self.kept = {"": 0}
                    new = set(cut) - {""}
                more = self._learn(new)
                kept.update((p, n) for p, n in more.items() if len(p) <= KEPT_CHARS)
                out.append(sum(more[p] if p in more else kept[p] for p in cut))
            else:
                out.append(sum(map(kept.__getitem__, cut)))
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, context: int = CONTEXT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    path = path or default_path()
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = own.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > context for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
