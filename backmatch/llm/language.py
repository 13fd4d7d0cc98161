"""Operator 6, language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of
labelled text.  A text is parsed greedily into phrases, each the longest one
that occurs in the sample: the automaton is followed as far as it goes, then
a new phrase begins.  The language that needs the fewest phrases for each
letter wins.

The automaton's transitions are packed into one array by displacing its rows
(each state has an offset, and a place remembers whose it is), so its size is
the number of transitions and not states times letters; parsing is a look-up
for each character that starts anew where no transition exists.  A worker
steps through many segments at once.  Texts are parsed whole, in segments of
``SEGMENT`` characters; each segment begins a new phrase in every language
alike.  Letters are folded to lower case and runs of anything else count as
one gap.

Sample: of each language ``SAMPLE_DOCS`` different (doc_id, text) at most, in
the order of a hash of them, and of these whole texts while they have
``SAMPLE_CHARS`` characters together at most.  Texts longer than
``SAMPLE_TEXT`` characters come last and are cut to that, so they only serve
languages that have too few others.  The ``LANGUAGES`` languages with the most
rows are learned.  Only labelled rows of the learning folds are used.

Defined results: a null text or one without a letter is ``und`` with score
0; with nothing to learn from every text is ``und``; equal phrase counts are
decided by the smaller language name; repeated rows are each answered, and in
the sample they count once; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, fold, lean, table

FOLDS, HELD_OUT = 4, 2
#: Bounds of what is learned from.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TEXT, LANGUAGES = 48, 24_000, 4_000, 400
SEGMENT = 1024
#: Characters parsed in one go.
AT_ONCE = 2_000_000


class Alphabet:
    """Classes of code points: 0 a gap, 1 a letter that no sample has, from 2 on the letters of the samples."""

    def __init__(self, samples: list[str]):
        letters = sorted({c for s in samples for c in s.lower() if c.isalpha()})
        self.table = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), np.int32, 0x110000)
        for k, c in enumerate(letters, 2):
            for v in {c, c.upper(), c.title()}:
                if len(v) == 1:
                    self.table[ord(v)] = k
        self.size = len(letters) + 2

    def codes(self, text: str) -> np.ndarray:
        """Classes of the characters; a run of gaps is one gap."""
        x = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = x != 0
        keep[1:] |= x[:-1] != 0
        return x[keep]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of a suffix automaton, by the usual online construction; state 0 is the root."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in codes:
        now = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


class Packed:
    """An automaton with its transitions in one array: that of state s by c is at ``offset[s] + c`` if ``owner`` there is s."""

    def __init__(self, step: list[dict[int, int]], size: int):
        self.root = np.zeros(size, np.int32)
        self.root[list(step[0])] = list(step[0].values())
        branching = sorted((s for s in range(1, len(step)) if len(step[s]) > 1), key=lambda s: -len(step[s]))
        single = [s for s in range(1, len(step)) if len(step[s]) == 1]
        room = sum(map(len, step)) + 2 * size + 64
        taken = bytearray(2 * room)
        places, lowest = {}, size  # the offset of each state; below ``lowest`` hardly anything is free
        for s in branching:
            cs = sorted(step[s])
            gaps = [c - cs[0] for c in cs[1:]]
            at, tries = lowest, 0
            while True:
                at = taken.find(0, at)
                if not any(taken[at + g] for g in gaps):
                    break
                at += 1
                tries += 1
            if tries > 200:
                lowest = taken.find(0, lowest + (at - lowest) // 2)
            places[s] = at - cs[0]
            for c in cs:
                taken[places[s] + c] = 1
            if at + 2 * size > len(taken):
                taken.extend(bytes(len(taken)))
        at = size
        for s in single:
            (c,) = step[s]
            at = taken.find(0, at)
            if at < 0:
                at = len(taken)
                taken.extend(bytes(len(taken)))
            taken[at] = 1
            places[s] = at - c
        top = max(places.values(), default=0) + size
        self.offset = np.zeros(len(step), np.int32)
        self.owner = np.full(top + size, -1, np.int32)
        self.to = np.zeros(top + size, np.int32)
        for s, o in places.items():
            self.offset[s] = o
            for c, t in step[s].items():
                self.owner[o + c] = s
                self.to[o + c] = t

    def next_of(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a new phrase begins."""
        at = self.offset[state] + c
        new = self.owner[at] != state
        return np.where(new, self.root[c], self.to[at]), new


class Parser:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in samples]
        self.alphabet = Alphabet([t for _, t in samples])
        self.tables = [Packed(automaton(self.alphabet.codes(t).tolist()), self.alphabet.size) for _, t in samples]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases for each text and language; characters for each text."""
        codes = [self.alphabet.codes(t) for t in texts]
        n = np.array([len(c) for c in codes])
        out = np.zeros((len(texts), len(self.names)), np.int64)
        begin = 0
        while begin < len(texts):
            end = begin + 1
            held = n[begin]
            while end < len(texts) and held + n[end] <= AT_ONCE:
                held += n[end]
                end += 1
            if held:
                self._some(codes[begin:end], n[begin:end], out[begin:end])
            begin = end
        return out, n

    def _some(self, codes: list[np.ndarray], n: np.ndarray, out: np.ndarray) -> None:
        flat = np.concatenate(codes)
        per = -(-n // SEGMENT)
        of = np.repeat(np.arange(len(n)), per)
        first = np.concatenate([np.arange(a, a + m, SEGMENT) for a, m in zip(np.cumsum(n) - n, n, strict=True)])
        ends = np.repeat(np.cumsum(n), per)
        size = np.minimum(ends - first, SEGMENT)
        order = np.argsort(-size, kind="stable")
        of, first, size = of[order], first[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        state = np.zeros((len(self.tables), len(first)), np.int32)
        count = np.zeros((len(self.tables), len(first)), np.int64)
        for k, m in enumerate(active):
            c = flat[first[:m] + k]
            for t, own in enumerate(self.tables):
                state[t, :m], new = own.next_of(state[t, :m], c)
                count[t, :m] += new
        for t in range(len(self.tables)):
            out[:, t] += np.bincount(of, count[t], len(n)).astype(np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        some = [t or "" for t in texts]
        p, n = self.phrases(some) if self.names else (np.zeros((len(some), 0)), np.zeros(len(some)))
        names, scores = [], []
        for t, row, k in zip(some, p, n, strict=True):
            if not self.names or not any(map(str.isalpha, t)):
                names.append("und")
                scores.append(0.0)
                continue
            rate = row / k
            best = int(np.argmin(rate))  # the first of equals: names are in order
            e = np.exp(-(rate - rate[best]) * min(k, 400))
            names.append(self.names[best])
            scores.append(float(1 / e.sum()))
        return names, scores


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """One per worker process."""
    return Parser(samples)


def sample(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """(language, text) in the order of the names, within the bounds above."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    learn = learn.select("lang", "doc_id", F.xxhash64("text").alias("hash"), (F.length("text") > SAMPLE_TEXT).alias("long"), "text")
    rows = learn.drop("text")
    names = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    # equal rows share a rank, so repeated ones neither fill the sample nor lengthen it
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "hash"))
    ids = rows.join(F.broadcast(names), "lang").withColumn("k", rank).where(F.col("k") <= SAMPLE_DOCS).distinct()
    found = learn.join(F.broadcast(ids), ["lang", "doc_id", "hash", "long"]).groupBy("lang", "k").agg(F.min(F.substring("text", 1, SAMPLE_TEXT)).alias("text"))
    held: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["k"])):  # at most LANGUAGES * SAMPLE_DOCS short texts
        own = held.setdefault(r["lang"], [])
        if not own or sum(map(len, own)) + len(r["text"]) <= SAMPLE_CHARS:
            own.append(r["text"])
    return tuple((lang, "\n".join(own)) for lang, own in held.items())


def identify_languages(docs: DataFrame, samples: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(sample(docs) if samples is None else samples)  # SAMPLE_CHARS a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(shared.value)
        for b in batches:
            names, scores = own.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
