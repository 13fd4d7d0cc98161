"""Operator 10, regularised quadratic discriminant for document quality.

Statistics of the whole text are put on logarithmic scales.  Each class gets
its mean and a covariance shrunk towards the pooled one and towards a
multiple of the identity; the score is the logistic function of the
difference of the two Gaussian log densities (Mahalanobis terms through
inverse Cholesky factors that are computed once) plus the log prior.

All labelled training rows take part: they are reduced to counts, sums and
products for each class by one aggregation, so the driver gets two rows
whatever the size of the input.

The difference is divided by the number of features before the logistic
function: the features are far from independent, so the plain posterior is 0
or 1 in most cases; order and decision are the same.

Defined results: a null text is scored as an empty one; very long texts are
read whole; null labels and labels without a document are ignored; each row
of a repeated document or label counts; a score of exactly one half is good;
with one class only, the score is 1 or 0 for that class, with none 0.5; an
empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, bounded, checkpointed, fold, lean, table

FOLDS, HELD_OUT = 3, 1
#: Weight of the pooled covariance, and of the identity within it.
TO_POOLED, TO_IDENTITY = 0.2, 0.05

FEATURES = ("log_bytes", "upper", "digit", "comma_stop", "bang", "symbol", "space", "newline", "word_length", "distinct", "repeated", "top_word", "inner_mark")

_KINDS = np.zeros((256, 7), np.float64)
for _i, _chars in enumerate((range(65, 91), range(48, 58), map(ord, ".,"), map(ord, "!?"), [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,!?'-"], map(ord, " \t"), map(ord, "\n\r"))):
    _KINDS[list(_chars), _i] = 1


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of a whole text, in the order of ``FEATURES``."""
    b = text.encode()
    n = len(b)
    upper, digit, stop, bang, symbol, space, line = np.bincount(np.frombuffer(b, np.uint8), minlength=256) @ _KINDS
    words = b.split()
    k = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(map(eq, words, words[1:]))
    top = max(counts.values(), default=0)
    ratio = lambda x, of, least: np.log((x + least) / (of + 1.0))
    inner = b.count(b",") - b.count(b", ") - b.count(b",\n")
    return np.array([np.log(n + 1.0), ratio(upper, n, 0.5), ratio(digit, n, 0.5), ratio(stop, n, 0.5), ratio(bang, n, 0.2), ratio(symbol, n, 0.2), ratio(space, n, 0.5), ratio(line, n, 0.5), np.log((n - space - line + 1.0) / (k + 1.0)), np.log(len(counts) + 1.0) / np.log(k + 2.0), ratio(again, k, 0.2), ratio(top, k, 0.5), ratio(max(inner, 0), k, 0.2)])


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log weights of the classes 0 and 1 (None: no such rows)."""

    means: tuple
    factors: tuple
    weights: tuple

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row of ``x``; the log-density difference is scaled by the number of features."""
        have = [m is not None for m in self.means]
        if not all(have):
            return np.full(len(x), 0.5 if not any(have) else float(have[1]))
        d = [w - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, w in zip(self.means, self.factors, self.weights, strict=True)]
        return 1 / (1 + np.exp(-np.clip((d[1] - d[0]) / x.shape[1], -40, 40)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics as array x."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([statistics(t or "").tolist() for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, x array<double>")


def fit(found: DataFrame, labels: DataFrame) -> Model:
    """``found`` as ``features`` returns it; ``labels`` has doc_id and quality.  Rows whose fold is held out are left out."""
    n = len(FEATURES)
    use = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", F.col("quality").alias("y"))
    rows = found.join(use, "doc_id").select("y", *(F.col("x")[i].alias(f"x{i}") for i in range(n)))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(n)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(n) for j in range(i + 1)]
    got = {r["y"]: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}  # two rows at most
    means, spreads = {}, {}
    for y, r in got.items():
        means[y] = np.array([r[f"s{i}"] for i in range(n)]) / r["n"]
        p = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)])
        spreads[y] = p / r["n"] - np.outer(means[y], means[y])
    total = sum(r["n"] for r in got.values())
    factors, weights = [None, None], [None, None]
    if got:
        pooled = sum(spreads[y] * got[y]["n"] for y in got) / total
        pooled = (1 - TO_IDENTITY) * pooled + TO_IDENTITY * (np.trace(pooled) / n + 1e-6) * np.eye(n)
        for y, r in got.items():
            a = max(TO_POOLED, n / (n + r["n"]))
            c = np.linalg.cholesky((1 - a) * spreads[y] + a * pooled)
            factors[y] = np.linalg.inv(c)
            weights[y] = np.log(r["n"] / total) - np.log(np.diag(c)).sum()
    return Model((means.get(0), means.get(1)), tuple(factors), tuple(weights))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    found = checkpointed(features(docs))
    model = fit(found, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "x").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with all their columns, fitted on labelled rows of ``docs``.

    Only documents with a label are read for fitting; all are then scored in one pass without a shuffle of texts.
    Null and empty texts are scored like others; repeated rows and rows without an id are each kept or not by their
    own text; columns of any name are kept; without labels all documents stay.
    """
    arrow_batches(docs.sparkSession)
    known = checkpointed(labels.where(F.col("quality").isin(0, 1)).select("doc_id").distinct())
    model = fit(features(docs.select("doc_id", "text").join(bounded(known), "doc_id", "left_semi")), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([statistics(t or "") for t in b.column(at).to_pylist()])
                yield b.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(lean(run), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
