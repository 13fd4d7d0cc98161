"""Percolation of a stream of documents.

Documents are independent, so a stream needs no state: the joins of
:func:`operators.percolate.percolate` are with static tables.  With
``each_batch`` the corpus is read anew for every batch, so queries can be
added and removed while the stream runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.percolate import percolate
from ..plans.config import EngineConfig
from ..query import Query


def percolate_stream(docs: DataFrame, queries: Iterable[tuple[int, Query]], strategy: str = "anchor", config: EngineConfig | None = None, seen: Mapping[tuple[str, str], float] | None = None) -> DataFrame:
    """doc_id, qid as an append-mode stream; ``seen`` as for a batch, from documents of before."""
    if not docs.isStreaming:
        raise ValueError("not a stream")
    return percolate(docs, queries, strategy, config, seen)


def each_batch(docs: DataFrame, corpus: Callable[[], Iterable[tuple[int, Query]]], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that percolates each batch with the queries of that moment."""
    return docs.writeStream.foreachBatch(lambda batch, i: sink(percolate(batch, list(corpus())), i))
