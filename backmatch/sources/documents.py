"""Documents: multimaps of strings, on the driver and as a map column.

A documents DataFrame has ``doc_id`` and ``f``, a map of field to an array of
values.  Typed tables become documents by :func:`to_documents`: a null is an
absent field, an array several values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..query import Clause, Literal

FIELDS = "map<string,array<string>>"


class Document(dict):
    """A multimap of field to list of values; repeated values are kept."""

    @staticmethod
    def of(pairs: Iterable[tuple[str, str]] = ()) -> Document:
        return Document().with_values(pairs)

    def with_value(self, name: str, value: str) -> Document:
        self.setdefault(str(name), []).append(str(value))
        return self

    def with_values(self, pairs: Iterable[tuple[str, str]]) -> Document:
        for k, v in pairs:
            self.with_value(k, v)
        return self

    def merge_with(self, other: Mapping[str, list[str]]) -> Document:
        """The distinct pairs of both."""
        both = dict.fromkeys([*self.field_values(), *Document(other).field_values()])
        return Document.of(both)

    def field_values(self) -> Iterator[tuple[str, str]]:
        return ((k, v) for k, vs in self.items() for v in vs)

    def fv_count(self) -> int:
        return sum(map(len, super().values()))

    def has_field(self, name: str) -> bool:
        return name in self

    def fields(self) -> list[str]:
        return list(self)

    def values_of(self, name: str) -> list[str]:
        return list(self.get(name, ()))

    def is_empty(self) -> bool:
        return not self

    def to_clause(self) -> Clause:
        return Clause(tuple(Literal("term", k, v) for k, v in self.field_values()))


def documents(spark: SparkSession, docs: Iterable[tuple[int, Mapping[str, list[str]]]]) -> DataFrame:
    return spark.createDataFrame([(i, {k: list(v) for k, v in d.items()}) for i, d in docs], f"doc_id bigint, f {FIELDS}")


def to_documents(df: DataFrame, id_col: str | Column, fields: Mapping[str, str | Column]) -> DataFrame:
    """``doc_id`` and ``f`` of a typed table; ``fields`` maps field names to columns."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    kinds = dict(df.select(*(col(c).alias(k) for k, c in fields.items())).dtypes)
    entry = [F.when(col(c).isNotNull(), F.struct(F.lit(k).alias("k"), (F.filter(col(c).cast("array<string>"), lambda x: x.isNotNull()) if kinds[k].startswith("array") else F.array(col(c).cast("string"))).alias("v"))) for k, c in fields.items()]
    return df.select(col(id_col).cast("bigint").alias("doc_id"), F.map_from_entries(F.array_compact(F.array(*entry))).alias("f"))


def from_pairs(pairs: DataFrame) -> DataFrame:
    """Documents of rows (doc_id, field, value), combined before the shuffle by (doc_id, field)."""
    by_field = pairs.where("field is not null and value is not null").groupBy("doc_id", "field").agg(F.sort_array(F.collect_list("value")).alias("v"))
    return by_field.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "v")))).alias("f"))


def field_values(docs: DataFrame) -> DataFrame:
    """doc_id, field, value: a row for each value, repeated ones too."""
    return docs.select("doc_id", F.explode("f").alias("field", "vs")).select("doc_id", "field", F.explode("vs").alias("value"))


def merged(a: Column, b: Column) -> Column:
    """The union of two maps of values, distinct in each field."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda k, x, y: F.array_union(F.coalesce(x, none), F.coalesce(y, none)))


def fv_count(f: Column) -> Column:
    return F.aggregate(F.map_values(f), F.lit(0).cast("bigint"), lambda n, v: n + F.size(v))
