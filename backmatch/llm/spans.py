"""Spans of regular expressions in whole texts with SQL functions only.

``regexp_extract_all`` gives the matches and ``split`` the text between them;
positions are running sums of their lengths.  Only documents with a match
that counts are taken apart, and the text itself is never shuffled: what is
dealt by row are lengths and matches, one row for a document without any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: An e-mail address; where a match fails, the rest of its local part isn't tried again.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Four numbers of at most 255 with points between them.
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def is_ip(m: Column) -> Column:
    return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")


@dataclass(frozen=True)
class Kind:
    """A kind of span: matches of ``pattern`` (leftmost, non-overlapping) for which ``passes`` holds.

    ``guard`` is a cheap condition that every text with a match meets.
    """

    name: str
    pattern: str
    passes: Callable[[Column], Column] = lambda m: F.lit(True)
    guard: Callable[[Column], Column] = lambda t: F.lit(True)


def _taken_apart(i: int, kind: Kind, context: int) -> Column:
    """The gaps and matches of a kind in turn, the last gap without a match; nothing if no match counts."""
    found = F.col(f"m{i}")
    part = F.zip_with(F.split("text", kind.pattern, -1), found, lambda p, m: F.struct(F.lit(i).alias("kind"), F.length(p).alias("gap"), F.length(m).alias("size"), (F.lower(F.right(p, F.lit(context))) if context else F.lit("")).alias("before"), m.alias("match")))
    return F.when(F.exists(found, kind.passes), part).otherwise(F.array().cast("array<struct<kind:int,gap:int,size:int,before:string,match:string>>"))


def part_rows(docs: DataFrame, kinds: list[Kind], context: int = 0) -> DataFrame:
    """row, doc_id, text_hash, kind (index), start, end, match, before: a row for each span, and one
    with null kind for each document without any.

    ``row`` numbers the rows of ``docs``; start and end are code points; ``before`` is the lower-cased
    end of the text between the previous match of the kind and this one.
    """
    none = F.array().cast("array<string>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select("row", "doc_id", "text", *(F.when(k.guard(text), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, k in enumerate(kinds)))
    parts = [_taken_apart(i, k, context) for i, k in enumerate(kinds)]
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), F.concat(*parts).alias("parts"))
    rows = rows.select("row", "doc_id", "text_hash", F.posexplode_outer("parts").alias("at", "p")).select("row", "doc_id", "text_hash", "at", "p.*")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    passes = F.coalesce(*(F.when(F.col("kind") == i, k.passes(F.col("match"))) for i, k in enumerate(kinds)))
    return rows.where(F.col("kind").isNull() | (F.col("match").isNotNull() & passes)).select("row", "doc_id", "text_hash", "kind", "start", "end", "match", "before")


def joined(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of an array of structs with kind, start, end, joined by commas."""
    named = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
