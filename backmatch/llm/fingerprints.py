"""Operator 8, canonical exact document fingerprints.

A text is normalised (NFKC), case-folded and its white space folded to single
spaces; its fingerprint is the 128-bit XXH3 of that canonical form.  Equal
fingerprints form a bucket, and canonical forms are compared byte by byte
inside each bucket, so a collision never joins different texts.

The likeness of two fingerprints is that of an exact digest: 1.0 if they are
equal and the canonical bytes too, else 0.0.

Each document also needs its successor in doc_id order.  One shuffle brings
texts into ranges of (doc_id, hash of the text), as many as the bytes ask for
and each a partition of its own, so an id that many rows share is split as
well; the first row of each range is sent to the range before it too, and
each task then streams its sorted rows, holding one row at a time.

Defined results: null text is empty; very long texts are taken whole; rows
that share a doc_id are ordered by the hash of their texts, then the texts,
and each has a successor; null ids come before all others and the last
document's successor is the smallest id that isn't null; a lone document is
its own successor; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, bounded, checkpointed, lean, table, text_hash

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def canonical(text: str) -> str:
    """NFKC, case folding, NFKC of what folding made, white space to single spaces."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(text: str) -> tuple[str, str]:
    """The fingerprint and the canonical form."""
    c = canonical(text)
    return xxhash.xxh3_128_hexdigest(c.encode()), c


def likeness(a: tuple[str, str], b: tuple[str, str]) -> float:
    return 1.0 if a[0] == b[0] and a[1] == b[1] else 0.0


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Characters of texts in a range, and the most ranges.
RANGE_CHARS, RANGES = 32 << 20, 10_000


def _below(key: Column, bounds: list[int], also_equal: bool) -> Column:
    """How many bounds are below the key, or at it as well, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    count = lambda a: F.size(F.filter(a, lambda b: (b <= key) if also_equal else (b < key)))
    coarse = count(F.array(*(F.lit(g[0]) for g in groups)))
    fine = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + count(fine))


def _range_of(key: Column, hash_: Column, bounds: list[int]) -> Column:
    """The range of a row.  An id that is several bounds is split evenly by the hash."""
    less, upto = _below(key, bounds, False), _below(key, bounds, True)
    share = (hash_.cast("double") + 2.0**63) / 2.0**64
    return (less + F.least(upto - less, F.floor(share * (upto - less + 1)))).cast("int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, copies from the next range last; emits each own row with its successor."""
    here = None  # range, id, text, digest of the row that waits for its successor

    def row(x, following: str, following_digest):
        e = edited(x[2], following)
        ed = digest(e)
        return (x[1], len(x[2]), hashlib.sha256(e.encode()).hexdigest(), x[3][0], ed[0], likeness(x[3], ed), likeness(x[3], following_digest))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    for b in batches:
        rows = []
        for part, copy, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = text or ""
            d = None
            if here and here[0] != part:  # only if the range has no successor at all
                rows.append(row(here, here[2], here[3]))
                here = None
            if here:
                d = digest(text)
                rows.append(row(here, text, d))
                here = None
            if not copy:
                here = (part, doc_id, text, d or digest(text))
        if rows:
            yield batch(rows)
    if here:
        yield batch([row(here, here[2], here[3])])


def fingerprints(docs: DataFrame, range_chars: int | None = None) -> DataFrame:
    """A row of ``SCHEMA`` for each document."""
    spark = docs.sparkSession
    arrow_batches(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))  # ids that are null come first
    ids = checkpointed(docs.select(key.alias("key"), text_hash().alias("hash"), F.length("text").alias("size")))  # one look at the texts
    rows, size = ids.agg(F.count("*"), F.sum("size")).first()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    n = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // (range_chars or RANGE_CHARS))))
    found = ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 8 * n)).first()[0] if n > 1 else []
    part = _range_of(F.col("key"), F.col("hash"), list(found))
    order = F.struct("key", "hash")
    real = F.when(F.col("key") > -(2**63), order)
    starts = ids.groupBy(part.alias("part")).agg(F.min(order).alias("first"), F.min(real).alias("real")).orderBy("part").collect()  # a row for each range
    wrap = min((r["real"] for r in starts if r["real"]), default=starts[0]["first"])  # the last document's successor
    # where a range's first row also goes: to the one before; and the wrapping row to the last range
    parts, slots = [r["part"] for r in starts], range(starts[-1]["part"] + 1)
    of = {r["part"]: r["first"] for r in starts}
    before = dict(zip(parts[1:], parts, strict=False))
    look = lambda get, kind: F.element_at(F.array(*(F.lit(get(i)).cast(kind) for i in slots)), F.col("part") + 1)
    is_first = (F.col("key") == look(lambda i: of[i]["key"] if i in of else None, "long")) & (F.col("hash") == look(lambda i: of[i]["hash"] if i in of else None, "long"))
    to = lambda p, copy: F.struct(p.cast("int").alias("part"), F.lit(copy).alias("copy"))
    back = F.when(is_first, to(look(before.get, "int"), True))
    round_ = F.when((F.col("key") == wrap["key"]) & (F.col("hash") == wrap["hash"]), to(F.lit(parts[-1]), True))
    sent = F.filter(F.array(to(F.col("part"), False), back, round_), lambda x: x["part"].isNotNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"), text_hash().alias("hash")).withColumn("part", part)
    rows = rows.select(F.explode(sent).alias("to"), "doc_id", "key", "hash", "text").select("to.part", "to.copy", "doc_id", "key", "hash", "text")
    # in the last range the wrapping row comes after the one of a next range, which it has none of
    return rows.repartitionById(slots[-1] + 1, F.col("part")).sortWithinPartitions("copy", "key", "hash", "text").select("part", "copy", "doc_id", "text").mapInArrow(lean(_stream), SCHEMA)


def canonical_texts(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, canonical for each document."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [digest(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], ["doc_id", "fingerprint", "canonical"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, fingerprint string, canonical string")


def exact_classes(docs: DataFrame, found: DataFrame, single: bool = True) -> DataFrame:
    """fingerprint, class_id (smallest doc_id), and canonical where a bucket holds several texts.

    ``found`` has doc_id and fingerprint of ``docs``.  Buckets of one row need
    no comparison.  In the others rows are grouped by the canonical bytes,
    combined before the shuffle, so a group of copies is one row for each task.
    A bucket with more than one canonical form keeps one row for each.  Without
    ``single``, buckets of one row are left out.
    """
    buckets = checkpointed(found.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id")))
    several = found.join(bounded(buckets.where("n > 1").select("fingerprint"), 64), "fingerprint", "left_semi").select("doc_id").distinct()
    members = docs.select("doc_id", "text").join(bounded(checkpointed(several)), "doc_id", "left_semi")
    forms = canonical_texts(members).groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("class_id"))
    clashes = checkpointed(forms.groupBy("fingerprint").agg(F.count("*").alias("forms"), F.collect_list(F.struct("canonical", "class_id")).alias("each")).where("forms > 1"))
    plain = (buckets if single else buckets.where("n > 1")).join(bounded(clashes.select("fingerprint"), 64), "fingerprint", "left_anti").select("fingerprint", "class_id", F.lit(None).cast("string").alias("canonical"))
    return plain.unionByName(clashes.select("fingerprint", F.explode("each").alias("x")).select("fingerprint", "x.class_id", "x.canonical"))


def with_classes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with class_id, the smallest doc_id with the same canonical bytes."""
    classes = checkpointed(exact_classes(docs, found.select("doc_id", "fingerprint"), single=False))
    one = classes.where("canonical is null").select("fingerprint", "class_id")
    got = found.join(bounded(one, 64), "fingerprint", "left")  # a document alone in its bucket is its own class
    several = classes.where("canonical is not null")
    if several.isEmpty():
        return got.select(*found.columns, F.coalesce("class_id", "doc_id").alias("class_id"))
    ids = found.join(bounded(several.select("fingerprint").distinct(), 64), "fingerprint", "left_semi").select("doc_id").distinct()
    forms = canonical_texts(docs.join(bounded(checkpointed(ids)), "doc_id", "left_semi"))
    own = forms.join(several.withColumnRenamed("class_id", "own_class"), ["fingerprint", "canonical"]).select("doc_id", "fingerprint", "own_class").distinct()
    return got.join(own, ["doc_id", "fingerprint"], "left").select(*found.columns, F.coalesce("class_id", "own_class", "doc_id").alias("class_id"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_classes(docs, checkpointed(fingerprints(docs)))
