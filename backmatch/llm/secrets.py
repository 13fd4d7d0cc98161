"""Operator 1, secret scan with multipart credential linking, in SQL functions only.

Strong spans (assignments, access keys, long hex strings) are always
reported.  Weak parts - identifiers, accounts, opaque strings, credentials in
addresses, endpoints, hosts - are reported only when a complementary part lies
in the same scope, ``SCOPE`` characters around them: an identifier, account,
endpoint or host needs a secret, an opaque string an identifier or an
endpoint, a credential in an address its endpoint.  The parts are joined by
row and bins of the scope's width, with the exact distance as the residual
condition, so a very long document is spread over its bins.

Defined results: a null text is empty and has no spans; very long texts are
scanned whole; parts at equal distances all count; repeated rows are each
scanned and reported; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, checkpointed, table, text_hash, unused
from .spans import EMAIL, IP, Kind, counted, is_ip, joined, part_rows

SCOPE = 200
MASK = "[SECRET]"

_assigns = lambda t: t.contains("=") | t.contains(":")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"

KINDS = [
    Kind("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8, _assigns),
    Kind("access", r"AKIA[A-Z0-9]++", lambda m: F.length(m) >= 16, lambda t: t.contains("AKIA")),
    Kind("hex", r"[0-9a-f]{32,}"),
    Kind("ident", r"""(?i:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", guard=_assigns),
    Kind("opaque", OPAQUE, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")),
    Kind("endpoint", r"""(?i:https?|ftp|sftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", guard=lambda t: t.contains("://")),
    Kind("userinfo", r"""://[^\x00-\x20"'<>/@:]+:[^\x00-\x20"'<>/@]{3,}@""", guard=lambda t: t.contains("://") & t.contains("@")),
    Kind("account", EMAIL, guard=lambda t: t.contains("@")),
    Kind("host", IP, is_ip, lambda t: t.rlike(r"[0-9]\.[0-9]")),
]
NAMES = [k.name for k in KINDS]
STRONG = 3
#: What each part is, and what each weak kind needs nearby.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "opaque": "secret", "endpoint": "endpoint", "userinfo": "secret", "account": "identifier", "host": "endpoint"}
NEEDS = {"ident": ("secret",), "opaque": ("identifier", "endpoint"), "endpoint": ("secret",), "userinfo": ("endpoint",), "account": ("secret",), "host": ("secret",)}
#: The one kind that lies inside its complement; other parts must not overlap.
INSIDE = "userinfo"
#: What ``redact`` masks; the other parts are reported only.
MASKED = ("assign", "access", "hex", "opaque", "userinfo")


def _bins(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / SCOPE), F.floor(last / SCOPE)))


def linked_parts(parts: DataFrame) -> DataFrame:
    """The weak rows of ``parts`` that have a complementary part in their scope."""
    kind = F.col("kind")
    role = F.element_at(F.array(*(F.lit(ROLES[n]) for n in NAMES)), kind + 1)
    needs = F.element_at(F.array(*(F.array(*map(F.lit, NEEDS.get(n, ("",)))) for n in NAMES)), kind + 1)
    weak = parts.where(kind >= STRONG).select("row", "kind", "start", "end", F.explode(needs).alias("role")).select("*", _bins(F.col("start") - SCOPE, F.col("end") + SCOPE).alias("bin")).alias("w")
    other = parts.where(kind.isNotNull()).select("row", role.alias("role"), "kind", "start", "end", _bins(F.col("start"), F.col("end")).alias("bin")).alias("o")
    gap = F.greatest(F.col("o.start") - F.col("w.end"), F.col("w.start") - F.col("o.end"))
    inside = (F.col("w.kind") == NAMES.index(INSIDE)) | (F.col("o.kind") == NAMES.index(INSIDE))
    same = [F.col(f"w.{c}") == F.col(f"o.{c}") for c in ("row", "role", "bin")]
    return weak.join(other, [*same, gap <= SCOPE, (gap >= 0) | inside], "left_semi").select("row", "kind", "start", "end").distinct()


def secret_parts(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, kind, start, end: all reported spans, and a row with null kind for
    each document at least."""
    parts = checkpointed(part_rows(docs, KINDS).drop("match", "before"))
    strong = parts.withColumn("kind", F.when(F.col("kind") < STRONG, F.col("kind")))
    rows = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"))
    return strong.unionByName(linked_parts(parts).join(rows, "row").select(*strong.columns))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans (array of start, kind, end in that order) for each row of ``docs``."""
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    return secret_parts(docs).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.sort_array(F.collect_list(span)).alias("spans")).drop("row")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported secret (``MASKED`` kinds) replaced by ``MASK``; n_chars, if there, is counted anew.

    Spans are matched to texts by doc_id (nulls are equal) and the text's hash, so rows that share an id keep their own.
    Overlapping spans become one.  Null texts and texts without a secret stay as they are; columns of any name are kept.
    """
    masked = [NAMES.index(n) for n in MASKED]
    found = secret_parts(docs).where(F.col("kind").isin(masked)).select("doc_id", "text_hash", "start", "end").distinct()
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    found = found.withColumn("reach", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("block", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(before))
    blocks = found.groupBy("doc_id", "text_hash", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    id_, hash_, marks_, masked_ = unused(docs, "id", "hash", "marks", "masked")
    marks = blocks.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(marks_))
    marks = bounded(checkpointed(marks), 48 * F.size(marks_))
    got = docs.join(marks, docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (text_hash() == F.col(hash_)), "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(marks_, lambda m: m["end"]))
    ends = F.concat(F.transform(marks_, lambda m: m["start"]), F.array(F.length("text").cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.col("text").substr((a + 1).cast("int"), (b - a).cast("int")))
    # a column of its own first: inside a lambda, the name of a column of the same select would be that one
    got = got.withColumn(masked_, F.when(F.col(marks_).isNull(), F.col("text")).otherwise(F.array_join(kept, MASK)))
    of = {"text": F.col(masked_), "n_chars": F.coalesce(F.length(masked_).cast("long"), F.col("n_chars"))}
    return got.select(*(of[c].alias(c) if c in of else F.col(f"`{c}`") for c in docs.columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < STRONG)
    counts = [counted(F.col("spans"), i).alias(f"n_{NAMES[i]}") for i in range(STRONG)]
    return got.select("doc_id", *counts, F.sha2(joined(base, NAMES), 256).alias("base_sha256"), joined(F.col("spans"), NAMES).alias("spans"))
