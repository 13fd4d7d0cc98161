"""Buckets of any size: joins with a table of one row for each key, and buckets dealt in blocks.

A key, or a group of near copies, may hold a third of all rows.  ``join_unique``
broadcasts the few rows of such keys and shuffles the rest.  ``dealt`` hands a
bucket to one task only while its bytes stay below a bound.  In a larger one,
rows that are near the bucket's first row are linked to it where they are; only
those that aren't, the strangers, still have to meet all others, which they do
in pairs of blocks of bounded size.  So no link is lost, a dense group costs
about its size, and no task holds more than the bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_BYTES, bounded, checkpointed

#: Rows of one key beyond which its row on the unique side is broadcast; bytes of a bucket that is one task.
HUB_ROWS, BUCKET_BYTES = 1_000_000, 64 << 20


def join_unique(rows: DataFrame, unique: DataFrame, key: str, n: str = "n", how: str = "inner", hub: int | None = None) -> DataFrame:
    """``rows`` joined with ``unique``, which has one row for each key and the number ``n`` of ``rows`` with it.

    Keys of more than ``HUB_ROWS`` rows are at most the number of rows over that, so they are broadcast
    and no task gets all rows of one.  ``unique`` should be cheap to read (checkpointed).
    """
    hub = HUB_ROWS if hub is None else hub
    hubs = unique.where(F.col(n) > hub)
    rest = unique.where(F.col(n) <= hub).drop(n)
    if hubs.isEmpty():
        return rows.join(rest, key, how)
    hot = rows.join(F.broadcast(hubs.drop(n)), key)
    cold = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(rest, key, how)
    return cold.unionByName(hot)


def dealt(rows: DataFrame, size: Column, payload: str, near: Callable[[DataFrame], DataFrame], limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (key, node, ``payload``) with part, and links (u, v) of the rows that were linked where they are.

    Rows of one (key, part) are to be compared by one task.  ``size`` gives a row's bytes.  ``near`` gets rows
    with the column centre, the payload of the bucket's first node, and adds hit: whether the row is linked to it.
    """
    limit = BUCKET_BYTES if limit is None else limit
    rows = rows.withColumn("bytes", size)
    big = checkpointed(rows.groupBy("key").agg(F.sum("bytes").alias("held")).where(F.col("held") > limit))
    columns = ["key", "node", payload]
    if big.isEmpty():
        return rows.select(*columns, F.lit(0).cast("long").alias("part")), None
    keys = F.broadcast(big)  # at most the bytes of all rows over the limit
    cold = rows.join(keys.select("key"), "key", "left_anti").select(*columns, F.lit(0).cast("long").alias("part"))
    hot = rows.join(keys, "key")
    first = checkpointed(hot.groupBy("key").agg(F.min("node").alias("centre_node"), F.min_by(payload, "node").alias("centre")))
    hot = checkpointed(near(hot.join(bounded(first, F.length("centre") + ROW_BYTES), "key")).select(*columns, "bytes", "held", "centre_node", F.coalesce("hit", F.lit(False)).alias("hit")))
    links = hot.where("hit and node <> centre_node").select(F.col("node").alias("u"), F.col("centre_node").alias("v"))
    strangers = hot.where("not hit").groupBy("key").agg(F.sum("bytes").alias("strange"))
    count = lambda c: F.ceil(F.col(c) * 2 / limit).cast("int")
    blocks = hot.join(F.broadcast(checkpointed(strangers)), "key").withColumn("g", count("held")).withColumn("h", count("strange"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    every = blocks.withColumn("i", upto("h")).withColumn("j", F.pmod(F.xxhash64("node"), "g"))
    strange = blocks.where("not hit").withColumn("j", upto("g")).withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), "h"))
    part = (F.shiftleft(F.col("i").cast("long"), 20) + F.col("j") + 1).alias("part")
    return cold.unionByName(every.select(*columns, part)).unionByName(strange.select(*columns, part)), links
