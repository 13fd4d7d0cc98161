"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so nothing about the graph
reaches the driver but a count and a checksum; each round is checkpointed.
The smallest neighbour of a hub is broadcast to its edges, so they needn't meet.

Defined results: edges with a null end are ignored; repeated edges and edges
from a node to itself change nothing; without edges the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import HUB_ROWS, join_unique
from .common import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1] or 0


def _star(edges: DataFrame, n: int, large: bool, hub: int) -> DataFrame:
    """Join the neighbours of each node to the smallest of them: the larger neighbours in a
    large star, the smaller ones and the node itself in a small star.  ``edges`` has ``n`` rows at most."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if n * 2 <= hub:  # no node can be a hub
        got = near.join(least.drop("n"), "u")
    else:
        least = checkpointed(least)
        got = join_unique(near, least, "u", hub=hub)
    if large:
        moved = got.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = got.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, hub: int | None = None) -> DataFrame:
    """node, component (smallest node that can be reached) for each node on an edge that isn't
    the smallest itself.  ``edges`` has long columns u, v."""
    hub = HUB_ROWS if hub is None else hub
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        once = _star(now, state[0], True, hub)
        once = once if state[0] * 2 <= hub else checkpointed(once)
        now = checkpointed(_star(once, state[0], False, hub))  # a star has no more edges than before
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
