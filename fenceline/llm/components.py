"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..session import lookup_join, written


def _stars(edges: DataFrame, large: bool, small: bool) -> DataFrame:
    """One pass of star contraction over pairs (a > b): the larger (or smaller) neighbours of each node, and
    the node itself, are linked to the smallest of them. The minimum of a node is an aggregate and is
    looked up, so a node with very many neighbours is no single task's work. ``small``: it may be broadcast."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("_m", "a"))
    joined = lookup_join(near, least if small else written(least, "least"), "a", small=small)
    if large:
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return linked.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of all nodes in ``links`` (a, b: longs).

    Large and small stars alternate until the links do not change; a component of n nodes takes
    about log n rounds. Each round is a table in the shared folder. Links of a node to itself and
    repeated ones are ignored; nodes without another node do not appear.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        # Neither pass has more than two nodes a link, of two longs each.
        small = 2 * state[0] <= min(session.BROADCAST_MAX_ROWS, session.BROADCAST_MAX_BYTES // 32)
        wide = _stars(edges, large=True, small=small)
        edges = written(_stars(wide if small else written(wide, "links"), large=False, small=small), "links")
