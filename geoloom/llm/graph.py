"""Connected components by alternating large-star and small-star rounds, each written down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import Work


def least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; a hub's edges are summed up before they move."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the least node of its component.

    Self-loops and repeated edges are allowed; a node only in self-loops is absent; no edges give no rows."""
    work = Work(edges.sparkSession, "graph")
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, number, mark = work.saved(ordered, "round-0"), 0, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(least_neighbour(both), "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        small = large.join(least_neighbour(large), "u")
        hung = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = work.saved(hung, f"round-{number + 1}")
        work.drop(f"round-{number}")
        number += 1
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
