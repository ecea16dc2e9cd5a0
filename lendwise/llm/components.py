"""Connected components by repeated contraction, for graphs whose node ids are hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b); label: a node id common to exactly the nodes of one component.

    Each round gives every node the smallest id among itself and its neighbours, then replaces nodes by these ids and
    drops loops. Ids are hashes, so each round merges a fixed share of the remaining nodes on average: the number of
    rounds grows with the logarithm of the largest component. A hub's neighbours are reduced to a minimum map-side and
    joined with AQE's skew splitting; rounds are written to the shared folder."""
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("label")), "labels")
        maps.append(step)
        to = lambda side: step.select(F.col("node").alias(side), F.col("label").alias(f"{side}2"))  # noqa: E731, B023
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = materialize(moved.filter("a <> b").distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = maps[0]
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("label"), F.col("label").alias("__next"))
        out = out.join(nxt, "label", "left").select("node", F.coalesce("__next", "label").alias("label"))
    return out
