"""Exact co-occurrence counting (Q-30 co-authors) with bounded join groups.

Input: (member, item) links. Output: member pairs (member1 < member2) sharing at least ``min_shared`` items, with the
number of shared items. A self-join on the item would put all pairs of a hot item into one join key. Here each item's
members, in order, are cut into blocks of ``block`` members that travel as lists, and every pair of blocks is its own join
key. All items take the same path: an item of few members has one block, and no join key holds more than block x block
pairs, however large the item. The work is the number of co-occurring pairs, which is also the number of rows any exact
count of shared items has to look at; they are shuffled as one list per (item, member) of the members after it, not as a
row each, and become rows where they are counted. A task counts all pairs of the members dealt to it, so the member with
most pairs bounds the largest task from below: in time, not in memory, since the count spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.sources.tables import spread


def blocked_links(links: DataFrame, member: str, item: str, block: int, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(left, right): the blocks (sorted lists of distinct members) of the items with two members at least, once for each
    block pair (p, q), p <= q, that they take part in: as block p (``x``) on the left, as block q (``y``) on the right."""
    lk = links.select(F.col(member).alias("m"), F.col(item).alias("i")).dropna()
    items = (spread(lk, "i", tasks=tasks).groupBy("i").agg(F.sort_array(F.collect_set("m")).alias("ms"))
             .filter(F.size("ms") > 1).withColumn("n", F.ceil(F.size("ms") / block).cast("int")))
    blocks = items.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b")).select(
        "i", "n", "b", F.slice("ms", F.col("b") * block + 1, F.lit(block)).alias("members"))
    # both sides read one shuffle of the blocks, so they are made once
    met = spread(blocks, "i", "b", tasks=tasks).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    left = met.filter(F.col("o") >= F.col("b")).select("i", F.col("b").alias("p"), F.col("o").alias("q"), F.col("members").alias("x"))
    right = met.filter(F.col("o") <= F.col("b")).select("i", F.col("o").alias("p"), F.col("b").alias("q"), F.col("members").alias("y"))
    return left, right


def shared_item_pairs(links: DataFrame, member: str, item: str, min_shared: int = 2, block: int = 256,
                      tasks: int | None = None) -> DataFrame:
    """Member pairs (member1 < member2) sharing at least ``min_shared`` items, with the count (see module docstring).
    ``tasks`` is the number of partitions of the items and their blocks (``spread``), half that of the count, which each link
    enters with up to a block of others."""
    left, right = (spread(side, "i", "p", "q", tasks=tasks) for side in blocked_links(links, member, item, block, tasks))
    # blocks are in order: after a member come all of a later block, and of its own block those behind it; no block is empty, and
    # outer keeps the planner from a filter on one side only, for which the blocks would be made twice
    met = left.join(right, ["i", "p", "q"]).select("p", "q", "x", "y", F.posexplode_outer("x").alias("at", "member1")).select(
        "member1", F.when(F.col("p") < F.col("q"), F.col("y")).otherwise(
            F.slice("x", F.col("at") + 2, F.size("x"))).alias("after")).filter(F.size("after") > 0)
    pairs = (spread(met, "member1", tasks=tasks and 2 * tasks).select("member1", F.explode("after").alias("member2"))
             .groupBy("member1", "member2").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared))
    # a sort of the pairs runs what is before it twice, to find its ranges: that is this shuffle, not the count
    return spread(pairs, "member1", "member2", tasks=tasks and 2 * tasks)
