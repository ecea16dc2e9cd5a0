"""Join of equal keys and a value inside a range (J-07), as an equi-join.

A plain join on the key with a residual range predicate compares every point of a key with every range of it, in the one
task that the key hashes to. Here the value's domain is a binary tree: a point belongs to the node above it on each level,
and a range is cut into the largest nodes that it holds entirely, at most two per level, which do not overlap. A point
lies in a range exactly if one of its nodes is one of the range's, and then exactly one is; so an equi-join on (key, node)
gives each pair once and makes no pair that a predicate drops. A (key, node) that holds more than ``hot`` points is dealt
into salted parts, to which its ranges are copied.

Cases: a null key or value joins nothing; a null end of a range is open; a range whose low end lies above its high end
holds nothing; values outside the domain join by the domain's ends only if they are clipped by the caller, and are
rejected with an error otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 1 << 20  # points of one (key, node) that go to one part


def domain_of(df: DataFrame, value: str) -> tuple[int, int]:
    """Smallest and largest value: one aggregate job, one row. (0, 0) without values."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    return (0, 0) if r["lo"] is None else (int(r["lo"]), int(r["hi"]))


def _levels(domain: tuple[int, int]) -> int:
    return max(1, (domain[1] - domain[0]).bit_length()) + 1


def point_nodes(value: Column, domain: tuple[int, int]) -> Column:
    """Array of (level, node): the nodes above a value."""
    at = (value - domain[0]).cast("long")
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("node")) for k in range(_levels(domain))])


def range_nodes(low: Column, high: Column, domain: tuple[int, int]) -> Column:
    """Array of (level, node): the largest nodes that lie entirely in [low, high]."""
    # clipped to the domain; the end is exclusive
    lo = F.greatest(F.coalesce(low, F.lit(domain[0])), F.lit(domain[0])).cast("long") - domain[0]
    end = F.least(F.coalesce(high, F.lit(domain[1])), F.lit(domain[1])).cast("long") - domain[0] + 1
    found = []
    for k in range(_levels(domain)):
        first, last = F.shiftright(lo + ((1 << k) - 1), k), F.shiftright(end, k)  # whole nodes of this level: first .. last - 1
        for odd, node in ((first, first), (last, last - 1)):
            found.append(F.when((first < last) & (odd % 2 == 1), F.struct(F.lit(k).alias("level"), node.alias("node"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def range_join(points: DataFrame, ranges: DataFrame, on: Sequence[str], value: str, low: str | None, high: str | None,
               domain: tuple[int, int], hot: int = HOT) -> DataFrame:
    """Rows of ``points`` with the rows of ``ranges`` that have the same ``on`` and ``low <= value <= high``; a missing
    ``low`` or ``high`` is an open end. Columns: those of points, then those of ranges but ``on``."""
    end = lambda c: F.col(c) if c else F.lit(None).cast("long")
    beyond = (F.col(value) < domain[0]) | (F.col(value) > domain[1])
    p = points.select("*", F.explode(F.when(beyond, F.raise_error(F.lit(f"{value} lies outside the domain {domain}")).cast(
        "array<struct<level:int,node:bigint>>")).otherwise(point_nodes(F.col(value), domain))).alias("_n"))
    p = p.filter(F.col(value).isNotNull()).dropna(subset=list(on)).withColumn("_level", F.col("_n.level")).withColumn(
        "_node", F.col("_n.node")).drop("_n")
    r = ranges.dropna(subset=list(on)).select("*", F.explode(range_nodes(end(low), end(high), domain)).alias("_n"))
    r = r.withColumn("_level", F.col("_n.level")).withColumn("_node", F.col("_n.node")).drop("_n")
    key = [*on, "_level", "_node"]
    crowded = p.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > hot).select(
        *key, F.ceil(F.col("_c") / hot).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns], F.monotonically_increasing_id()), parts).cast("int")
    p = p.join(crowded, key, "left").withColumn("_part", spread).drop("_parts")
    r = r.join(crowded, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    joined = p.join(r, [*key, "_part"])
    kept = [c for c in ranges.columns if c not in on]
    return joined.select(*[p[f"`{c}`"] for c in points.columns], *[r[f"`{c}`"] for c in kept])
