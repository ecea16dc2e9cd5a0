"""Range join: the pairs of a plain join with a residual predicate, without its crowded tasks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendwise.operators import ranges as R
from lendwise.plans import physical_plan

DOMAIN = (-3, 60)


def pairs(points, ranges):
    return sorted((p, r) for k, v, p in points for j, lo, hi, r in ranges
                  if k is not None and k == j and v is not None and (lo is None or lo <= v) and (hi is None or v <= hi))


def join(spark, points, ranges, **kw):
    p = spark.createDataFrame(points, "k long, v int, `p.id` int")
    r = spark.createDataFrame(ranges, "k long, lo int, hi int, r int")
    return R.range_join(p, r, ["k"], "v", "lo", "hi", DOMAIN, **kw)


def data(seed, n=300):
    rng = random.Random(seed)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    end = lambda: rng.choice([None, *range(-10, 70, 3)])
    return ([(key(), rng.choice([None, *range(-3, 61)]), i) for i in range(n)],
            [(key(), end(), end(), i) for i in range(n // 3)])


@pytest.mark.parametrize("hot", [R.HOT, 5])
def test_pairs_of_a_plain_join(spark, hot):
    points, ranges = data(1)
    points += points[:20]  # repeated rows
    out = join(spark, points, ranges, hot=hot)
    assert out.columns == ["k", "v", "p.id", "lo", "hi", "r"]
    assert sorted((x["p.id"], x["r"]) for x in out.collect()) == pairs(points, ranges)


def test_empty_and_outside(spark):
    points, ranges = data(2, 30)
    assert join(spark, [], ranges).collect() == [] and join(spark, points, []).collect() == []
    with pytest.raises(Exception, match="outside the domain"):
        join(spark, [(1, 61, 1)], ranges).collect()
    assert R.domain_of(spark.createDataFrame([], "v int"), "v") == (0, 0)


def test_hot_keys_are_dealt_out(spark):
    """A key with all rows: no (key, node, part) of the join keeps more than about twice the bound of points."""
    points = [(1, i % 60, i) for i in range(2000)]
    out = join(spark, points, [(1, 0, None, 1), (1, None, None, 2)], hot=100)
    assert out.count() == sum(v >= 0 for _, v, _ in points) + 2000
    assert "_part" in physical_plan(out) and "CartesianProduct" not in physical_plan(out)
    p = spark.createDataFrame(points, "k long, v int, i int").select("*", F.explode(R.point_nodes(F.col("v"), DOMAIN)).alias("n"))
    assert p.groupBy("n").count().agg(F.max("count")).first()[0] == 2000  # what a task would get without parts


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 63), st.integers(0, 63), st.integers(0, 63))
def test_nodes_cut_a_range_once(lo, hi, v):
    """The rule of the tree in plain integers: disjoint nodes that cover the range and nothing else."""
    nodes = set()
    for k in range(7):
        first, last = -(-lo // 2 ** k), (hi + 1) // 2 ** k
        if first < last:
            nodes |= {(k, n) for odd, n in ((first, first), (last, last - 1)) if odd % 2}
    assert sum((k, v >> k) in nodes for k in range(7)) == (lo <= v <= hi)
