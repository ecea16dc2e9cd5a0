"""Exact co-occurrence pairs against brute force, with items split into many blocks and into one."""

import itertools
import random
from collections import Counter

import pytest

from lendwise.operators.pairs import shared_item_pairs


def _links(seed=3):
    rnd = random.Random(seed)
    links = set()
    for item in range(30):
        size = 12 if item < 4 else rnd.randint(1, 4)                 # four heavy items
        for m in rnd.sample(range(20), size):
            links.add((m, item))
    return sorted(links)


def _brute(links, k):
    members = {}
    for m, i in links:
        members.setdefault(i, set()).add(m)
    c = Counter()
    for ms in members.values():
        for a, b in itertools.combinations(sorted(ms), 2):
            c[(a, b)] += 1
    return {p: n for p, n in c.items() if n >= k}


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("threshold", [3, 100])
def test_pairs_match_brute_force(spark, k, threshold):
    links = _links()
    df = spark.createDataFrame(links, "m long, i long")
    got = {(r["member1"], r["member2"]): r["shared"]
           for r in shared_item_pairs(df, "m", "i", k, block=threshold).collect()}
    assert got == _brute(links, k)


def test_no_join_key_holds_a_whole_item(spark):
    """One item of 5,000 members: its links are dealt over block pairs of bounded size, none holds the item."""
    from pyspark.sql import functions as F

    from lendwise.operators.pairs import blocked_links

    df = spark.range(5000).select(F.col("id").alias("m"), F.lit(1).alias("i"))
    for side in blocked_links(df, "m", "i", 256):
        sizes = side.groupBy("i", "p", "q").count().agg(F.max("count"), F.count(F.lit(1))).first()
        assert sizes[0] < 2 * 256 and sizes[1] == 20 * 21 // 2
