"""The distributed rank equals Spark's window functions, with NULLs, ties and hot groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwise.operators.ranking import rank_within, top_k_ranked


def _data(spark, n=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        part = rnd.choice(["a", "a", "a", "b", "c", None])         # 'a' is a hot group
        score = rnd.choice([None, 1, 2, 2, 3, 5, 8, 8, 8])
        rows.append((i, part, score, rnd.choice(["x", "y"])))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.StringType()),
                           T.StructField("s", T.IntegerType()), T.StructField("t", T.StringType())])
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("partition", [[], ["p"]])
@pytest.mark.parametrize("desc", [True, False])
def test_rank_within_matches_window(spark, partition, desc):
    df = _data(spark)
    order = [("s", desc), ("t", False)]
    got = rank_within(df, partition, order, tie_break=["id"], row_number="rn", rank="rk", dense_rank="dr")
    sort = [F.col("s").desc_nulls_last() if desc else F.col("s").asc_nulls_first(), F.col("t").asc_nulls_first()]
    w = Window.partitionBy(*partition).orderBy(*sort)
    w_rn = Window.partitionBy(*partition).orderBy(*sort, "id")
    want = df.select("*", F.row_number().over(w_rn).alias("rn"), F.rank().over(w).alias("rk"),
                     F.dense_rank().over(w).alias("dr")).select(*got.columns)
    assert got.exceptAll(want).count() == 0
    assert want.exceptAll(got).count() == 0


def test_global_rank_plan_has_no_cartesian_product(spark):
    df = _data(spark)
    got = rank_within(df, [], [("s", True)], rank="rk")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_top_k_ranked(spark):
    df = _data(spark)
    got = top_k_ranked(df, [("s", True)], ["id"], 10, rank="rk").collect()
    full = {r["id"]: r["rk"] for r in df.select("id", F.rank().over(Window.orderBy(F.col("s").desc_nulls_last()))
                                                 .alias("rk")).collect()}
    assert len(got) == 10
    assert all(full[r["id"]] == r["rk"] for r in got)


def test_lag_within_matches_window(spark):
    from lendwise.operators.ranking import lag_within

    df = _data(spark)
    got = lag_within(df, ["p"], [("s", False), ("id", False)], "t", "prev_t")
    w = Window.partitionBy("p").orderBy(F.col("s").asc_nulls_first(), "id")
    want = df.select("*", F.lag("t").over(w).alias("prev_t"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_ranges_are_a_function_of_the_key(spark):
    """Splitters are literals: two evaluations agree, ranges are in key order and about even, nothing is checkpointed."""
    from lendwise.operators import ranking
    from lendwise.plans import physical_plan

    df = _data(spark, 2000).select("p", "s", "t", "id")
    order = [("s", True), ("t", False), ("id", True)]
    cuts = ranking.splitters(df, ["p"], order, 8)
    assert len(cuts) == 7
    with_range = df.withColumn("r", ranking.range_of(df, cuts, ["p"], order))
    rows = with_range.orderBy(F.col("p").asc_nulls_first(), F.col("s").desc_nulls_last(), "t", F.desc("id")).collect()
    got = [r["r"] for r in rows]
    assert got == sorted(got) and set(got) == set(range(8))
    assert max(got.count(k) for k in set(got)) < 3 * 2000 / 8
    again = {tuple(r[:4]): r["r"] for r in with_range.repartition(5).collect()}
    assert again == {tuple(r[:4]): r["r"] for r in rows}
    plan = physical_plan(ranking.prefix_counts(df.withColumn("n", F.lit(1)), ["p"], order, ["n"]))
    assert "Existing" not in plan.replace("Scan ExistingRDD[p", "").replace("Scan ExistingRDD[id", "") and "Checkpoint" not in plan


def test_splitters_of_few_and_no_keys(spark):
    from lendwise.operators import ranking

    empty = _data(spark, 5).filter("id < 0")
    assert ranking.splitters(empty, [], [("s", False)], 8) == []
    assert rank_within(empty, [], [("s", True)], rank="rk").count() == 0
    one = _data(spark, 1)
    assert [r["rk"] for r in rank_within(one, ["p"], [("s", True)], rank="rk").collect()] == [1]


def test_ranks_over_dates_decimals_and_timestamps(spark):
    rows = spark.range(300).selectExpr("id", "CAST(id % 17 AS DECIMAL(8,2)) / 3 AS d", "DATE'2001-01-01' + CAST(id % 5 AS INT) AS day",
                                       "CAST(DATE'2001-01-01' + CAST(id % 7 AS INT) AS TIMESTAMP_NTZ) AS ts")
    order = [("day", True), ("ts", False), ("d", True)]
    got = rank_within(rows, [], order, rank="rk")
    w = Window.orderBy(F.desc("day"), "ts", F.desc("d"))
    want = rows.select("*", F.rank().over(w).alias("rk"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
