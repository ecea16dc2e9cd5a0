"""Column helpers F-01 ... F-18 and the SQL view catalog."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from fixtures import AS_OF, fixture_tables
from lendwise import functions as L
from lendwise.operators.views import register_views


def test_ordered_distinct_concat(spark):
    df = spark.createDataFrame([(1, "b", "Zed"), (1, "a", "Zed"), (1, "a", "Zed"), (1, None, "Amy"), (2, None, None)],
                               "g int, first string, last string")
    name = F.concat(F.col("first"), F.lit(" "), F.col("last"))
    got = {r["g"]: r["v"] for r in df.groupBy("g").agg(
        L.ordered_distinct_concat(name, order_by=["last", "first"]).alias("v")).collect()}
    assert got == {1: "a Zed, b Zed", 2: None}          # NULL names skipped, empty group -> NULL
    plain = {r["g"]: r["v"] for r in df.groupBy("g").agg(L.ordered_distinct_concat("last").alias("v")).collect()}
    assert plain == {1: "Amy, Zed", 2: None}


def test_display_date(spark):
    df = spark.createDataFrame([("2024-03-05 10:11:12",), ("2024-03-05",), ("05/03/2024",), (None,)], "s string")
    got = [r["d"] for r in df.select(L.display_date("s").alias("d")).collect()]
    assert got == ["2024-03-05", "2024-03-05", "05/03/2024", "N/A"]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4),), (None,)], "t timestamp")
    assert [r["d"] for r in ts.select(L.display_datetime("t").alias("d")).collect()] == ["2024-01-02", "N/A"]


def test_money_and_split(spark):
    df = spark.createDataFrame([(Decimal("12.3"),), (None,), (Decimal("1234.5"),)], "m decimal(8,2)")
    assert [r["x"] for r in df.select(L.money("m").alias("x")).collect()] == ["12.30", "0.00", "1234.50"]
    parts = spark.createDataFrame([("Art, Bio",)], "s string").select(F.explode(L.split_list("s")).alias("p"))
    assert [r["p"] for r in parts.collect()] == ["Art", "Bio"]


def test_exact_average_and_percent(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "g int, x int")
    row = df.groupBy("g").agg(L.exact_avg("x").alias("a"), L.pct(F.lit(1), F.lit(3)).alias("p")).first()
    assert row["a"] == Decimal("2.6667") and row["p"] == Decimal("33.33")
    assert spark.range(1).select(L.pct(F.lit(1), F.lit(0)).alias("p")).first()["p"] is None


def test_month_helpers(spark):
    df = spark.createDataFrame([("2001-03",), ("2001-01",), ("bad",)], "m string")
    got = [r["p"] for r in df.select(L.previous_month_key("m").alias("p")).collect()]
    assert got == ["2001-02", "2000-12", None]


def test_views_are_queryable_with_sql(spark):
    t = fixture_tables(spark)
    register_views(t, AS_OF)
    rows = spark.sql("SELECT patron_id, loan_status FROM vw_patron_loans_with_status WHERE loan_status = 'Overdue' "
                     "ORDER BY patron_id").collect()
    assert [(r["patron_id"], r["loan_status"]) for r in rows] == [(1, "Overdue"), (5, "Overdue")]
    t.register_views()
    assert spark.sql("SELECT COUNT(*) AS n FROM loan").first()["n"] == 6


def test_average_from_sums_equals_direct_average(spark):
    import random

    rnd = random.Random(11)
    rows = [(rnd.randint(0, 40), rnd.randint(0, 5), rnd.randint(-3, 400)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g int, sub int, x int")
    direct = df.groupBy("g").agg(L.exact_avg("x").alias("a"))
    pre = df.groupBy("g", "sub").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    recombined = pre.groupBy("g").agg(L.exact_avg_from_sums(F.sum("s"), F.sum("n")).alias("a"))
    assert direct.exceptAll(recombined).count() == 0 and recombined.exceptAll(direct).count() == 0
