"""Stored summaries: united levels equal a recount, kept views equal recomputation after batches of changes."""

import tempfile

from pyspark.sql import functions as F

from lendwise import standins
from lendwise.operators import summaries as M
from lendwise.operators import views as V


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_levels_are_united_from_the_summary_alone(spark, projected):
    root = tempfile.mkdtemp(prefix="lendwise-distinct-")
    third = F.pmod(F.xxhash64("loan_id"), F.lit(3))
    for k in (0, 1, 2, 1):  # a batch written again replaces itself
        M.add_distinct(projected, projected.loan.filter(third == k), root, k)
    got = M.rollup_distinct(spark, root)
    assert all(root in f for f in got.inputFiles())
    rows = projected.loan.join(projected.patron, "patron_id").join(projected.copy, "copy_id")
    want = rows.rollup("patron_type", F.date_format("loan_ts", "yyyy").alias("loan_year"), F.col("branch_id").cast("string").alias(
        "branch_id")).agg(F.countDistinct("patron_id").alias("distinct_patrons"))
    want = want.select(*[F.coalesce(c, F.lit("ALL")).alias(c) for c in M.LEVELS], "distinct_patrons")
    assert same(got.drop("estimated_patrons"), want)


def test_estimates_of_many_patrons(spark):
    """200,000 distinct ids united from 40 sketches: within the stated bound, from two kilobytes each."""
    rows = spark.range(200_000).select(F.col("id").alias("p"), (F.col("id") % 40).alias("g"))
    parts = rows.groupBy("g").agg(F.hll_sketch_agg("p", F.lit(M.LOG_K)).alias("s"))
    n = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s"))).first()[0]
    assert abs(n - 200_000) <= 200_000 * M.BOUND


def _after(t, table, key, column, value):
    """The table as the batches of signed rows leave it."""
    changed = F.when((F.col(key) % 5 == 0) & (F.col(key) % 4 != 3), value).otherwise(F.col(column))
    return t.replace(**{table: t[table].filter(F.col(key) % 4 != 0).withColumn(column, changed)})


def test_kept_views_equal_recomputation(spark, projected):
    cases = [("fine", "fine_id", "status", F.lit("Unpaid"), M.kept_fines, M.fine_changes, M.v04_from_kept, V.v04_patron_fines_summary),
             ("copy", "copy_id", "branch_id", (F.col("branch_id") + 1) % 25, M.kept_inventory, M.copy_changes, M.v08_from_kept,
              V.v08_copy_inventory_by_branch),
             ("accesssession", "session_id", "patron_id", F.col("patron_id") + 1, M.kept_sessions, M.session_changes, M.v09_from_kept,
              V.v09_eresource_usage_summary)]
    for table, key, column, value, kept, changes, view, recompute in cases:
        root = tempfile.mkdtemp(prefix="lendwise-kept-")
        sums = M.kept_after(kept(root, 2), [changes(b) for b in standins.signed_batches(projected[table], key, column, value)])
        assert all(root in f for f in sums.inputFiles())  # the facts are not read again
        assert same(view(projected, sums), recompute(_after(projected, table, key, column, value)))


def test_versions_and_batches_written_again(spark):
    kept = M.kept_inventory(tempfile.mkdtemp(prefix="lendwise-kept-"), 3)
    rows = lambda *r: spark.createDataFrame(list(r), "branch_id long, isbn string, n long")
    assert kept.after(spark, -1).count() == 0
    want = {}
    for b in range(8):
        change = [(b % 2, "a", 1), (b % 2, "b", 2 if b < 4 else -2), (None, "c", 1)]
        kept.add(rows(*change), b)
        kept.add(rows(*change).repartition(2), b)  # again, as after a failure
        for k, i, n in change:
            want[k, i] = want.get((k, i), 0) + n
        got = {(r["branch_id"], r["isbn"]): r["n"] for r in kept.after(spark, b).collect()}
        assert got == {k: n for k, n in want.items() if n}
    assert all("snapshot=5" in f or "changes=6" in f or "changes=7" in f for f in kept.after(spark, 7).inputFiles())
