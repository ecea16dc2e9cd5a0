"""Summaries that are stored once and added to: distinct counts that can be united (G-03, G-10) and kept views (S-25).

Distinct patrons per (patron type, year, branch) are stored in two mergeable forms: a bitmap of the patron ids, in buckets
of 32,768 ids, which is exact, and an HLL sketch, which is small whatever the number of patrons. A level of a rollup is
the union of the stored leaves below it, so the loans are read once, when they are added, and no level expands them.

A kept view is the sums behind it per key, as signed changes: an insert adds, a delete subtracts, an update does both.
Each batch writes its own changes, every ``every``-th batch a snapshot, so a version is a snapshot and a few sets of
changes whose places follow from the batch number; a batch that is written again replaces only itself.

Cases: null keys are keys like others in kept sums and drop out where a view joins on them; loans of unknown patrons or
copies count nowhere (inner joins, as in the views); a key whose sums are all zero again is no longer kept; empty facts
give empty summaries and views with their zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwise.functions import year_key
from lendwise.sources.tables import Tables

LOG_K = 12      # sketches of 2^12 registers: a relative standard error of 1.04 / 2^6 = 1.6 per cent
BOUND = 0.065   # four standard errors
LEVELS = ("patron_type", "loan_year", "branch_id")
ALL = "ALL"


# --------------------------------------------------------------------------------------------- G-03 distinct counts

def _leaves(t: Tables, loans: DataFrame) -> DataFrame:
    """Distinct (type, year, branch, patron) of some loans: reduced per (patron, copy, year) before any join."""
    used = loans.select("patron_id", "copy_id", year_key("loan_ts").alias("loan_year")).distinct()
    used = used.join(t.copy.select("copy_id", "branch_id"), "copy_id").select("patron_id", "branch_id", "loan_year").distinct()
    return used.join(t.patron.select("patron_id", "patron_type"), "patron_id").select(
        "patron_type", "loan_year", F.col("branch_id").cast("string").alias("branch_id"), "patron_id")


def add_distinct(t: Tables, loans: DataFrame, root: str, batch: int = 0) -> None:
    """Adds the distinct patrons of ``loans`` to the summary at ``root`` as batch ``batch`` (written again: replaced)."""
    leaves = _leaves(t, loans)
    exact = leaves.groupBy(*LEVELS, F.bitmap_bucket_number("patron_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("patron_id")).alias("bits"))
    exact.write.mode("overwrite").parquet(f"{root}/exact/batch={batch}")
    leaves.groupBy(*LEVELS).agg(F.hll_sketch_agg("patron_id", F.lit(LOG_K)).alias("sketch")).write.mode("overwrite").parquet(
        f"{root}/sketch/batch={batch}")


def rollup_distinct(spark: SparkSession, root: str) -> DataFrame:
    """Every level of ROLLUP(type, year, branch): distinct patrons, exact and estimated, 'ALL' for what is rolled up.
    Reads the summary only."""
    keys = ", ".join(f"{c} string" for c in LEVELS)
    exact = spark.read.schema(f"{keys}, bucket long, bits binary").parquet(f"{root}/exact")
    sketch = spark.read.schema(f"{keys}, sketch binary").parquet(f"{root}/sketch")
    levels = F.explode(F.array(*[F.struct(*[(F.col(c) if i < k else F.lit(ALL)).alias(c) for i, c in enumerate(LEVELS)])
                                 for k in range(len(LEVELS) + 1)])).alias("at")
    at = [F.col(f"at.{c}").alias(c) for c in LEVELS]
    united = exact.select(levels, "bucket", "bits").groupBy(*at, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    counted = united.groupBy(*LEVELS).agg(F.sum(F.bitmap_count("bits")).alias("distinct_patrons"))
    estimated = sketch.select(levels, "sketch").groupBy(*at).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimated_patrons"))
    return counted.join(estimated, list(LEVELS)).select(*LEVELS, "distinct_patrons", "estimated_patrons")


def g03_distinct_levels(t: Tables, root: str) -> DataFrame:
    """Distinct patrons per level of ROLLUP(type, year, branch) from a summary that the loans were added to in two batches,
    and whether the sketch's estimate lies within its stated bound of the exact count."""
    early = F.year("loan_ts") < 1998
    add_distinct(t, t.loan.filter(early), root, 0)
    add_distinct(t, t.loan.filter(~early), root, 1)
    off = F.abs(F.col("estimated_patrons") - F.col("distinct_patrons"))
    return rollup_distinct(t.loan.sparkSession, root).select(
        *LEVELS, "distinct_patrons", (off <= F.col("distinct_patrons") * BOUND).alias("within_bound"))


# --------------------------------------------------------------------------------------------- S-25 kept views

@dataclass(frozen=True)
class KeptSums:
    """Sums per key at ``root``, versioned by batch number (0, 1, 2, ...)."""

    root: str
    keys: tuple[tuple[str, str], ...]  # name, type
    sums: tuple[tuple[str, str], ...]
    every: int = 16

    @property
    def _schema(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in (*self.keys, *self.sums))

    def _summed(self, rows: DataFrame) -> DataFrame:
        total = rows.groupBy(*[k for k, _ in self.keys]).agg(*[F.sum(s).cast(kind).alias(s) for s, kind in self.sums])
        some = F.lit(False)
        for s, _ in self.sums:
            some = some | (F.col(s) != 0)
        return total.filter(some)

    def _parts(self, after: int) -> list[str]:
        """Folders whose rows add up to the version after batch ``after``."""
        if after < 0:
            return []
        last = (after + 1) // self.every * self.every - 1  # the last snapshot, if any
        return ([f"{self.root}/snapshot={last}"] if last >= 0 else []) + [
            f"{self.root}/changes={b}" for b in range(last + 1, after + 1)]

    def _read(self, spark: SparkSession, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self._schema)
        return spark.read.schema(self._schema).parquet(*folders)

    def add(self, changes: DataFrame, batch: int) -> None:
        """Adds a batch of signed contributions (keys and sums)."""
        spark = changes.sparkSession
        self._summed(changes).write.mode("overwrite").parquet(f"{self.root}/changes={batch}")
        if (batch + 1) % self.every == 0:
            folders = [*self._parts(batch - self.every), *[f"{self.root}/changes={b}" for b in range(batch + 1 - self.every, batch + 1)]]
            self._summed(self._read(spark, folders)).write.mode("overwrite").parquet(f"{self.root}/snapshot={batch}")

    def after(self, spark: SparkSession, batch: int) -> DataFrame:
        """The sums as they are after a batch."""
        return self._summed(self._read(spark, self._parts(batch)))


def kept_fines(root: str, every: int = 16) -> KeptSums:
    return KeptSums(root, (("patron_id", "long"),), (("n", "long"), ("total", "decimal(20,2)"), ("unpaid", "decimal(20,2)")), every)


def kept_inventory(root: str, every: int = 16) -> KeptSums:
    return KeptSums(root, (("branch_id", "long"), ("isbn", "string")), (("n", "long"),), every)


def kept_sessions(root: str, every: int = 16) -> KeptSums:
    """Sessions per (resource, patron): a patron counts as long as one of their sessions is left."""
    return KeptSums(root, (("resource_id", "long"), ("patron_id", "long")), (("n", "long"),), every)


def fine_changes(signed: DataFrame) -> DataFrame:
    """Contributions of fine rows with ``sign`` (+1 or -1)."""
    s = F.col("sign")
    return signed.select("patron_id", s.cast("long").alias("n"), (s * F.col("amount")).alias("total"),
                         F.when(F.col("status") == "Unpaid", s * F.col("amount")).otherwise(0).alias("unpaid"))


def copy_changes(signed: DataFrame) -> DataFrame:
    return signed.select("branch_id", "isbn", F.col("sign").cast("long").alias("n"))


def session_changes(signed: DataFrame) -> DataFrame:
    return signed.select("resource_id", "patron_id", F.col("sign").cast("long").alias("n"))


def v04_from_kept(t: Tables, sums: DataFrame) -> DataFrame:
    """V-04 from kept sums: the fines are not read."""
    zero = F.lit(0).cast("decimal(18,2)")
    return t.patron.join(sums, "patron_id", "left").select(
        "patron_id", "first_name", "last_name", "email",
        F.coalesce(F.col("total").cast("decimal(18,2)"), zero).alias("total_fines"),
        F.coalesce(F.col("unpaid").cast("decimal(18,2)"), zero).alias("unpaid_fines"))


def v08_from_kept(t: Tables, sums: DataFrame) -> DataFrame:
    """V-08 from kept sums: the copies are not read."""
    br = t.branch.select("branch_id", F.col("name").alias("branch_name"))
    return sums.join(br, "branch_id").join(t.book.select("isbn", "title"), "isbn").select(
        "branch_id", "branch_name", "isbn", "title", F.col("n").alias("num_copies"))


def v09_from_kept(t: Tables, sums: DataFrame) -> DataFrame:
    """V-09 from kept sums: the sessions are not read."""
    use = sums.groupBy("resource_id").agg(F.sum("n").alias("sessions"), F.count("patron_id").alias("patrons"))
    rt = t.resourcetype.select("resource_type_id", F.col("name").alias("resource_type"))
    zero = F.lit(0).cast("bigint")
    return t.eresource.join(rt, "resource_type_id").join(use, "resource_id", "left").select(
        "resource_id", "title", "resource_type", F.coalesce("sessions", zero).alias("total_sessions"),
        F.coalesce("patrons", zero).alias("distinct_patrons"))


def kept_after(sums: KeptSums, batches: Sequence[DataFrame]) -> DataFrame:
    """The sums after adding some batches of signed contributions in order."""
    for b, changes in enumerate(batches):
        sums.add(changes, b)
    return sums.after(batches[0].sparkSession, len(batches) - 1)
