"""Keyed state of open rows (loans not returned, active reservations, sessions not ended), versioned per micro-batch.

The state of a batch id is a snapshot plus the changes of the batches since:

    <root>/snapshot=<v>/bucket=<k>/   open rows after batch v, by hash of their key; v = -1 is the seed
    <root>/changes=<b>/               rows opened (+1) and closed (-1) by batch b

A snapshot follows every ``every``-th batch, so the version that a batch reads is known from its number alone: the last
snapshot before it and at most ``every - 1`` sets of changes. Nothing is listed, nothing is overwritten but a batch's own
folders, and a replayed batch reads what it read the first time. Only rows that are still open are kept, so the state
grows with what is open and not with history. A missing folder is an error, never an empty state.

A micro-batch reads the buckets of its own keys (partition filter) and of those only its own keys (semi-join).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY, BUCKETS = 16, 64


@dataclass(frozen=True)
class OpenState:
    """State of rows with key columns ``key`` (name -> type), row id ``item`` and ``owner``, at ``root``."""

    root: str
    key: tuple[tuple[str, str], ...]
    every: int = EVERY
    buckets: int = BUCKETS

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.key]

    @property
    def _columns(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in self.key) + ", item long, owner long"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.names), F.lit(self.buckets)).cast("int")

    def snapshot_before(self, batch_id: int) -> int:
        """The last version v < batch_id with a snapshot."""
        return batch_id - 1 - batch_id % self.every if batch_id > 0 else -1

    def seed(self, open_rows: DataFrame) -> None:
        """Version -1: the rows (key, item, owner) that are open before the first batch."""
        self._write_snapshot(open_rows, -1)

    def _write_snapshot(self, rows: DataFrame, version: int) -> None:
        rows = rows.select(*self.names, "item", "owner", self.bucket().alias("bucket"))
        (rows.repartition("bucket").sortWithinPartitions(*self.names).write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.root}/snapshot={version}"))

    def read(self, spark: SparkSession, batch_id: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """Open rows (key, item, owner) before ``batch_id``, of the given buckets."""
        last = self.snapshot_before(batch_id)
        rows = spark.read.schema(f"{self._columns}, bucket int").parquet(f"{self.root}/snapshot={last}")
        rows = rows.withColumn("sign", F.lit(1))
        for b in range(last + 1, batch_id):
            rows = rows.unionByName(spark.read.schema(f"{self._columns}, bucket int, sign int").parquet(
                f"{self.root}/changes={b}"))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin([int(b) for b in buckets]))
        return rows

    def open_rows(self, rows: DataFrame) -> DataFrame:
        """What is open of the rows that ``read`` gives: each (key, item) with its opened less its closed ones."""
        netted = rows.groupBy(*self.names, "item").agg(F.sum("sign").alias("sign"), F.max("owner").alias("owner"))
        return netted.filter("sign > 0").drop("sign")

    def of_batch(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Open rows of the keys of ``batch`` before ``batch_id``. The batch's bucket numbers, at most ``buckets`` of
        them, come to the driver; its keys do not."""
        keys = batch.select(*self.names).dropna().distinct()
        touched = [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]
        rows = self.read(batch.sparkSession, batch_id, touched)
        return self.open_rows(rows.join(keys, self.names, "left_semi"))

    def commit(self, changes: DataFrame, batch_id: int) -> None:
        """Writes the changes (key, item, owner, sign) of a batch, and a snapshot when its turn has come."""
        spark = changes.sparkSession
        (changes.select(*self.names, "item", "owner", self.bucket().alias("bucket"), F.col("sign").cast("int").alias("sign"))
         .write.mode("overwrite").parquet(f"{self.root}/changes={batch_id}"))
        if (batch_id + 1) % self.every == 0:
            self._write_snapshot(self.open_rows(self.read(spark, batch_id + 1 - self.every, None).unionByName(
                self._changes(spark, batch_id))), batch_id)

    def _changes(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """All changes since the snapshot that is read by the first batch of this round."""
        parts = [spark.read.schema(f"{self._columns}, bucket int, sign int").parquet(f"{self.root}/changes={b}")
                 for b in range(batch_id + 1 - self.every, batch_id + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def current(self, spark: SparkSession, after_batch: int) -> DataFrame:
        """Everything open after a batch."""
        return self.open_rows(self.read(spark, after_batch + 1))
