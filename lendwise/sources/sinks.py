"""Batch sinks: append rows to a stored library table (K-01) in its declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lendwise.sources.tables import conform


def append_table(df: DataFrame, table: str, path: str, fmt: str = "parquet",
                 partition_by: Sequence[str] = ()) -> None:
    """Append ``df`` (cast to the table's declared columns) to ``path``. Pair with the admission rules to
    append only accepted rows."""
    writer = conform(df, table).write.mode("append").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


# Event-time column of each fact table: stored sorted by it, parquet row-group min/max statistics let
# time-window filters (recent loans, sessions of a day, ...) skip row groups.
EVENT_TIME = {"loan": "loan_ts", "fine": "created_at", "reservation": "created_at",
              "accesssession": "start_time", "illrequest": "requested_at"}


def write_tables(tables, root: str, fmt: str = "parquet", cluster_by_time: bool = False) -> None:
    """Store every table under ``<root>/<name>.<fmt>`` (overwrite), e.g. to persist a projection once.

    ``cluster_by_time`` range-partitions each fact table on its event time and sorts within partitions, so every
    output file covers a narrow time range (one shuffle per fact table, written once, read many times)."""
    for name, df in tables.items():
        out = conform(df, name)
        if cluster_by_time and name in EVENT_TIME:
            col = EVENT_TIME[name]
            out = out.repartitionByRange(col).sortWithinPartitions(col)
        writer = out.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.save(f"{root}/{name}.{fmt}")


# Join keys the operators use most: loans meet copies on copy_id (popularity, availability, copy locations)
BUCKET_KEYS = {"loan": "copy_id", "copy": "copy_id"}


def save_bucketed(tables, prefix: str, buckets: int, keys: dict[str, str] | None = None) -> None:
    """Save tables through the session catalog as ``<prefix>_<table>``, bucketed and sorted on their join key
    (``BUCKET_KEYS`` by default) with the same bucket count, so joins and aggregations on that key read
    co-located buckets instead of shuffling. Tables without a key are saved plainly."""
    keys = BUCKET_KEYS if keys is None else keys
    for name, df in tables.items():
        writer = conform(df, name).write.mode("overwrite").format("parquet")
        if name in keys:
            writer = writer.bucketBy(buckets, keys[name]).sortBy(keys[name])
        writer.saveAsTable(f"{prefix}_{name}")


def load_saved(spark, prefix: str, names=None):
    """The tables saved by ``save_bucketed`` (bucketing metadata comes from the catalog)."""
    from lendwise.sources.schemas import TABLES
    from lendwise.sources.tables import Tables

    return Tables({n: spark.table(f"{prefix}_{n}") for n in (names or TABLES)})
