"""Typed table loading: every table is read with its declared schema, never inferred."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwise.sources.schemas import TABLES


class Tables(Mapping):
    """Name -> DataFrame for the 22 library tables, with attribute access (``t.loan``). ``tasks``, if known, is the number
    of partitions that suits a shuffle of the largest table's rows (``tasks_for``)."""

    def __init__(self, frames: Mapping[str, DataFrame], tasks: int | None = None):
        self._frames, self.tasks = dict(frames), tasks

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self._frames[name]
        except KeyError as exc:  # pragma: no cover - attribute protocol
            raise AttributeError(name) from exc

    def __iter__(self):
        return iter(self._frames)

    def __len__(self):
        return len(self._frames)

    def replace(self, **frames: DataFrame) -> "Tables":
        merged = dict(self._frames)
        merged.update(frames)
        return Tables(merged, self.tasks)

    def register_views(self, prefix: str = "") -> None:
        """Expose every table as a temp view so the same data can be queried with ``spark.sql``."""
        for name, df in self._frames.items():
            df.createOrReplaceTempView(prefix + name)


ROWS_PER_TASK, FEW_ROWS = 400_000, 50_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows: at most ``ROWS_PER_TASK`` of them each; fewer while cores are idle, but not fewer than
    ``FEW_ROWS``."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-rows // ROWS_PER_TASK), min(cores, -(-rows // FEW_ROWS)))


def spread(df: DataFrame, *keys, tasks: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to ``tasks`` partitions (default: as many as the session's shuffles have). Adaptive execution
    merges the partitions of other shuffles by their compressed bytes; it keeps these, so that a step that makes many rows
    of a few bytes, or gathers them in a hash map, has its share of them per task and no more."""
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def conform(df: DataFrame, table: str, collation: str | None = None) -> DataFrame:
    """Select and cast ``df`` to the declared column order and types of ``table``.

    ``collation`` (e.g. ``UNICODE_CI_AI_RTRIM``) makes every text column compare, group and sort
    case-, accent- and trailing-space-insensitively, like the source database's default collation."""
    spec = TABLES[table]
    cols = []
    for c in spec.columns:
        col = F.col(c.name).cast(c.dtype)
        if collation and c.dtype.simpleString() == "string":
            col = F.collate(col, collation)
        cols.append(col.alias(c.name))
    return df.select(cols)


TEXT_FORMATS = ("csv", "json", "xml")


def load_raw(spark: SparkSession, table: str, path: str, fmt: str = "csv",
             options: Mapping[str, str] | None = None) -> DataFrame:
    """A text source as it stands: every declared column as a string, nothing converted."""
    schema = T.StructType([T.StructField(c.name, T.StringType()) for c in TABLES[table].columns])
    reader = spark.read.schema(schema).options(**(options or {}))
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def split_convertible(raw: DataFrame, table: str, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed rows whose every value converts to its declared type, quarantine: the other rows as text with ``bad``,
    the names of the columns that do not convert)."""
    names = [c.name for c in TABLES[table].columns]
    bad = F.filter(F.array(*[F.when(F.col(c.name).isNotNull() & F.col(c.name).try_cast(c.dtype).isNull(), F.lit(c.name))
                             for c in TABLES[table].columns]), lambda x: x.isNotNull())
    marked = raw.select(*names, bad.alias("bad"))
    return (conform(marked.filter(F.size("bad") == 0).select(*names), table, collation),
            marked.filter(F.size("bad") > 0))


def load_table(spark: SparkSession, table: str, path: str, fmt: str = "parquet", options: Mapping[str, str] | None = None,
               collation: str | None = None, quarantine: str | None = None) -> DataFrame:
    """Read one table with its declared schema. ``fmt`` is any Spark source: parquet, orc, csv, json.

    Text sources are read as text and converted. A value that does not convert never becomes a silent NULL: with
    ``quarantine`` its row is written to that folder (Parquet, with the names of the bad columns) and left out here,
    without it reading the row raises an error. For a remote database use ``load_jdbc``.
    """
    if fmt not in TEXT_FORMATS:
        return conform(spark.read.schema(TABLES[table].schema).options(**(options or {})).format(fmt).load(path), table, collation)
    return typed(load_raw(spark, table, path, fmt, options), table, collation, quarantine)


def typed(raw: DataFrame, table: str, collation: str | None = None, quarantine: str | None = None) -> DataFrame:
    """Text rows of a table in its declared types. A row with a value that does not convert goes to ``quarantine``, or
    reading it raises an error."""
    if quarantine is not None:
        good, rejected = split_convertible(raw, table, collation)
        rejected.write.mode("append").parquet(quarantine)
        return good
    checked = [F.when(F.col(c.name).isNotNull() & F.col(c.name).try_cast(c.dtype).isNull(), F.raise_error(F.concat(
        F.lit(f"{table}.{c.name} is not a {c.dtype.simpleString()}: "), F.col(c.name))).cast(c.dtype)).otherwise(
        F.col(c.name).try_cast(c.dtype)).alias(c.name) for c in TABLES[table].columns]
    return conform(raw.select(*checked), table, collation)


def load_jdbc(spark: SparkSession, table: str, url: str, properties: Mapping[str, str],
              dbtable: str | None = None, partition_column: str | None = None,
              num_partitions: int = 1, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Read a table from a relational database over JDBC (documented path; needs a driver jar).

    Large tables should pass ``partition_column`` with ``bounds`` so the read is split into
    ``num_partitions`` parallel range queries instead of one connection.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable or table)
    for k, v in properties.items():
        reader = reader.option(k, v)
    if partition_column and bounds:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", num_partitions))
    return conform(reader.load(), table)


def load_tables(spark: SparkSession, root: str, fmt: str = "parquet",
                names: Iterable[str] | None = None, collation: str | None = None) -> Tables:
    """Load ``<root>/<table>.<fmt>`` for each library table."""
    names = list(names or TABLES)
    return Tables({n: load_table(spark, n, f"{root}/{n}.{fmt}", fmt, collation=collation) for n in names})


def with_collation(t: Tables, collation: str) -> Tables:
    """The same tables with every text column under ``collation``."""
    return Tables({n: conform(df, n, collation) for n, df in t.items()})


def from_rows(spark: SparkSession, table: str, rows: Iterable) -> DataFrame:
    """Literal-row source (INSERT ... VALUES batches): typed DataFrame from Python tuples or dicts."""
    return spark.createDataFrame(list(rows), TABLES[table].schema)
