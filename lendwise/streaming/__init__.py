"""Structured Streaming around the admission rules T-01, T-04 and T-05 (with T-02 and T-06 for later changes).

Incoming rows arrive as a stream of inserts and updates. Every micro-batch is judged row by row, in order, against the
rows that are open: loans not returned per copy, active reservations per (patron, book, branch), sessions not ended per
resource. What is open is a keyed state of its own (``lendwise.streaming.state``), versioned per batch id and changed by
what each batch opens and closes, so a micro-batch reads the state of its own keys and never the accepted history.

A change row has the table's columns and, optionally, ``op`` ('insert', the default, or 'update') and ``at`` (event time,
by default the column that opens a row). Rules:

* An insert fails if its key has as many open rows as its limit, or by its own dates; if it does not and is open, it
  counts from then on.
* An update names an open row by key and id. If it closes the row (returned, fulfilled or cancelled, ended), the count
  falls and the next insert of the key may pass. It fails if the row is not open, or by T-02 or T-06.
* Order inside a micro-batch: event time (null first), updates before inserts of the same time, id. A row that arrives
  in a later micro-batch than its event time would put it (a late row) is judged when it arrives, against what is open
  then, as the rule that runs before each insert would: its decision never changes earlier ones.
* A row with a null key counts for nothing and meets no limit. An update with a null key names no open row.

Accepted inserts, accepted updates and rejected rows are written under ``batch_id=<n>`` of the table folder, its
``_updates`` folder and the quarantine folder. Each write replaces that batch's folder and the state that a batch reads
depends on its number alone, so a micro-batch replayed after a failure gives the same result.

The rows of one key in one micro-batch pass through one task in order, since each decision depends on the one before;
the task streams them and remembers only the rows that the batch itself opened and closed for the key at hand. The size
of a micro-batch (``maxFilesPerTrigger`` and the like) bounds that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from lendwise.functions import as_timestamp
from lendwise.operators import admission as A
from lendwise.sources.schemas import RESERVATION_INACTIVE, TABLES
from lendwise.streaming.state import BUCKETS, EVERY, OpenState

MSG_NOT_OPEN = "No open row to update."


@dataclass(frozen=True)
class Rule:
    """What is open in a table, per which key, and which row checks come after the count (reason or null)."""

    table: str
    key: tuple[str, ...]
    item: str
    owner: str
    opened_at: str
    is_open: Callable[[], Column]
    full: str  # reason at the limit
    insert_check: Callable[[], Column] = lambda: F.lit(None).cast("string")
    update_check: Callable[[], Column] = lambda: F.lit(None).cast("string")
    owner_changed: str | None = None  # reason when an update names another owner

    @property
    def columns(self) -> list[str]:
        return [c.name for c in TABLES[self.table].columns]

    def state(self, root: str, every: int = EVERY, buckets: int = BUCKETS) -> OpenState:
        kinds = tuple((k, TABLES[self.table].col(k).dtype.simpleString()) for k in self.key)
        return OpenState(root, kinds, every, buckets)

    def open_rows(self, rows: DataFrame) -> DataFrame:
        """(key, item, owner) of the stored rows that are open; rows with a null key count for nothing."""
        return rows.filter(self.is_open()).dropna(subset=list(self.key)).select(
            *self.key, F.col(self.item).alias("item"), F.col(self.owner).alias("owner"))


RULES: dict[str, Rule] = {
    "loan": Rule(
        "loan", ("copy_id",), "loan_id", "patron_id", "loan_ts", lambda: F.col("return_ts").isNull(), A.MSG_COPY_ON_LOAN,
        lambda: F.when(F.col("due_ts") <= F.col("loan_ts"), A.MSG_LOAN_DATES),
        lambda: F.when(F.col("return_ts") < F.col("loan_ts"), A.MSG_RETURN_DATE), A.MSG_PATRON_CHANGED),
    "reservation": Rule(
        "reservation", ("patron_id", "isbn", "branch_id"), "reservation_id", "patron_id", "created_at",
        lambda: F.coalesce(~F.col("status").isin(*RESERVATION_INACTIVE), F.lit(False)), A.MSG_RESERVATION),
    "accesssession": Rule(
        "accesssession", ("resource_id",), "session_id", "patron_id", "start_time", lambda: F.col("end_time").isNull(),
        A.MSG_SESSION_LIMIT, update_check=lambda: F.when(F.col("end_time") < F.col("start_time"), A.MSG_SESSION_END)),
}

_JUDGED = ("_limit", "_count", "_stored", "_owner", "_is_open", "_check", "_update")


class _Fold:
    """Decisions in order, key by key. Remembers what the batch opened and closed for the key at hand."""

    def __init__(self, rule: Rule):
        self.rule, self.key = rule, None
        self.count, self.opened, self.closed = 0, {}, set()

    def __call__(self, key, item, owner, limit, count, stored, stored_owner, is_open, check, update):
        """(reason or None, +1 opened, -1 closed or 0)"""
        if None in key:  # counts for nothing
            return (MSG_NOT_OPEN if update else check), 0
        if key != self.key:
            self.key, self.count, self.opened, self.closed = key, count or 0, {}, set()
        if not update:
            if limit is not None and self.count >= limit:
                return self.rule.full, 0
            if check or not is_open:
                return check, 0
            self.count += 1
            self.opened[item] = owner
            self.closed.discard(item)
            return None, 1
        if item in self.opened:
            held = self.opened[item]
        elif stored and item not in self.closed:
            held = stored_owner
        else:
            return MSG_NOT_OPEN, 0
        if check:
            return check, 0
        if self.rule.owner_changed and owner is not None and owner != held:
            return self.rule.owner_changed, 0
        if is_open:
            return None, 0
        self.count -= 1
        self.opened.pop(item, None)
        self.closed.add(item)
        return None, -1


def decide(batch: DataFrame, rule: Rule, open_rows: DataFrame, limits: DataFrame | Column) -> DataFrame:
    """The change rows with ``reason``, ``accepted`` and ``change`` (+1 opened, -1 closed, 0). ``open_rows`` holds what is
    open of the batch's keys; ``limits`` is a column, or a table (key, _limit)."""
    cols = rule.columns
    b = batch.select(*cols, "op", "at").withColumn("_update", F.coalesce(F.col("op") == "update", F.lit(False)))
    b = b.withColumn("_is_open", rule.is_open())
    b = b.withColumn("_check", F.when(F.col("_update"), rule.update_check()).otherwise(rule.insert_check()))
    counts = open_rows.groupBy(*rule.key).agg(F.count(F.lit(1)).alias("_count"))
    b = b.join(counts, list(rule.key), "left")
    held = open_rows.select(*rule.key, F.col("item").alias(rule.item), F.lit(True).alias("_stored"),
                            F.col("owner").alias("_owner"))
    b = b.join(held, [*rule.key, rule.item], "left")
    b = b.withColumn("_limit", limits) if isinstance(limits, Column) else b.join(limits, list(rule.key), "left")
    order = [F.col(c).asc_nulls_first() for c in rule.key] + [
        F.col("at").asc_nulls_first(), F.col("_update").desc(), F.col(rule.item).asc_nulls_first()]
    b = b.select(*cols, "op", "at", *_JUDGED).repartition(*rule.key).sortWithinPartitions(*order)

    def task(batches: Iterator[pa.RecordBatch]):
        fold = _Fold(rule)
        for part in batches:
            names = part.schema.names
            col = lambda name: part.column(names.index(name)).to_pylist()
            keys = zip(*(col(k) for k in rule.key))
            rows = zip(keys, col(rule.item), col(rule.owner), *(col(c) for c in _JUDGED))
            told = [fold(*row) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(cols) + 2], pa.array([r for r, _ in told], pa.string()),
                 pa.array([s for _, s in told], pa.int32())], names=[*names[:len(cols) + 2], "reason", "change"])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in b.schema.fields[:len(cols) + 2]]
                          + [T.StructField("reason", T.StringType()), T.StructField("change", T.IntegerType())])
    return b.mapInArrow(task, schema).withColumn("accepted", F.col("reason").isNull())


def session_limits(eresource: DataFrame, license_: DataFrame) -> DataFrame:
    """(resource_id, _limit) of the resources whose license has a limit."""
    return eresource.select("resource_id", "license_id").join(
        license_.select("license_id", "concurrent_limit"), "license_id").groupBy("resource_id").agg(
        F.min("concurrent_limit").alias("_limit"))


def with_changes(rows: DataFrame, rule: Rule) -> DataFrame:
    """Rows as change rows: a missing ``op`` is an insert, a missing ``at`` the column that opens a row."""
    op = F.col("op") if "op" in rows.columns else F.lit("insert")
    at = F.col("at") if "at" in rows.columns else F.col(rule.opened_at)
    return rows.select(*rule.columns, op.alias("op"), at.cast("timestamp_ntz").alias("at"))


def _stored_without_batch(spark: SparkSession, path: str, rule: Rule) -> DataFrame | None:
    """Rows that a batch append wrote to the table folder before the stream; None without such a folder."""
    try:
        rows = spark.read.schema(TABLES[rule.table].schema.add("batch_id", "long")).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter("batch_id IS NULL").select(*rule.columns)


def admission_batch_writer(table: str, table_path: str, quarantine_path: str, base: DataFrame | None = None,
                           state_path: str | None = None, updates_path: str | None = None, every: int = EVERY,
                           buckets: int = BUCKETS, eresource: DataFrame | None = None,
                           license_: DataFrame | None = None, now=None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: judge one micro-batch against the open rows of its keys, write both sides and the
    changes of the state. The decision is computed once and kept until all are written.

    The state is seeded by batch 0 from ``base`` and from rows that lie in the table folder without a batch id. Sessions
    need ``eresource`` and ``license_`` for their limits and ``now`` for missing start times."""
    rule = RULES[table]
    state = rule.state(state_path or f"{table_path.rstrip('/')}_open", every, buckets)
    updates_path = updates_path or f"{table_path.rstrip('/')}_updates"
    cols = rule.columns

    def process(batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        if batch_id == 0:
            seed = [df.select(*cols) for df in (base, _stored_without_batch(spark, table_path, rule)) if df is not None]
            rows = spark.createDataFrame([], TABLES[table].schema)
            for df in seed:
                rows = rows.unionByName(df)
            state.seed(rule.open_rows(rows))
        limits: DataFrame | Column = F.lit(1)
        batch = with_changes(batch_df, rule)
        if table == "accesssession":
            limits = session_limits(eresource, license_)
            begun = F.coalesce(F.col("start_time"), as_timestamp(now))
            batch = batch.withColumn("start_time", begun).withColumn("at", F.coalesce("at", "start_time"))
        batch = batch.persist()
        decided = decide(batch, rule, state.of_batch(batch, batch_id), limits).persist()
        try:
            insert = F.coalesce(F.col("op") != "update", F.lit(True))
            decided.filter(F.col("accepted") & insert).select(*cols).write.mode("overwrite").parquet(
                f"{table_path}/batch_id={batch_id}")
            decided.filter(F.col("accepted") & ~insert).select(*cols, "at").write.mode("overwrite").parquet(
                f"{updates_path}/batch_id={batch_id}")
            decided.filter(~F.col("accepted")).drop("change").write.mode("overwrite").parquet(
                f"{quarantine_path}/batch_id={batch_id}")
            state.commit(decided.filter("change <> 0").select(
                *rule.key, F.col(rule.item).alias("item"), F.col(rule.owner).alias("owner"), F.col("change").alias("sign")),
                batch_id)
        finally:
            decided.unpersist()
            batch.unpersist()

    return process


def start_admission_stream(incoming: DataFrame, table: str, table_path: str, quarantine_path: str,
                           checkpoint_location: str, trigger: dict | None = None, base: DataFrame | None = None,
                           **kwargs) -> StreamingQuery:
    """Start the stream; ``trigger`` is passed to ``DataStreamWriter.trigger`` (default: availableNow), ``kwargs`` to
    ``admission_batch_writer``."""
    writer = (incoming.writeStream
              .foreachBatch(admission_batch_writer(table, table_path, quarantine_path, base, **kwargs))
              .option("checkpointLocation", checkpoint_location))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def replay(batches: Sequence[DataFrame], table: str, root: str, **kwargs) -> DataFrame:
    """The decisions of a stream whose micro-batches are ``batches``, written below ``root``: id, op, accepted, reason."""
    process = admission_batch_writer(table, f"{root}/table", f"{root}/quarantine", **kwargs)
    for batch_id, batch in enumerate(batches):
        process(batch, batch_id)
    return decisions(batches[0].sparkSession, table, f"{root}/table", f"{root}/quarantine")


def decisions(spark: SparkSession, table: str, table_path: str, quarantine_path: str,
              updates_path: str | None = None) -> DataFrame:
    """Every change row's id, op, whether it was accepted, and the reason if not."""
    item, none = RULES[table].item, F.lit(None).cast("string").alias("reason")
    kind = f"{item} long"
    inserts = spark.read.schema(kind).parquet(table_path)
    updates = spark.read.schema(kind).parquet(updates_path or f"{table_path.rstrip('/')}_updates")
    away = spark.read.schema(f"{kind}, op string, reason string").parquet(quarantine_path)
    op = F.when(F.coalesce(F.col("op") == "update", F.lit(False)), "update").otherwise("insert").alias("op")
    parts = [inserts.select(item, F.lit("insert").alias("op"), F.lit(True).alias("accepted"), none),
             updates.select(item, F.lit("update").alias("op"), F.lit(True).alias("accepted"), none),
             away.select(item, op, F.lit(False).alias("accepted"), "reason")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def current_rows(spark: SparkSession, table: str, table_path: str, base: DataFrame | None = None,
                 updates_path: str | None = None) -> DataFrame:
    """The table as it stands: stored and accepted rows, each as its last accepted update left it."""
    rule = RULES[table]
    cols = rule.columns
    rows = spark.read.schema(TABLES[table].schema).parquet(table_path).select(*cols)
    rows = rows if base is None else rows.unionByName(base.select(*cols))
    updates = spark.read.schema(TABLES[table].schema.add("at", T.TimestampNTZType()).add("batch_id", "long")).parquet(
        updates_path or f"{table_path.rstrip('/')}_updates")
    rest = [c for c in cols if c not in (*rule.key, rule.item)]
    last = updates.groupBy(*rule.key, rule.item).agg(
        F.max_by(F.struct(*rest), F.struct("batch_id", "at")).alias("_last")) if rest else updates
    joined = rows.join(last, [*rule.key, rule.item], "left")
    return joined.select(*[F.when(F.col("_last").isNotNull(), F.col("_last")[c]).otherwise(F.col(c)).alias(c)
                           if c in rest else F.col(c) for c in cols])
