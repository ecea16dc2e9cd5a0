"""Skew-safe ranking: ROW_NUMBER / RANK / DENSE_RANK and running counts without a single-partition window.

A plain ``rank().over(Window.orderBy(...))`` moves every row into one task (``Exchange SinglePartition``), and
``Window.partitionBy(low_cardinality_col)`` puts a whole hot group into one task. Here ranks are computed from
prefix sums instead:

1. rows are reduced to their distinct (partition, order) keys with a count (partial aggregation collapses any
   hot key before the shuffle);
2. the keys' order is cut into ranges by explicit splitters: a bounded sample of the keys, the lowest by hash, is sorted
   and every so many-th of it is held as a literal. The range of a row is the number of splitters at or before its key, a
   pure function of the key: whatever is computed twice, retried or lost gets the same range, so nothing is checkpointed.
   The sample is one small job and decides only how even the ranges are;
3. each range gets a running sum by a window over that range only (one row per distinct key, so no range holds a hot
   group), and the ranges' totals (one row per range: a proven small size) give each range its offset;
4. the start of each partition group is the smallest prefix inside it; rank = prefix - start + 1;
5. the ranks are joined back to the rows on the key (null-safe); AQE splits a hot key on the row side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

OrderSpec = Sequence[tuple[str, bool]]  # (column, descending)


def _sort_exprs(partition_by: Sequence[str], order_by: OrderSpec) -> list[Column]:
    exprs = [F.col(c).asc_nulls_first() for c in partition_by]
    for c, desc in order_by:
        # NULL sorts lowest: first when ascending, last when descending
        exprs.append(F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first())
    return exprs


def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str], prefix: str = "") -> Column:
    cond = None
    for c in cols:
        term = left[c].eqNullSafe(right[prefix + c])
        cond = term if cond is None else cond & term
    return cond


def _attach(df: DataFrame, ranks: DataFrame, keycols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Join rank columns back to the rows (null-safe on the key); key columns are renamed first because both
    sides descend from the same rows."""
    r = ranks.select(*[F.col(c).alias("_k_" + c) for c in keycols], *names)
    return df.join(r, _null_safe_on(df, r, keycols, "_k_")).select(*[df[c] for c in df.columns], *[r[n] for n in names])


SAMPLES = 32  # sampled keys per range


def splitters(keys: DataFrame, partition_by: Sequence[str], order_by: OrderSpec, ranges: int) -> list[Row]:
    """At most ``ranges - 1`` keys, in order, that cut the keys into ranges of like sizes: one job, which brings
    ``SAMPLES`` keys per range to the driver."""
    cols = [*partition_by, *[c for c, _ in order_by]]
    plain = [F.col(c).cast("string") for c in cols]  # collated text has no hash of its own
    low = keys.select(*cols).orderBy(F.xxhash64(*plain)).limit(SAMPLES * ranges)
    got = low.orderBy(*_sort_exprs(partition_by, order_by)).collect()
    at = sorted({len(got) * k // ranges for k in range(1, ranges)})
    return [got[i] for i in at if i < len(got)]


def _before(a: Sequence[Column], b: Sequence[Column], descending: Sequence[bool]) -> Column:
    """Key ``a`` sorts strictly before key ``b``; NULL is the lowest value."""
    out = F.lit(False)
    for x, y, desc in reversed(list(zip(a, b, descending))):
        x, y = (y, x) if desc else (x, y)
        less = F.coalesce(x < y, x.isNull() & y.isNotNull())
        out = less | (x.eqNullSafe(y) & out)
    return out


def range_of(keys: DataFrame, cuts: list[Row], partition_by: Sequence[str], order_by: OrderSpec) -> Column:
    """Number of splitters at or before a row's key. Two levels of comparisons: about twice the square root of their
    number per row."""
    if not cuts:
        return F.lit(0)
    cols = [*partition_by, *[c for c, _ in order_by]]
    descending = [False] * len(partition_by) + [d for _, d in order_by]
    kinds = [keys.schema[c].dataType for c in cols]
    key = [F.col(c) for c in cols]

    def literal(row: Row) -> Column:
        return F.struct(*[F.lit(v).cast(kind).alias(f"f{i}") for i, (v, kind) in enumerate(zip(row, kinds))])

    def passed(splits: Column) -> Column:
        return F.size(F.filter(splits, lambda s: ~_before(key, [s[f"f{i}"] for i in range(len(cols))], descending)))

    width = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    group = passed(F.array(*[literal(g[0]) for g in groups]))  # groups whose first splitter is at or before the key
    inside = F.element_at(F.array(*[F.array(*[literal(r) for r in g]) for g in groups]), group)
    return F.when(group > 0, (group - 1) * width + passed(inside)).otherwise(0)


def prefix_counts(keys: DataFrame, partition_by: Sequence[str], order_by: OrderSpec,
                  values: Sequence[str]) -> DataFrame:
    """For each row of ``keys`` (unique on partition+order columns), add ``before_<v>``: the sum of the
    non-negative column ``v`` over all rows that sort strictly before it inside the same partition."""
    n_parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = _sort_exprs(partition_by, order_by)
    cuts = splitters(keys, partition_by, order_by, n_parts)
    # both uses below read one shuffle if the planner reuses it, and agree on the ranges if it does not
    ranged = keys.withColumn("_pid", range_of(keys, cuts, partition_by, order_by)).repartition(n_parts, "_pid")
    inside = Window.partitionBy("_pid").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_loc_{v}") for v in values])
    totals = ranged.groupBy("_pid").agg(*[F.sum(v).alias(f"_tot_{v}") for v in values])
    # one row per range: a window over it is tiny and the result is safe to broadcast
    before_parts = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_pid").alias("_opid"), *[F.coalesce(F.sum(f"_tot_{v}").over(before_parts), F.lit(0))
                                                            .alias(f"_off_{v}") for v in values])
    glob = local.join(F.broadcast(offsets), F.col("_pid") == F.col("_opid")).select(
        *[local[c] for c in keys.columns], *[(F.col(f"_off_{v}") + F.col(f"_loc_{v}")).alias(f"_g_{v}") for v in values])
    if not partition_by:
        return glob.select(*keys.columns, *[F.col(f"_g_{v}").alias(f"before_{v}") for v in values])
    starts = glob.groupBy(*partition_by).agg(*[F.min(f"_g_{v}").alias(f"_s_{v}") for v in values])
    joined = _attach(glob, starts, partition_by, [f"_s_{v}" for v in values])
    return joined.select(*keys.columns,
                         *[(F.col(f"_g_{v}") - F.col(f"_s_{v}")).alias(f"before_{v}") for v in values])


def rank_within(df: DataFrame, partition_by: Sequence[str] = (), order_by: OrderSpec = (),
                tie_break: Sequence[str] = (), row_number: str | None = None, rank: str | None = None,
                dense_rank: str | None = None) -> DataFrame:
    """Add ROW_NUMBER / RANK / DENSE_RANK columns (any subset) computed without a hot window partition.

    ``order_by`` is a list of (column, descending). ROW_NUMBER orders by ``order_by`` then ``tie_break``
    (ascending; should be unique within a partition, e.g. a primary key)."""
    out = df
    keycols = list(partition_by) + [c for c, _ in order_by]
    if rank or dense_rank:
        keys = df.groupBy(*keycols).agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
        ranked = prefix_counts(keys, partition_by, order_by, ["_n", "_one"])
        cols = []
        if rank:
            cols.append((F.col("before__n") + 1).cast("int").alias(rank))
        if dense_rank:
            cols.append((F.col("before__one") + 1).cast("int").alias(dense_rank))
        out = _attach(out, ranked.select(*keycols, *cols), keycols, [n for n in (rank, dense_rank) if n])
    if row_number:
        full = list(order_by) + [(c, False) for c in tie_break]
        keys = df.select(*partition_by, *[c for c, _ in full]).withColumn("_one", F.lit(1))
        numbered = prefix_counts(keys, partition_by, full, ["_one"])
        allkeys = list(partition_by) + [c for c, _ in full]
        r = numbered.select(*allkeys, (F.col("before__one") + 1).cast("int").alias(row_number))
        out = _attach(out, r, allkeys, [row_number])
    return out


def top_k_ranked(df: DataFrame, order_by: OrderSpec, tie_break: Sequence[str], k: int,
                 rank: str = "rank", rank_on: int | None = None) -> DataFrame:
    """First ``k`` rows in order, with their global RANK over the first ``rank_on`` order columns (default:
    all). Exact: a row's rank depends only on rows ahead of it, all of which are inside the top k. The window
    runs over the k kept rows only."""
    sort = _sort_exprs((), order_by) + [F.col(c).asc() for c in tie_break]
    top = df.orderBy(*sort).limit(k)
    w = Window.orderBy(*_sort_exprs((), list(order_by)[:rank_on]))
    return top.withColumn(rank, F.rank().over(w))


LAG_ROWS = 1_000_000  # rows of a partition that one window may hold


def lag_within(df: DataFrame, partition_by: Sequence[str], order_by: OrderSpec, column: str,
               out: str, limit: int | None = None) -> DataFrame:
    """LAG(column) OVER (PARTITION BY ... ORDER BY ...) without a large per-partition window.

    ``order_by`` must make rows unique inside a partition (end it with a primary key). Partitions of up to ``LAG_ROWS``
    rows take a window: what one task holds of a partition is bounded. The few larger ones, at most a ``LAG_ROWS``-th of
    the rows in number, are named by one count; their rows are numbered by ``prefix_counts``, and the previous row is found
    by an equi-join on (partition, position - 1), whose key is unique, so a partition holding a third of the rows is still
    spread over all tasks."""
    sizes = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("_rows"))
    large = sizes.filter(F.col("_rows") > (LAG_ROWS if limit is None else limit)).select(*partition_by).collect()
    if not large:
        return _lag_window(df, partition_by, order_by, column, out)
    named = F.broadcast(df.sparkSession.createDataFrame(large, df.select(*partition_by).schema).select(
        *[F.col(c).alias("_k_" + c) for c in partition_by]))
    on = _null_safe_on(df, named, partition_by, "_k_")
    small = _lag_window(df.join(named, on, "left_anti"), partition_by, order_by, column, out)
    return small.unionByName(_lag_spread(df.join(named, on, "left_semi"), partition_by, order_by, column, out))


def _lag_window(df: DataFrame, partition_by: Sequence[str], order_by: OrderSpec, column: str, out: str) -> DataFrame:
    """``lag_within`` by a window. Rows that share a key are each paired with the previous value of every one of them, as the
    join on the key in ``_lag_spread`` does; the second window is over the same shuffle. ``_l_pos`` is the position of the row
    that the value comes from, 0 before the first."""
    rows = Window.partitionBy(*partition_by).orderBy(*_sort_exprs((), order_by))
    lag = F.struct((F.row_number().over(rows) - 1).alias("_l_pos"), F.lag(column).over(rows).alias("v"))
    same_key = Window.partitionBy(*partition_by, *[c for c, _ in order_by])
    told = df.withColumn("_lag", lag).withColumn("_lags", F.collect_list("_lag").over(same_key))
    return told.select(*df.columns, F.explode("_lags").alias("_lag")).select(*df.columns, F.col("_lag.v").alias(out))


def _lag_spread(df: DataFrame, partition_by: Sequence[str], order_by: OrderSpec, column: str, out: str) -> DataFrame:
    """``lag_within`` by positions. Only the key and the lagged column are numbered; the rows' other columns meet the
    result once, on the key."""
    cols = [*partition_by, *[c for c, _ in order_by]]
    keys = df.select(*cols, F.col(column).alias("_lagged"), F.lit(1).alias("_one"))
    numbered = prefix_counts(keys, partition_by, order_by, ["_one"])
    prev = numbered.select(*[F.col(c).alias("_l_" + c) for c in partition_by],
                           (F.col("before__one") + 1).alias("_l_pos"), F.col("_lagged").alias(out))
    cond = numbered["before__one"] == prev["_l_pos"]
    for c in partition_by:
        cond = cond & numbered[c].eqNullSafe(prev["_l_" + c])
    lagged = numbered.join(prev, cond, "left").select(*[numbered[c] for c in cols], prev[out])
    return _attach(df, lagged, cols, [out])
