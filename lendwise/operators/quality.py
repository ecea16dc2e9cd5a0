"""Data-quality checks C-01 ... C-08 driven by the constraint declarations in ``sources.schemas``.

Each check is a batch job over whole tables returning one summary row per constraint (so a clean database
still yields a full report), plus row-level helpers that return the offending rows themselves.
Every per-table step is an aggregation or an anti join on the constrained key; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.functions import as_timestamp
from lendwise.sources.schemas import TABLES
from lendwise.sources.tables import Tables

BIG = "bigint"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _key_summary(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """One row about a key: rows, rows with a NULL part, keys used more than once, rows carrying them. Grouped on the
    native key columns, so a hot key collapses map-side; only the one-row summaries of the tables are put together."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    n, real = F.col("_n"), ~any_null
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0)
    return counted.agg(F.coalesce(F.sum(n), zero).cast(BIG).alias("total_rows"),
                       F.coalesce(F.sum(F.when(any_null, n)), zero).cast(BIG).alias("null_keys"),
                       F.count(F.when(real & (n > 1), 1)).alias("duplicate_keys"),
                       F.coalesce(F.sum(F.when(real & (n > 1), n)), zero).cast(BIG).alias("duplicate_rows"))


def _key_summaries(t: Tables, specs: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    return _union([_key_summary(t[n], cols).select(F.lit(n).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"), "*")
                   for n, cols in specs])


def c01_pk_violations(t: Tables) -> DataFrame:
    """Single-column primary keys: rows, NULL keys, keys used more than once, rows carrying them."""
    return _key_summaries(t, [(n, s.pk) for n, s in TABLES.items() if len(s.pk) == 1])


def c02_composite_pk(t: Tables) -> DataFrame:
    """Composite primary keys (book-subject, book-author): rows, NULL keys, repeated keys."""
    return _key_summaries(t, [(n, s.pk) for n, s in TABLES.items() if len(s.pk) > 1])


def pk_violation_rows(t: Tables, table: str) -> DataFrame:
    """Row-level: rows whose primary key is NULL or shared with another row."""
    pk = list(TABLES[table].pk)
    df = t[table]
    dup = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    nulls = df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk]))
    return df.join(dup, pk, "left_semi").unionByName(nulls)


def fk_orphan_rows(t: Tables, child: str, column: str, parent: str, parent_column: str) -> DataFrame:
    """Row-level: child rows whose non-NULL reference has no parent row (NULL references pass)."""
    parents = t[parent].select(F.col(parent_column).alias(column))
    return t[child].filter(F.col(column).isNotNull()).join(parents, column, "left_anti")


# every declared reference: (child, column, parent, parent column), and its place among those to the same parent key
_REFERENCES = [(child, col, parent, pcol) for child, spec in TABLES.items() for col, parent, pcol in spec.fks]
_DOMAINS = sorted({(parent, pcol) for _, _, parent, pcol in _REFERENCES})
_SLOTS = max(sum((p, c) == d for _, _, p, c in _REFERENCES) for d in _DOMAINS)


def _slot(ref: tuple[str, str, str, str]) -> tuple[int, int]:
    """(domain, slot) of a reference."""
    same = [r for r in _REFERENCES if r[2:] == ref[2:]]
    return _DOMAINS.index(ref[2:]), same.index(ref)


def _key_uses(t: Tables) -> DataFrame:
    """(domain, slot, k or s) for every key that a row holds or refers to; slot -1 is the parent's own key. One pass over
    each table, whatever the number of its references. Numeric keys are in ``k``, text keys in ``s``."""
    frames = []
    for name, spec in TABLES.items():
        uses = [(d, -1, pcol) for d, (parent, pcol) in enumerate(_DOMAINS) if parent == name]
        uses += [(*_slot(r), r[1]) for r in _REFERENCES if r[0] == name]
        if not uses:
            continue
        each = F.array(*[F.struct(
            F.lit(d).alias("domain"), F.lit(slot).alias("slot"),
            (F.lit(None) if spec.col(c).dtype.typeName() == "string" else F.col(c)).cast(BIG).alias("k"),
            (F.col(c) if spec.col(c).dtype.typeName() == "string" else F.lit(None)).cast("string").alias("s"))
            for d, slot, c in uses])
        frames.append(t[name].select(F.explode(each).alias("u")).select("u.*").filter("k IS NOT NULL OR s IS NOT NULL"))
    return _union(frames)


def _per_reference(sums: DataFrame, *names: str) -> DataFrame:
    """One row per declared reference from one row per domain with arrays over the slots; zeros for unused domains."""
    refs = F.explode(F.array(*[F.struct(
        F.lit(child).alias("child_table"), F.lit(col).alias("child_column"), F.lit(parent).alias("parent_table"),
        F.lit(pcol).alias("parent_column"), F.lit(d).alias("domain"), F.lit(slot).alias("slot"))
        for (child, col, parent, pcol), (d, slot) in ((r, _slot(r)) for r in _REFERENCES)])).alias("r")
    every = sums.sparkSession.range(1).select(refs).select("r.*")
    zero = F.lit(0).cast(BIG)
    return every.join(sums, "domain", "left").select(
        "child_table", "child_column", "parent_table", "parent_column",
        *[F.coalesce(F.get(F.col(n), F.col("slot")), zero).cast(BIG).alias(n) for n in names])


def _key_counts(t: Tables) -> DataFrame:
    """One row per (domain, key): whether a parent row carries it, and how often each reference uses it (n0, n1, ...). A
    hot key collapses map-side, and no child row meets a join."""
    counts = [F.count(F.when(F.col("slot") == i, 1)).alias(f"n{i}") for i in range(_SLOTS)]
    return _key_uses(t).groupBy("domain", "k", "s").agg(F.max(F.col("slot") == -1).alias("known"), *counts)


def _sums(keys: DataFrame, of: Callable[[Column], Column], only: Column) -> Column:
    """Array over the slots: the sum of ``of(n_i)`` over the keys that ``only`` picks."""
    return F.array(*[F.sum(F.when(only, of(F.col(f"n{i}"))).otherwise(0)) for i in range(_SLOTS)])


def c03_fk_orphans(t: Tables) -> DataFrame:
    """Foreign keys: checked (non-NULL) references and those without a parent row, one line per reference. Each table is
    read once for all its references, and all tables meet in one grouping on (parent key's domain, key)."""
    keys = _key_counts(t)
    sums = keys.groupBy("domain").agg(_sums(keys, lambda n: n, F.lit(True)).alias("checked_rows"),
                                      _sums(keys, lambda n: n, ~F.col("known")).alias("orphan_rows"))
    return _per_reference(sums, "checked_rows", "orphan_rows")


def c03_orphan_keys(t: Tables) -> DataFrame:
    """Foreign keys: distinct keys that a reference uses and those that no parent row carries, from the same grouping."""
    keys, one = _key_counts(t), lambda n: F.when(n > 0, 1).otherwise(0)
    sums = keys.groupBy("domain").agg(_sums(keys, one, F.lit(True)).alias("used_keys"),
                                      _sums(keys, one, ~F.col("known")).alias("orphan_keys"))
    return _per_reference(sums, "used_keys", "orphan_keys")


def c04_unique_violations(t: Tables) -> DataFrame:
    """UNIQUE columns: several NULLs are allowed; non-NULL values used more than once are violations."""
    return _union([_key_summary(t[n].filter(F.col(col).isNotNull()), (col,)).select(
        F.lit(n).alias("table_name"), F.lit(col).alias("column_name"), F.col("total_rows").alias("non_null_rows"),
        F.col("duplicate_keys").alias("duplicate_values"), "duplicate_rows")
        for n, spec in TABLES.items() for col in spec.unique])


def c05_isbn_length(t: Tables) -> DataFrame:
    """CHECK (CHAR_LENGTH(isbn) = 13) on books (a NULL isbn does not violate a CHECK)."""
    bad = F.char_length("isbn") != 13
    return t.book.agg(F.count("isbn").alias("checked_rows"),
                      F.count(F.when(bad, 1)).alias("violations")).select(
        F.lit("book").alias("table_name"), F.lit("isbn").alias("column_name"), "checked_rows", "violations")


def c06_not_null(t: Tables) -> DataFrame:
    """NULL count of every NOT NULL column, one aggregation pass per table."""
    rows = []
    for name, spec in TABLES.items():
        cols = list(spec.not_null)
        agg = t[name].agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
        rows.append(agg.unpivot([], cols, "column_name", "null_rows")
                    .select(F.lit(name).alias("table_name"), "column_name", F.col("null_rows").cast(BIG)))
    return _union(rows)


def c07_apply_defaults(df: DataFrame, table: str, now) -> DataFrame:
    """Fill declared defaults into missing values: balance 0.00, created_at / requested_at = ``now``."""
    spec = TABLES[table]
    out = df
    for col, default in spec.defaults.items():
        value = as_timestamp(now) if default == "now" else F.lit(default).cast(spec.col(col).dtype)
        out = out.withColumn(col, F.coalesce(F.col(col), value))
    return out


def c07_defaults(t: Tables, now) -> DataFrame:
    """Every declared default applied: table, row key, column and the value it then has, as text."""
    rows = []
    for name, spec in TABLES.items():
        if spec.defaults:
            filled = c07_apply_defaults(t[name], name, now)
            rows += [filled.select(F.lit(name).alias("table_name"), F.col(spec.pk[0]).cast("string").alias("row_key"),
                                   F.lit(col).alias("column_name"), F.col(col).cast("string").alias("value"))
                     for col in spec.defaults]
    return _union(rows)


def c08_type_conformance(raw: Tables) -> DataFrame:
    """Raw text rows against the declared types: VARCHAR(n)/CHAR(n) lengths, and for every other column whether the
    text converts to its type (an amount beyond DECIMAL(8,2) does not). One line per column."""
    rows = []
    for name, spec in TABLES.items():
        checks = []
        for c in spec.columns:
            if c.max_len:
                checks.append((c.name, f"max_length {c.max_len}", F.char_length(c.name) > c.max_len))
            else:
                checks.append((c.name, c.dtype.simpleString(), F.col(c.name).isNotNull() & F.col(c.name).try_cast(c.dtype).isNull()))
        agg = raw[name].agg(*[F.count(F.when(cond, 1)).alias(f"v{i}") for i, (_, _, cond) in enumerate(checks)],
                            *[F.count(col).alias(f"n{i}") for i, (col, _, _) in enumerate(checks)])
        # one aggregation pass per table, then one output row per check
        per_check = F.explode(F.array(*[
            F.struct(F.lit(col).alias("column_name"), F.lit(rule).alias("rule"),
                     F.col(f"n{i}").alias("checked_rows"), F.col(f"v{i}").alias("violations"))
            for i, (col, rule, _) in enumerate(checks)])).alias("c")
        rows.append(agg.select(per_check).select(F.lit(name).alias("table_name"), "c.*"))
    return _union(rows)
