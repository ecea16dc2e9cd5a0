"""Quantified comparisons ``x op ALL (set)`` and ``x op ANY (set)`` for all six operators, under three-valued logic (B-02).

The set, one per group or one for all rows, is reduced to a single aggregate row: smallest, largest, number of values,
number of NULLs, number of distinct values. Order comparisons and ``= ALL`` / ``<> ANY`` follow from that row; ``= ANY`` and
``<> ALL`` (IN and NOT IN) also need to know whether the value itself is in the set, which is an equi-join on the distinct
values, made only for them. No row meets the elements of its set one by one.

Rules: over an empty set ALL is true and ANY is false, whatever the value, NULL included. Otherwise a comparison with a NULL
value, or with a NULL element that could decide, is NULL: ALL is false if a known element fails, else NULL if the value or
an element is NULL, else true; ANY is true if a known element passes, else NULL if the value or an element is NULL, else
false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("=", "<>", "<", "<=", ">", ">=")


def _known(op: str, quantifier: str, x: Column) -> Column:
    """Whether a known element passes (ANY) or all known elements pass (ALL); x is not NULL and some element is known."""
    lo, hi, one, member = F.col("_lo"), F.col("_hi"), F.col("_distinct") == 1, F.col("_member")
    if quantifier == "ALL":
        return {"=": one & (x == lo), "<>": ~member, "<": x < lo, "<=": x <= lo, ">": x > hi, ">=": x >= hi}[op]
    return {"=": member, "<>": ~(one & (x == lo)), "<": x < hi, "<=": x <= hi, ">": x > lo, ">=": x >= lo}[op]


def _verdict(op: str, quantifier: str, x: Column) -> Column:
    every = quantifier == "ALL"
    n, nulls = F.coalesce("_n", F.lit(0)), F.coalesce("_nulls", F.lit(0))
    # without a known element ALL holds and ANY does not, as far as is known
    known = F.when(n - nulls == 0, F.lit(every)).otherwise(_known(op, quantifier, x))
    unknown = x.isNull() | (nulls > 0)
    decided = ~known if every else known
    return (F.when(n == 0, F.lit(every)).when(x.isNotNull() & decided, F.lit(not every))
            .when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(every)))


def quantified(df: DataFrame, value: str, elements: DataFrame, element: str, comparisons: Sequence[tuple[str, str, str]],
               on: Sequence[str] = ()) -> DataFrame:
    """``df`` with a boolean column per comparison (operator, 'ALL' or 'ANY', column name) of ``value`` with the column
    ``element`` of the rows of ``elements`` that agree on the columns ``on`` (all rows without them). A NULL in ``on``
    agrees with nothing, so its set is empty."""
    bad = [c for c in comparisons if c[0] not in OPERATORS or c[1] not in ("ALL", "ANY")]
    if bad:
        raise ValueError(f"not a quantified comparison: {bad[0]}")
    per_value = elements.groupBy(*on, element).agg(F.count(F.lit(1)).alias("_k"))  # a hot value collapses map-side
    keyed = per_value.groupBy(*on) if on else per_value
    summary = keyed.agg(F.min(element).alias("_lo"), F.max(element).alias("_hi"), F.sum("_k").alias("_n"),
                        F.sum(F.when(F.col(element).isNull(), F.col("_k")).otherwise(0)).alias("_nulls"),
                        F.count(element).alias("_distinct"))
    # without groups the summary is one row
    out = df.join(summary, list(on), "left") if on else df.crossJoin(summary)
    if any(op in ("=", "<>") and q == ("ANY" if op == "=" else "ALL") for op, q, _ in comparisons):
        held = per_value.filter(F.col(element).isNotNull()).select(*on, F.col(element).alias("_e"), F.lit(True).alias("_in"))
        cond = F.col("_e") == F.col(value)
        held = held.select(*[F.col(c).alias(f"_on_{c}") for c in on], "_e", "_in")
        for c in on:
            cond = cond & (F.col(c) == F.col(f"_on_{c}"))
        out = out.join(held, cond, "left").withColumn("_member", F.coalesce("_in", F.lit(False)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[_verdict(op, q, F.col(value)).alias(name) for op, q, name in comparisons])
