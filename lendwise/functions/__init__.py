"""Column-level helpers (F-01 ... F-18). All are built-in Spark expressions: they stay inside codegen."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- F-01 ordered distinct concatenation

def ordered_distinct_concat(value, order_by=None, sep: str = ", ") -> Column:
    """Aggregate: distinct ``value``s joined by ``sep``, ordered by ``order_by`` (default: the value itself).

    NULL values are skipped and an all-NULL/empty group gives NULL (not ''), like GROUP_CONCAT. When the
    order key differs from the value, (order key..., value) structs are collected as a set, sorted, mapped
    back to the value and de-duplicated on the value, keeping the first position. Partial aggregation
    de-duplicates map-side, so the shuffle carries at most one entry per distinct value and group.
    Value and order keys are handled as plain (binary-collated) text: set aggregation does not accept
    collated strings.
    """
    value = _c(value).cast("string")
    if order_by is None:
        arr = F.array_sort(F.collect_set(value))
    else:
        keys = [_c(k).cast("string") for k in (order_by if isinstance(order_by, (list, tuple)) else [order_by])]
        fields = [k.alias(f"k{i}") for i, k in enumerate(keys)] + [value.alias("v")]
        packed = F.when(value.isNotNull(), F.struct(*fields))
        arr = F.array_distinct(F.transform(F.array_sort(F.collect_set(packed)), lambda s: s["v"]))
    return F.when(F.size(arr) > 0, F.array_join(arr, sep))


# ---------------------------------------------------------------- dates (F-05 ... F-13)

def as_timestamp(as_of=None) -> Column:
    """Literal for an explicit 'now' (date means midnight), as a zone-less wall-clock timestamp. None is the time at
    which the query runs (one value for the whole query), in the session's time zone."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, dt.datetime):
        return F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("date").cast("timestamp_ntz")


def as_date(as_of=None) -> Column:
    """Literal for an explicit 'today' (CURDATE); None is the date on which the query runs."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, dt.datetime):
        return F.lit(as_of.date().isoformat()).cast("date")
    return F.lit(str(as_of)).cast("date")


def month_key(ts) -> Column:
    """'%Y-%m' of a timestamp."""
    return F.date_format(_c(ts), "yyyy-MM")


def year_key(ts) -> Column:
    return F.date_format(_c(ts), "yyyy")


def days_between(end, start) -> Column:
    """DATEDIFF on the date parts only."""
    return F.datediff(_c(end), _c(start))


def month_start(month_text) -> Column:
    """STR_TO_DATE(CONCAT(m,'-01'),'%Y-%m-%d'); NULL on malformed text."""
    return F.try_to_timestamp(F.concat(_c(month_text), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")


def previous_month_key(month_text) -> Column:
    """Month text of the previous month (DATE_SUB(..., INTERVAL 1 MONTH) clamps the day)."""
    return F.date_format(F.add_months(month_start(month_text), -1), "yyyy-MM")


# ---------------------------------------------------------------- numbers (F-15, P-11)

def exact_avg(x) -> Column:
    """AVG of an integer column as an exact decimal with 4 extra digits (the SQL engine's rule)."""
    return F.avg(_c(x).cast("decimal(20,0)"))


def exact_avg_from_sums(total, count) -> Column:
    """``exact_avg`` recombined from partial sums and counts of pre-aggregated rows: the same decimal division
    (sum as decimal(30,0) by count as decimal(20,0), then decimal(24,4)) that the aggregate itself performs,
    so the result is identical to averaging the raw rows."""
    return F.try_divide(_c(total).cast("decimal(30,0)"), _c(count).cast("decimal(20,0)")).cast("decimal(24,4)")


def pct(part, whole, scale: int = 2) -> Column:
    """ROUND(100.0 * part / whole, scale) on decimals, HALF_UP; NULL when whole is 0 or NULL."""
    ratio = F.try_divide(F.lit(Decimal("100.0")) * _c(part).cast("decimal(20,0)"), _c(whole).cast("decimal(20,0)"))
    return F.round(ratio, scale).cast(f"decimal(18,{scale})")


# ---------------------------------------------------------------- display helpers (F-16 ... F-18)

def display_date(x, fmt: str = "yyyy-MM-dd") -> Column:
    """Template date filter: NULL -> 'N/A'; timestamps/dates formatted; text parsed as
    'yyyy-MM-dd HH:mm:ss' then 'yyyy-MM-dd', otherwise returned unchanged."""
    c = _c(x)
    parsed = F.coalesce(F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd HH:mm:ss")),
                        F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(parsed, fmt), c.cast("string"), F.lit("N/A"))


def display_datetime(x, fmt: str = "yyyy-MM-dd") -> Column:
    """Same filter for a typed date/timestamp column."""
    return F.coalesce(F.date_format(_c(x), fmt), F.lit("N/A"))


def split_list(x, sep: str = ", ") -> Column:
    """Split a concatenated list back into an array (explode it for one row per element)."""
    return F.split(_c(x), re.escape(sep))


def money(x) -> Column:
    """Two-decimal money text; NULL shows as 0.00."""
    return F.coalesce(_c(x).cast("decimal(18,2)"), F.lit(Decimal("0.00")).cast("decimal(18,2)")).cast("string")


def full_name(first="first_name", last="last_name") -> Column:
    """CONCAT(first, ' ', last): NULL when either part is NULL."""
    return F.concat(_c(first), F.lit(" "), _c(last))
