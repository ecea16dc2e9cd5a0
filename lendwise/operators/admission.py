"""Admission and update rules (T-01 ... T-12) and patron registration (K-02) as batch jobs.

The source rules run row by row before each insert and see the rows inserted earlier. Here a whole batch is
split into accepted and rejected rows with a reason. For the counting rules (one open loan per copy, one
active reservation per patron/book/branch, concurrent sessions per resource) the set form is:

    accepted  <=>  existing_active(key) + prior_active(key) < limit

where ``prior_active`` counts the earlier batch rows (batch order = event time, then id) of the same key that
are active and pass the row-local checks. Counting raw rather than accepted predecessors is exact: while the
count is below the limit every earlier active row was accepted, and once it reaches the limit every later row
is rejected. With a limit of one, ``prior_active`` is zero exactly up to the key's first active row, a minimum per key;
for larger limits it is a per-key running count computed by ``ranking.prefix_counts`` (range partitioned, no hot window
partition). ``existing_active`` is an aggregate of the target table joined on the key.
The reference aborts the statement on the first violation; here the default is quarantine with a reason and
``strict=True`` raises instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.functions import as_timestamp
from lendwise.operators.ranking import prefix_counts
from lendwise.sources.schemas import FINE_STATUSES_ALLOWED, PATRON_TYPES, RESERVATION_INACTIVE

# Rejection messages; up to MSG_TERM_DATES they are fixed values, but for MSG_SESSION_LIMIT, which names no limit.
MSG_COPY_ON_LOAN = "Cannot borrow: This copy is already on loan. Please return it first."
MSG_LOAN_DATES = "Invalid loan dates: due_ts must be after loan_ts."
MSG_RETURN_DATE = "Invalid return date: return_ts must be >= loan_ts."
MSG_COPY_CHANGED = "Cannot change copy_id of an existing loan."
MSG_PATRON_CHANGED = "Cannot change patron_id of an existing loan."
MSG_NO_LOAN = "Cannot create fine: Loan does not exist."
MSG_FINE_PATRON = "Fine patron_id must match the loan patron_id."
MSG_FINE_AMOUNT = "Fine amount must be greater than 0."
MSG_FINE_STATUS = "Invalid fine status. Must be one of: Paid, Unpaid, Pending, Waived."
MSG_RESERVATION = ("Cannot create reservation: Patron already has an active reservation for this book at this "
                   "branch.")
MSG_SESSION_LIMIT = "Cannot create access session: Concurrent access limit has been reached for this resource."
MSG_SESSION_END = "Invalid end_time: end_time must be >= start_time."
MSG_BARCODE = "Barcode cannot be an empty string. Use NULL if no barcode."
MSG_LICENSE_DATES = "Invalid license dates: end_date must be after start_date."
MSG_LICENSE_LIMIT = "Concurrent limit must be greater than 0."
MSG_TERM_DATES = "Invalid term dates: end_date must be after start_date."
MSG_PATRON_TYPE = "Unknown patron type"
MSG_PATRON_MISSING = "first_name, last_name and patron_type are required"
MSG_NO_ROW = "No existing row to update."
MSG_ADDRESS_TEXT = "address_id is not a number"
MSG_ADDRESS_UNKNOWN = "address_id names no stored address"
MSG_EMAIL_USED = "email is already registered"


class AdmissionError(ValueError):
    pass


def _finish(df: DataFrame, reason: Column, columns: Sequence[str], strict: bool) -> DataFrame:
    out = df.select(*columns, reason.alias("reason")).withColumn("accepted", F.col("reason").isNull())
    if strict:
        first = out.filter(~F.col("accepted")).select("reason").limit(1).collect()
        if first:
            raise AdmissionError(first[0]["reason"])
    return out


def _limited(batch: DataFrame, key: Sequence[str], order_by: Sequence[tuple[str, bool]], active: Column,
             local_fail: Column, existing_active: DataFrame, limit: Column) -> DataFrame:
    """Adds ``_over``: True when existing + earlier active batch rows of the key reach the limit."""
    key_ok = F.lit(True)
    for k in key:
        key_ok = key_ok & F.col(k).isNotNull()
    b = batch.withColumn("_local_fail", F.coalesce(local_fail, F.lit(False)))
    b = b.withColumn("_contrib", F.when(key_ok & F.coalesce(active, F.lit(False)) & ~F.col("_local_fail"), 1)
                     .otherwise(0))
    b = prefix_counts(b, key, order_by, ["_contrib"])
    b = b.join(existing_active, list(key), "left")
    used = F.coalesce(F.col("_existing"), F.lit(0)) + F.col("before__contrib")
    return b.withColumn("_over", F.coalesce(limit.isNotNull() & (used >= limit), F.lit(False)))


def _single(batch: DataFrame, key: Sequence[str], order_by: Sequence[str], active: Column, local_fail: Column,
            existing_active: DataFrame) -> DataFrame:
    """``_limited`` for a limit of one: a row is over if the key is in use already or the row comes after the key's
    first active batch row. That row is a minimum per key, so a hot key collapses map-side and nothing is ranked."""
    key_ok = F.lit(True)
    for k in key:
        key_ok = key_ok & F.col(k).isNotNull()
    place = F.struct(*[F.col(c) for c in order_by])
    b = batch.withColumn("_local_fail", F.coalesce(local_fail, F.lit(False)))
    first = b.filter(key_ok & F.coalesce(active, F.lit(False)) & ~F.col("_local_fail")).groupBy(*key).agg(
        F.min(place).alias("_first"))
    b = b.join(first, list(key), "left").join(existing_active, list(key), "left")
    return b.withColumn("_over", F.coalesce(F.col("_existing") >= 1, F.lit(False)) | F.coalesce(place > F.col("_first"), F.lit(False)))


def _existing_counts(existing: DataFrame | None, key: Sequence[str], active: Column,
                     template: DataFrame) -> DataFrame:
    src = existing if existing is not None else template.limit(0)
    return src.filter(active).groupBy(*key).agg(F.count(F.lit(1)).alias("_existing"))


# --------------------------------------------------------------------------------------------- T-01, T-02

def t01_admit_loans(batch: DataFrame, existing: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """New loans: rejected when the copy already has an open loan (in the table or accepted earlier in the
    batch), or when due_ts <= loan_ts. A row that fails is not inserted, so it blocks nothing."""
    cols = batch.columns
    active = F.col("return_ts").isNull()
    ex = _existing_counts(existing, ["copy_id"], active, batch)
    b = _single(batch, ["copy_id"], ["loan_ts", "loan_id"], active, F.col("due_ts") <= F.col("loan_ts"), ex)
    reason = F.when(F.col("_over"), MSG_COPY_ON_LOAN).when(F.col("_local_fail"), MSG_LOAN_DATES)
    return _finish(b, reason, cols, strict)


def t02_validate_loan_updates(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Loan updates: a first return must not precede loan_ts; copy_id and patron_id are immutable.
    (The rule against clearing return_ts sits behind ``return_ts IS NOT NULL`` and can never fire.)"""
    o = old.select(*[F.col(c).alias("old_" + c) for c in old.columns])
    j = new.join(o, new.loan_id == o.old_loan_id, "left")
    reason = (F.when(F.col("old_loan_id").isNull(), MSG_NO_ROW)
              .when(F.col("return_ts").isNotNull() & F.col("old_return_ts").isNull()
                    & (F.col("return_ts") < F.col("loan_ts")), MSG_RETURN_DATE)
              .when(F.coalesce(F.col("old_copy_id") != F.col("copy_id"), F.lit(False)), MSG_COPY_CHANGED)
              .when(F.coalesce(F.col("old_patron_id") != F.col("patron_id"), F.lit(False)), MSG_PATRON_CHANGED))
    return _finish(j, reason, new.columns, strict)


# --------------------------------------------------------------------------------------------- T-03, T-04

def t03_admit_fines(batch: DataFrame, loans: DataFrame, strict: bool = False) -> DataFrame:
    """New fines: the loan must exist and belong to the same patron, amount > 0, status in the allowed list
    (which omits 'Payment Pending'). The first failing rule gives the reason."""
    lp = loans.select(F.col("loan_id").alias("_lid"), F.col("patron_id").alias("_lpatron"))
    j = batch.join(lp, batch.loan_id == lp._lid, "left")
    reason = (F.when(F.col("_lid").isNull(), MSG_NO_LOAN)
              .when(F.coalesce(F.col("_lpatron") != F.col("patron_id"), F.lit(False)), MSG_FINE_PATRON)
              .when(F.coalesce(F.col("amount") <= 0, F.lit(False)), MSG_FINE_AMOUNT)
              .when(F.coalesce(~F.col("status").isin(*FINE_STATUSES_ALLOWED), F.lit(False)), MSG_FINE_STATUS))
    return _finish(j, reason, batch.columns, strict)


def t04_admit_reservations(batch: DataFrame, existing: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """New reservations: rejected while the patron has an active (not Fulfilled/Cancelled) reservation for the
    same book at the same branch. The incoming row's own status is not examined."""
    key = ["patron_id", "isbn", "branch_id"]
    active = ~F.col("status").isin(*RESERVATION_INACTIVE)
    ex = _existing_counts(existing, key, active, batch)
    b = _single(batch, key, ["created_at", "reservation_id"], active, F.lit(False), ex)
    return _finish(b, F.when(F.col("_over"), MSG_RESERVATION), batch.columns, strict)


# --------------------------------------------------------------------------------------------- T-05, T-06

def t05_admit_sessions(batch: DataFrame, eresource: DataFrame, license_: DataFrame,
                       existing: DataFrame | None = None, *, now, strict: bool = False) -> DataFrame:
    """New e-resource sessions: rejected when the resource's open sessions reach its license's concurrent
    limit (counted per resource, as the rule does; no license or no limit never rejects). A missing
    start_time is set to ``now``."""
    limits = (eresource.select("resource_id", "license_id")
              .join(license_.select("license_id", "concurrent_limit"), "license_id")
              .select("resource_id", F.col("concurrent_limit").alias("_limit")))
    b0 = batch.withColumn("start_time", F.coalesce(F.col("start_time"), as_timestamp(now))).join(limits, "resource_id", "left")
    active = F.col("end_time").isNull()
    ex = _existing_counts(existing, ["resource_id"], active, batch)
    b = _limited(b0, ["resource_id"], [("start_time", False), ("session_id", False)], active, F.lit(False), ex,
                 F.col("_limit"))
    return _finish(b, F.when(F.col("_over"), MSG_SESSION_LIMIT), batch.columns, strict)


def t06_validate_session_updates(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Session updates: an end_time before start_time is rejected."""
    o = old.select(F.col("session_id").alias("_old_id"))
    j = new.join(o, new.session_id == o._old_id, "left")
    reason = (F.when(F.col("_old_id").isNull(), MSG_NO_ROW)
              .when(F.col("end_time").isNotNull() & (F.col("end_time") < F.col("start_time")), MSG_SESSION_END))
    return _finish(j, reason, new.columns, strict)


# --------------------------------------------------------------------------------------------- T-07 ... T-12

def t07_copy_barcode(batch: DataFrame, strict: bool = False) -> DataFrame:
    """New copies: an empty-string barcode is rejected (NULL is allowed)."""
    return _finish(batch, F.when(F.col("barcode") == "", MSG_BARCODE), batch.columns, strict)


def t08_patron_type_warning(batch: DataFrame) -> DataFrame:
    """Patron types outside the five known ones get a warning; such rows are never rejected."""
    warn = F.when(~F.coalesce(F.col("patron_type").isin(*PATRON_TYPES), F.lit(False)), MSG_PATRON_TYPE)
    return batch.withColumn("warning", warn)


def t09_license_insert(batch: DataFrame, strict: bool = False) -> DataFrame:
    """Licenses: end_date must be after start_date, then concurrent_limit must be positive."""
    reason = (F.when(F.col("end_date") <= F.col("start_date"), MSG_LICENSE_DATES)
              .when(F.col("concurrent_limit") <= 0, MSG_LICENSE_LIMIT))
    return _finish(batch, reason, batch.columns, strict)


t10_license_update = t09_license_insert


def t11_term_insert(batch: DataFrame, strict: bool = False) -> DataFrame:
    """Terms: when both dates are present, end_date must be after start_date."""
    both = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    reason = F.when(both & (F.col("end_date") <= F.col("start_date")), MSG_TERM_DATES)
    return _finish(batch, reason, batch.columns, strict)


t12_term_update = t11_term_insert


# --------------------------------------------------------------------------------------------- K-02

def k02_append_patrons(existing: DataFrame, batch: DataFrame, address: DataFrame | None = None,
                       order_by: str = "seq") -> DataFrame:
    """Register new patrons: ids continue after the largest existing id (1 for an empty table), in batch order, for
    the accepted rows; balance 0.00; a blank address id becomes NULL. A row is rejected if it lacks first name, last
    name or type (blank text counts as missing), if its address id is no number or names no row of ``address``, or if
    its e-mail is used by a stored patron or an earlier acceptable row. Returns the batch with the new id,
    ``accepted`` and ``reason``."""
    def given(c):
        return F.col(c).isNotNull() & (F.col(c) != "")

    missing = ~(given("first_name") & given("last_name") & given("patron_type"))
    text = F.trim(F.col("address_id").cast("string"))
    b = batch.withColumn("_addr", F.when(text != "", text.try_cast("bigint")))
    b = b.withColumn("_local", F.when(missing, MSG_PATRON_MISSING).when((text != "") & F.col("_addr").isNull(), MSG_ADDRESS_TEXT))
    if address is not None:
        known = address.select(F.col("address_id").alias("_addr"), F.lit(True).alias("_known")).distinct()
        b = b.join(known, "_addr", "left").withColumn("_local", F.coalesce(
            "_local", F.when(F.col("_addr").isNotNull() & F.col("_known").isNull(), MSG_ADDRESS_UNKNOWN)))
    # an e-mail is free for the first acceptable row that brings it, unless a stored patron has it
    taken = existing.select("email").union(batch.select("email").limit(0)).filter("email IS NOT NULL").distinct()
    first = b.filter(F.col("_local").isNull() & F.col("email").isNotNull()).groupBy("email").agg(
        F.min(order_by).alias("_first")).join(taken.withColumn("_stored", F.lit(True)), "email", "left")
    b = b.join(first, "email", "left").withColumn("_reason", F.coalesce("_local", F.when(
        F.col("_stored") | (F.col(order_by) != F.col("_first")), MSG_EMAIL_USED)))
    b = b.withColumn("_take", F.when(F.col("_reason").isNull(), 1).otherwise(0))
    top = existing.agg(F.coalesce(F.max("patron_id"), F.lit(0)).cast("bigint").alias("_base"))  # one row
    numbered = prefix_counts(b, (), [(order_by, False)], ["_take"]).crossJoin(top)
    return numbered.select(
        F.when(F.col("_take") == 1, F.col("_base") + F.col("before__take") + 1).alias("patron_id"),
        "first_name", "last_name", "email", "patron_type", F.col("_addr").alias("address_id"),
        F.lit(0).cast("decimal(8,2)").alias("balance"), F.col(order_by),
        F.col("_reason").alias("reason")).withColumn("accepted", F.col("reason").isNull())
