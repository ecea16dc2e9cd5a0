"""Stand-in inputs for the registered admission and quality keys.

They cut the projected tables into 'already stored' and 'incoming' parts, give an update its previous state, and add
rows that break the declared rules, chosen by key arithmetic; none of them does any of the rules' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwise.sources.schemas import TABLES
from lendwise.sources.tables import Tables

LOAN_SPLIT = "2000-01-01 00:00:00"
EVENT_SPLIT = "2024-01-15 00:00:00"
# sessions: an early cut, so the stored part holds few open sessions and the limits decide inside the batch
SESSION_SPLIT = "2024-01-01 12:00:00"
# micro-batches of the streaming keys
LOAN_CUTS = ["1997-01-01 00:00:00", "1999-06-01 00:00:00"]
EVENT_CUTS = ["2024-01-08 00:00:00", "2024-01-20 00:00:00"]
# accented, upper-case, short, with wildcards, part of an ISBN, without a match, with a run of literals on both sides
NEEDLES = ["WÍDGET", "ar", "g%r", "b_lt", "Ød %ring", "0000012", "no such title", "ll gi"]
FAR = 5 * 10 ** 15  # added to a key: no stored row has it
TWO_FAR = 6 * 10 ** 15


def split_by_time(df, column: str, at: str):
    cut = F.lit(at).cast("timestamp_ntz")
    return df.filter(F.col(column) < cut), df.filter(F.col(column) >= cut)


def _vary(df: DataFrame, key: str, changes: dict[int, tuple[str, Column]], every: int = 50) -> DataFrame:
    """``df`` with a column replaced on the rows whose key has a given remainder."""
    by_col: dict[str, Column] = {}
    for remainder, (col, value) in changes.items():
        old = by_col.get(col, F.col(col))
        by_col[col] = F.when(F.col(key) % every == remainder, value).otherwise(old)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[by_col.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in df.columns])


def loan_batch(t: Tables) -> DataFrame:
    """Incoming loans; some are due a day before they start."""
    late = split_by_time(t.loan, "loan_ts", LOAN_SPLIT)[1]
    return _vary(late, "loan_id", {3: ("due_ts", F.col("loan_ts") - F.expr("INTERVAL 1 DAY"))})


def loans_before_returns(t: Tables):
    """The loan table as it was before any return was recorded."""
    return t.loan.withColumn("return_ts", F.lit(None).cast("timestamp_ntz"))


def loan_updates(t: Tables) -> DataFrame:
    """The loans' new state; some change the copy or the patron, return before the loan, or name no stored loan."""
    return _vary(t.loan, "loan_id", {
        3: ("copy_id", F.col("copy_id") + 1), 7: ("patron_id", F.col("patron_id") + 1),
        11: ("return_ts", F.col("loan_ts") - F.expr("INTERVAL 1 DAY")), 13: ("loan_id", F.col("loan_id") + FAR)})


def fine_batch(t: Tables) -> DataFrame:
    """Incoming fines; some name no loan, another patron, or no amount."""
    return _vary(t.fine, "fine_id", {3: ("loan_id", F.col("loan_id") + FAR), 7: ("patron_id", F.col("patron_id") + 1),
                                     11: ("amount", F.lit(0))})


def sessions_before_end(t: Tables):
    return t.accesssession.withColumn("end_time", F.lit(None).cast("timestamp_ntz"))


def session_updates(t: Tables) -> DataFrame:
    """The sessions' new state; some end before they start or name no stored session."""
    return _vary(t.accesssession, "session_id", {3: ("end_time", F.col("start_time") - F.expr("INTERVAL 1 HOUR")),
                                                 7: ("session_id", F.col("session_id") + FAR)})


def copy_batch(t: Tables) -> DataFrame:
    """Copies, some with an empty barcode."""
    return _vary(t.copy, "copy_id", {3: ("barcode", F.lit(""))})


def patron_batch(t: Tables) -> DataFrame:
    """Patrons, some of a type that is not known."""
    return _vary(t.patron, "patron_id", {3: ("patron_type", F.lit("Visitor"))})


def patron_registrations(t: Tables):
    """Registration form rows (text address id, batch sequence) with the patrons' details: new e-mails but for every
    tenth row; some lack a first name, have an address that is no number, unknown or blank, or share an e-mail."""
    forms = t.patron.select("first_name", "last_name", "email", "patron_type",
                            F.col("address_id").cast("string").alias("address_id"), F.col("patron_id").alias("seq"))
    forms = forms.withColumn("email", F.when(F.col("seq") % 10 != 0, F.concat(F.lit("new-"), "email")).otherwise(F.col("email")))
    return _vary(forms, "seq", {3: ("first_name", F.lit("")), 7: ("address_id", F.lit("x12")),
                                11: ("address_id", F.lit("999999")), 13: ("address_id", F.lit("  ")),
                                17: ("email", F.lit("shared@example.com"))})


def row_number_of(table: str) -> Column:
    """A number per row, from its key."""
    pk = TABLES[table].pk
    number = F.col(pk[0]).cast("bigint")
    return number if len(pk) == 1 else number * 7 + F.col(pk[1])


def with_violations(t: Tables) -> Tables:
    """Every table with rows added that break its declarations. Of each five row numbers: one row again as it is; one
    without its key; one under a new key whose references lead nowhere and whose texts are too long; one under a new
    key with all else missing."""
    return Tables({name: _broken(t[name], name) for name in TABLES})


def _broken(df: DataFrame, name: str) -> DataFrame:
    spec = TABLES[name]
    number, refs = row_number_of(name), {c for c, _, _ in spec.fks}

    def shifted(c, by: int) -> Column:
        if isinstance(c.dtype, T.StringType):
            # a new text key of the same length, or one character too long
            return F.concat(F.lit("5"), F.substring(c.name, 2, 12)) if by == FAR else F.concat(F.lit("6"), F.col(c.name))
        return F.col(c.name) + by

    def far(c) -> Column:
        if c.name in spec.pk or c.name in refs:
            return shifted(c, FAR)
        return F.rpad(F.col(c.name), c.max_len + 1, "x") if c.max_len else F.col(c.name)

    kinds = {1: {}, 2: {spec.pk[0]: F.lit(None)}, 3: {c.name: far(c) for c in spec.columns},
             4: {c.name: shifted(c, TWO_FAR) if c.name in spec.pk else F.lit(None) for c in spec.columns}}
    # one pass: a row goes out as it is, and again in the form of its row number's remainder
    at = F.coalesce(number % 5, F.lit(0))
    rows = df.withColumn("_form", F.explode(F.when(at > 0, F.array(F.lit(0).cast("bigint"), at)).otherwise(
        F.array(F.lit(0).cast("bigint")))))
    cols = []
    for c in spec.columns:
        value = F.col(c.name)
        for remainder, change in kinds.items():
            if c.name in change:
                value = F.when(F.col("_form") == remainder, change[c.name].cast(c.dtype)).otherwise(value)
        cols.append(value.cast(c.dtype).alias(c.name))
    return rows.select(*cols)


def raw_rows(t: Tables) -> Tables:
    """The tables with violations as raw text, as a file would hold them: some amounts are out of range or no number,
    some whole numbers are words."""
    out = {}
    for name, df in with_violations(t).items():
        cols = []
        for c in TABLES[name].columns:
            text = F.col(c.name).cast("string")
            if c.dtype.simpleString() == "decimal(8,2)":
                text = F.when(row_number_of(name) % 7 == 3, "12345678.90").when(row_number_of(name) % 7 == 5, "abc").otherwise(text)
            elif isinstance(c.dtype, T.IntegerType):
                text = F.when(row_number_of(name) % 7 == 3, "many").otherwise(text)
            cols.append(text.alias(c.name))
        out[name] = df.select(*cols)
    return Tables(out)


def license_batch(t: Tables, variant: int = 0):
    """License rows shaped from loans (one per loan): start = loan day, end = due day minus 0..19 days
    (``variant`` shifts the pattern), limit 0..5. Only rows in the license schema; no rule is applied here."""
    shift = F.col("loan_id") % 20 if variant == 0 else (F.col("loan_id") + 7) % 20
    return t.loan.select(F.col("loan_id").alias("license_id"), (F.col("patron_id") % 5 + 1).alias("provider_id"),
                         F.to_date("loan_ts").alias("start_date"),
                         F.date_sub(F.to_date("due_ts"), shift.cast("int")).alias("end_date"),
                         ((F.col("copy_id") + variant) % 6).cast("int").alias("concurrent_limit"))


def term_batch(t: Tables, variant: int = 0):
    """Term rows shaped from loans: start = loan day, end = due day minus 0..15 days; open loans have no
    start date. Only rows in the term schema; no rule is applied here."""
    shift = F.col("loan_id") % 16 if variant == 0 else (F.col("loan_id") + 5) % 16
    return t.loan.select(F.col("loan_id").alias("term_id"), F.lit("Loan term").alias("name"),
                         F.year("loan_ts").alias("year"),
                         F.when(F.col("return_ts").isNotNull(), F.to_date("loan_ts")).alias("start_date"),
                         F.date_sub(F.to_date("due_ts"), shift.cast("int")).alias("end_date"))


def as_changes(rows: DataFrame, item: str, opened_at: str, closed_at: str, opened: dict[str, Column]) -> DataFrame:
    """Each row as it was inserted (``opened`` replaces columns), and for the closed ones an update with its final
    values: change rows with ``op`` and ``at``."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    inserted = F.struct(*[opened.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in rows.columns],
                        F.lit("insert").alias("op"), F.col(opened_at).alias("at"))
    update = F.struct(*rows.columns, F.lit("update").alias("op"), F.col(closed_at).alias("at"))
    # both from one pass over the rows, not from a union that makes them twice
    changes = F.when(F.col(closed_at).isNotNull(), F.array(inserted, update)).otherwise(F.array(inserted))
    return rows.select(F.explode(changes).alias("_change")).select("_change.*")


def loan_changes(t: Tables) -> DataFrame:
    """Loans as they are made and returned; some are due a day before they start."""
    cols = [c.name for c in TABLES["loan"].columns]
    rows = _vary(t.loan.select(*cols), "loan_id", {3: ("due_ts", F.col("loan_ts") - F.expr("INTERVAL 1 DAY"))})
    return as_changes(rows, "loan_id", "loan_ts", "return_ts", {"return_ts": F.lit(None).cast("timestamp_ntz")})


def session_changes(t: Tables) -> DataFrame:
    """Sessions as they start and end; some end an hour before they start (and so never)."""
    cols = [c.name for c in TABLES["accesssession"].columns]
    rows = _vary(t.accesssession.select(*cols), "session_id", {3: ("end_time", F.col("start_time") - F.expr("INTERVAL 1 HOUR"))})
    return as_changes(rows, "session_id", "start_time", "end_time", {"end_time": F.lit(None).cast("timestamp_ntz")})


def reservation_changes(t: Tables) -> DataFrame:
    """Reservations as they are made (active) and, two days later, fulfilled or cancelled."""
    cols = [c.name for c in TABLES["reservation"].columns]
    later = F.when(F.col("status").isin("Fulfilled", "Cancelled"), F.col("created_at") + F.expr("INTERVAL 2 DAYS"))
    rows = t.reservation.select(*cols).withColumn("_closed", later)
    return as_changes(rows, "reservation_id", "created_at", "_closed", {"status": F.lit("Active")}).drop("_closed")


def in_batches(changes: DataFrame, cuts: list[str]) -> list[DataFrame]:
    """The change rows in the order of their times, cut at the given times."""
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:]):
        rows = changes
        if low is not None:
            rows = rows.filter(F.col("at") >= F.lit(low).cast("timestamp_ntz"))
        if high is not None:
            rows = rows.filter(F.coalesce(F.col("at") < F.lit(high).cast("timestamp_ntz"), F.lit(True)))
        out.append(rows)
    return out


def signed_batches(rows: DataFrame, key: str, column: str, value: Column) -> list[DataFrame]:
    """Three batches of signed rows of a table: three quarters of it; a changed ``column`` for every fifth of those (the old
    row out, the new one in); the last quarter in and one of the first three out."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    changed = F.when(F.col(key) % 5 == 0, value.cast(kinds[column])).otherwise(F.col(column)).alias(column)
    now = rows.select(*[changed if c == column else F.col(c) for c in rows.columns])
    plus, minus = F.lit(1).alias("sign"), F.lit(-1).alias("sign")
    first, fifth = F.col(key) % 4 != 3, F.col(key) % 5 == 0
    return [rows.filter(first).select("*", plus),
            rows.filter(first & fifth).select("*", minus).unionByName(now.filter(first & fifth).select("*", plus)),
            rows.filter(~first).select("*", plus).unionByName(now.filter(F.col(key) % 4 == 0).select("*", minus))]


def book_measures(t: Tables) -> DataFrame:
    """(isbn, publisher_id, pub_year, measure): page-like counts from the ISBN's digits, some of them unknown."""
    number = F.col("isbn").cast("bigint")
    return t.book.select("isbn", "publisher_id", "pub_year", F.when(number % 23 != 7, number * 37 % 41).alias("measure"))


def older_measures(t: Tables) -> DataFrame:
    """The measures of each publisher's books before 1994, known only for some publishers: sets with and without
    unknown elements, of one element, and empty ones."""
    m = book_measures(t).filter("pub_year < 1994")
    return m.filter((F.col("publisher_id") % 3 == 0) | F.col("measure").isNotNull()).filter(
        "publisher_id % 5 <> 1").select("publisher_id", "measure")


def awkward_patrons(t: Tables) -> DataFrame:
    """Patrons whose names hold quotes, line ends, backslashes and what looks like SQL."""
    odd = F.concat(F.col("last_name"), F.lit("'s \"q\"\n-- x); ('a\\n', \r\n/* NULL, 1);"))
    return _vary(t.patron, "patron_id", {3: ("last_name", odd), 7: ("first_name", F.lit("")), 11: ("first_name", F.lit("NULL")),
                                         13: ("last_name", F.lit("a\\"))})
