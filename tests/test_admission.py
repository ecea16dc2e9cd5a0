"""Set-based admission equals the row-by-row rule on random batches; invariants of the split."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lendwise.operators import admission as A
from lendwise.sources.tables import from_rows


def _sequential_loans(existing, batch):
    open_copies = {}
    for r in existing:
        if r[5] is None:
            open_copies[r[1]] = open_copies.get(r[1], 0) + 1
    out = {}
    for r in sorted(batch, key=lambda r: (r[3], r[0])):
        if open_copies.get(r[1], 0) > 0:
            out[r[0]] = A.MSG_COPY_ON_LOAN
        elif r[4] <= r[3]:
            out[r[0]] = A.MSG_LOAN_DATES
        else:
            out[r[0]] = None
            if r[5] is None:
                open_copies[r[1]] = open_copies.get(r[1], 0) + 1
    return out


def _loans(seed, n, start_id):
    rnd = random.Random(seed)
    base = dt.datetime(2001, 1, 1)
    rows = []
    for i in range(n):
        loan_ts = base + dt.timedelta(hours=rnd.randint(0, 200))
        due = loan_ts + dt.timedelta(days=rnd.choice([-1, 0, 7, 14]))
        ret = None if rnd.random() < 0.5 else loan_ts + dt.timedelta(days=3)
        rows.append((start_id + i, rnd.randint(1, 6), rnd.randint(1, 5), loan_ts, due, ret))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loans_equal_sequential(spark, seed):
    existing, batch = _loans(seed, 8, 1000), _loans(seed + 10, 60, 1)
    got = A.t01_admit_loans(from_rows(spark, "loan", batch), from_rows(spark, "loan", existing))
    assert {r["loan_id"]: r["reason"] for r in got.collect()} == _sequential_loans(existing, batch)


def _sequential_sessions(existing, batch, limits):
    active = {}
    for r in existing:
        if r[4] is None:
            active[r[2]] = active.get(r[2], 0) + 1
    out = {}
    for r in sorted(batch, key=lambda r: (r[3], r[0])):
        lim = limits.get(r[2])
        if lim is not None and active.get(r[2], 0) >= lim:
            out[r[0]] = A.MSG_SESSION_LIMIT
        else:
            out[r[0]] = None
            if r[4] is None:
                active[r[2]] = active.get(r[2], 0) + 1
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_sessions_equal_sequential(spark, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2001, 1, 1)

    def sessions(n, start):
        return [(start + i, 1, rnd.randint(1, 4), base + dt.timedelta(minutes=rnd.randint(0, 500)),
                 None if rnd.random() < 0.6 else base) for i in range(n)]

    existing, batch = sessions(5, 1000), sessions(80, 1)
    eres = from_rows(spark, "eresource", [(1, "a", 1, 1), (2, "b", 1, 2), (3, "c", 1, 3)])  # 4 has no license
    lic = from_rows(spark, "license", [(1, 1, dt.date(2001, 1, 1), dt.date(2002, 1, 1), 1),
                                       (2, 1, dt.date(2001, 1, 1), dt.date(2002, 1, 1), 3),
                                       (3, 1, dt.date(2001, 1, 1), dt.date(2002, 1, 1), 2)])
    got = A.t05_admit_sessions(from_rows(spark, "accesssession", batch), eres, lic,
                               from_rows(spark, "accesssession", existing), now=base)
    assert {r["session_id"]: r["reason"] for r in got.collect()} == _sequential_sessions(
        existing, batch, {1: 1, 2: 3, 3: 2})


def test_split_is_complete_and_stable(projected):
    batch = projected.loan
    got = A.t01_admit_loans(batch)
    assert got.count() == batch.count()
    accepted = got.filter("accepted").select(*batch.columns)
    again = A.t01_admit_loans(accepted)
    assert again.filter(~F.col("accepted")).count() == 0


def test_fines_reasons(spark):
    loans = from_rows(spark, "loan", [(1, 1, 7, dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 9), None)])
    from decimal import Decimal as D
    fines = from_rows(spark, "fine", [
        (1, 1, 7, 1, D("1.00"), "Paid", dt.datetime(2001, 1, 9)),
        (2, 9, 7, 1, D("1.00"), "Paid", dt.datetime(2001, 1, 9)),
        (3, 1, 8, 1, D("1.00"), "Paid", dt.datetime(2001, 1, 9)),
        (4, 1, 7, 1, D("0.00"), "Paid", dt.datetime(2001, 1, 9)),
        (5, 1, 7, 1, D("1.00"), "Payment Pending", dt.datetime(2001, 1, 9))])
    got = {r["fine_id"]: r["reason"] for r in A.t03_admit_fines(fines, loans).collect()}
    assert got == {1: None, 2: A.MSG_NO_LOAN, 3: A.MSG_FINE_PATRON, 4: A.MSG_FINE_AMOUNT, 5: A.MSG_FINE_STATUS}
    with pytest.raises(A.AdmissionError):
        A.t03_admit_fines(fines, loans, strict=True)


def test_license_and_term_rules(spark):
    lic = from_rows(spark, "license", [(1, 1, dt.date(2001, 1, 1), dt.date(2000, 1, 1), 0),
                                       (2, 1, dt.date(2001, 1, 1), dt.date(2002, 1, 1), 0),
                                       (3, 1, dt.date(2001, 1, 1), dt.date(2002, 1, 1), 4)])
    got = {r["license_id"]: r["reason"] for r in A.t09_license_insert(lic).collect()}
    assert got == {1: A.MSG_LICENSE_DATES, 2: A.MSG_LICENSE_LIMIT, 3: None}
    term = from_rows(spark, "term", [(1, "F", 2000, dt.date(2000, 9, 1), dt.date(2000, 1, 1)),
                                     (2, "F", 2000, None, dt.date(2000, 1, 1))])
    got = {r["term_id"]: r["reason"] for r in A.t12_term_update(term).collect()}
    assert got == {1: A.MSG_TERM_DATES, 2: None}


def test_new_patron_ids(spark):
    existing = from_rows(spark, "patron", [(5, "A", "B", None, "Student", None, __import__("decimal").Decimal("0"))])
    batch = spark.createDataFrame([("C", "D", None, "Staff", "", 2), ("", "E", None, "Staff", "3", 1),
                                   ("F", "G", "f@x", "Guest", "4", 3)],
                                  "first_name string, last_name string, email string, patron_type string, "
                                  "address_id string, seq long")
    got = {r["seq"]: (r["patron_id"], r["address_id"], r["accepted"]) for r in
           A.k02_append_patrons(existing, batch).collect()}
    assert got == {1: (None, 3, False), 2: (6, None, True), 3: (7, 4, True)}


def test_reservation_and_session_splits_are_stable(projected):
    res = A.t04_admit_reservations(projected.reservation)
    assert res.count() == projected.reservation.count()
    again = A.t04_admit_reservations(res.filter("accepted").select(*projected.reservation.columns))
    assert again.filter(~F.col("accepted")).count() == 0
    ses = A.t05_admit_sessions(projected.accesssession, projected.eresource, projected.license, now="2024-02-01")
    assert ses.count() == projected.accesssession.count()
    again = A.t05_admit_sessions(ses.filter("accepted").select(*projected.accesssession.columns),
                                 projected.eresource, projected.license, now="2024-02-01")
    assert again.filter(~F.col("accepted")).count() == 0


def test_patron_registration_reasons(spark):
    from decimal import Decimal

    existing = from_rows(spark, "patron", [(5, "A", "B", "a@x", "Student", None, Decimal("0"))])
    address = from_rows(spark, "address", [(4, "s", "c", None, None, "l")])
    rows = [("C", "D", "n@x", "Staff", "4", 1), ("C", "D", "n@x", "Staff", "4", 2), ("C", "D", "a@x", "Staff", " ", 3),
            ("C", "D", None, "Staff", "x4", 4), ("C", "D", None, "Staff", "9", 5), ("C", "", "m@x", "Staff", None, 6),
            ("C", "D", "m@x", "Staff", None, 7)]
    batch = spark.createDataFrame(rows, "first_name string, last_name string, email string, patron_type string, "
                                        "address_id string, seq long")
    got = {r["seq"]: (r["patron_id"], r["reason"]) for r in A.k02_append_patrons(existing, batch, address).collect()}
    assert got == {1: (6, None), 2: (None, A.MSG_EMAIL_USED), 3: (None, A.MSG_EMAIL_USED), 4: (None, A.MSG_ADDRESS_TEXT),
                   5: (None, A.MSG_ADDRESS_UNKNOWN), 6: (None, A.MSG_PATRON_MISSING), 7: (7, None)}


def test_missing_start_time_becomes_now(spark):
    from pyspark.sql import types as T

    from lendwise.sources.schemas import TABLES

    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in TABLES["accesssession"].schema.fields])
    batch = spark.createDataFrame([(1, 1, 1, None, None)], loose)
    eres, lic = from_rows(spark, "eresource", []), from_rows(spark, "license", [])
    now = dt.datetime(2001, 1, 1)
    assert A.t05_admit_sessions(batch, eres, lic, now=now).first()["start_time"] == now
    with pytest.raises(TypeError):
        A.t05_admit_sessions(batch, eres, lic)
