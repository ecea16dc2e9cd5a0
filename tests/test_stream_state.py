"""Streaming admission on a keyed state: against a row-by-row replay, over replays of batches, and what it reads."""

import datetime as dt
import random
import re
import tempfile

import pytest

from lendwise.operators import admission as A
from lendwise.plans import formatted_plan
from lendwise.sources.schemas import TABLES
from lendwise.sources.tables import from_rows
from lendwise.streaming import MSG_NOT_OPEN, RULES, admission_batch_writer, current_rows, decisions, replay, with_changes

DAY, T0 = dt.timedelta(days=1), dt.datetime(2001, 1, 1)


def loan_history(rng, n, copies):
    """Change rows (loan columns, op, at): loans, late and early returns, returns of unknown loans, changed patrons."""
    rows, made = [], []
    for k in range(n):
        at = T0 + DAY * rng.randrange(200) if rng.random() < 0.95 else T0
        if made and rng.random() < 0.45:
            loan, copy, patron, start, due, _ = rng.choice(made)
            back = rng.choice([start + DAY * rng.randrange(-2, 30), None])
            if rng.random() < 0.1:
                loan += 10_000
            if rng.random() < 0.1:
                patron += 1
            rows.append((loan, copy, patron, start, due, back, "update", back or at))
        else:
            row = (k, rng.randrange(copies), rng.randrange(5), at, at + DAY * rng.randrange(-1, 20), None)
            if rng.random() < 0.1:
                row = (*row[:5], row[3] + DAY)  # recorded after its return
            made.append(row)
            rows.append((*row, rng.choice(["insert", None]), at))
    return rows


def by_hand(batches, limit_of, stored=()):
    """Each micro-batch's rows in order, one at a time: {(id, op): [(accepted, reason)]} and the open loans."""
    open_, told = {(c, i): p for i, c, p in stored}, []
    for batch in batches:
        for loan, copy, patron, start, due, back, op, _ in sorted(
                batch, key=lambda r: (r[7] is not None, r[7] or T0, r[6] != "update", r[0])):
            if op == "update":
                held = open_.get((copy, loan), "none")
                reason = (MSG_NOT_OPEN if held == "none" else A.MSG_RETURN_DATE if back is not None and back < start
                          else A.MSG_PATRON_CHANGED if patron != held else None)
                if reason is None and back is not None:
                    del open_[copy, loan]
            else:
                reason = (A.MSG_COPY_ON_LOAN if sum(c == copy for c, _ in open_) >= limit_of(copy)
                          else A.MSG_LOAN_DATES if due <= start else None)
                if reason is None and back is None:
                    open_[copy, loan] = patron
            told.append((loan, "update" if op == "update" else "insert", reason is None, reason))
    return sorted(told, key=repr), sorted(k for k in open_)


def frame(spark, rows):
    kinds = TABLES["loan"].schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    return spark.createDataFrame(rows, f"{kinds}, op string, at timestamp_ntz")


def told(df):
    return sorted((tuple(r) for r in df.select("loan_id", "op", "accepted", "reason").collect()), key=repr)


def test_loans_and_returns_equal_a_row_by_row_replay(spark):
    rng = random.Random(11)
    rows = loan_history(rng, 400, 9)
    batches = [rows[:150], rows[150:151], [], rows[151:300], rows[300:]]  # late rows: times are not in arrival order
    stored = [(90_000, 3, 1, T0, T0 + DAY, None), (90_001, 4, 1, T0, T0 + DAY, T0 + DAY), (90_002, 3, 2, T0, T0 + DAY, None)]
    root = tempfile.mkdtemp(prefix="lendwise-state-")
    frames = [frame(spark, b) for b in batches]
    got = replay(frames, "loan", root, base=from_rows(spark, "loan", stored), every=2, buckets=4)
    want, open_ = by_hand(batches, lambda _: 1, [(r[0], r[1], r[2]) for r in stored if r[5] is None])
    assert told(got) == want
    state = RULES["loan"].state(f"{root}/table_open", 2, 4).current(spark, len(batches) - 1)
    assert sorted((r["copy_id"], r["item"]) for r in state.collect()) == open_
    # the table as it stands has the same open loans as the state
    now = current_rows(spark, "loan", f"{root}/table", from_rows(spark, "loan", stored)).filter("return_ts IS NULL")
    assert sorted((r["copy_id"], r["loan_id"]) for r in now.select("copy_id", "loan_id").collect()) == open_


def test_replayed_batches_change_nothing(spark):
    rng = random.Random(4)
    rows = loan_history(rng, 200, 6)
    batches = [rows[k * 40:(k + 1) * 40] for k in range(5)]
    root = tempfile.mkdtemp(prefix="lendwise-state-")
    process = admission_batch_writer("loan", f"{root}/table", f"{root}/quarantine", every=2, buckets=4)
    for k in range(5):
        process(frame(spark, batches[k]), k)
        process(frame(spark, batches[k]).repartition(3), k)  # as after a failure between the write and the commit
    assert told(decisions(spark, "loan", f"{root}/table", f"{root}/quarantine")) == by_hand(batches, lambda _: 1)[0]


def test_a_batch_reads_only_the_state_of_its_keys(spark):
    root = tempfile.mkdtemp(prefix="lendwise-state-")
    stored = from_rows(spark, "loan", [(k, k, 1, T0, T0 + DAY, None) for k in range(500)])
    process = admission_batch_writer("loan", f"{root}/table", f"{root}/quarantine", base=stored, every=4, buckets=16)
    process(frame(spark, [(1000, 7, 1, T0, T0 + DAY, None, "insert", T0)]), 0)
    state = RULES["loan"].state(f"{root}/table_open", 4, 16)
    batch = with_changes(frame(spark, [(1001, 7, 1, T0, T0 + DAY, None, "insert", T0),
                                       (1002, 8, 1, T0, T0 + DAY, None, "insert", T0)]), RULES["loan"])
    rows = state.of_batch(batch, 1)
    assert sorted(r["copy_id"] for r in rows.collect()) == [7, 8]
    buckets = {r["b"] for r in batch.select(state.bucket().alias("b")).collect()}
    plan = formatted_plan(rows)
    pruned = re.search(r"PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)\]", plan)
    assert pruned and {int(b) for b in pruned[1].split(",")} == buckets
    assert "/table/" not in plan and "/table]" not in plan  # nor any accepted row
    # once the batches are many, those before the last snapshot are not read at all
    for k in range(1, 9):
        process(frame(spark, [(2000 + k, 600 + k, 1, T0, T0 + DAY, None, "insert", T0)]), k)
    files = state.of_batch(batch, 9).inputFiles()
    assert {re.search(r"(snapshot|changes)=(-?\d+)", f).group(0) for f in files} <= {"snapshot=7", "changes=8"}


def test_lost_state_is_an_error(spark):
    root = tempfile.mkdtemp(prefix="lendwise-state-")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        admission_batch_writer("loan", f"{root}/table", f"{root}/quarantine")(frame(spark, []), 3)


def test_sessions_with_limits(spark):
    """A hot resource of limit 3, one without a license, ends that free a place, null ends and keys."""
    eresource = from_rows(spark, "eresource", [(1, "a", 1, 1), (2, "b", 1, 2)])
    license_ = from_rows(spark, "license", [(1, 1, dt.date(2000, 1, 1), dt.date(2002, 1, 1), 3)])
    rng, rows, begun = random.Random(2), [], []
    for k in range(300):
        at = T0 + dt.timedelta(minutes=k)
        if begun and rng.random() < 0.5:
            s = begun.pop(rng.randrange(len(begun)))
            rows.append((*s[:4], at if rng.random() < 0.9 else T0 - DAY, "update", at))
        else:
            s = (k, 1, rng.choice([1, 1, 1, 2, None]), at, None)
            begun.append(s)
            rows.append((*s, "insert", at))
    kinds = "session_id long, patron_id long, resource_id long, start_time timestamp_ntz, end_time timestamp_ntz, op string, at timestamp_ntz"
    batches = [rows[:100], rows[100:210], rows[210:]]
    open_, want = set(), []
    for session, _, resource, start, end, op, _ in rows:
        if op == "update":
            reason = MSG_NOT_OPEN if (resource, session) not in open_ else A.MSG_SESSION_END if end < start else None
            if reason is None:
                open_.discard((resource, session))
        else:
            full = resource == 1 and sum(r == 1 for r, _ in open_) >= 3
            reason = A.MSG_SESSION_LIMIT if full else None
            if reason is None and resource is not None:
                open_.add((resource, session))
        want.append((session, op, reason is None, reason))
    got = replay([spark.createDataFrame(b, kinds) for b in batches], "accesssession", tempfile.mkdtemp(prefix="lendwise-state-"),
                 eresource=eresource, license_=license_, now=T0, every=2, buckets=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(not ok for _, _, ok, _ in want) > 30


def test_reservations_can_be_made_again_after_cancellation(spark):
    kinds = "reservation_id long, patron_id long, isbn string, branch_id long, created_at timestamp_ntz, status string, op string, at timestamp_ntz"
    r = lambda i, status, op, day, branch=1: (i, 1, "9" * 13, branch, T0, status, op, T0 + DAY * day)
    batches = [[r(1, "Active", "insert", 0), r(2, "Waiting", "insert", 1), r(3, "Active", "insert", 1, 2)],
               [r(1, "Waiting", "update", 2), r(4, "Active", "insert", 3), r(1, "Cancelled", "update", 4), r(5, "Fulfilled", "insert", 5)],
               [r(6, "Active", "insert", 6), r(7, "Active", "insert", 7), r(1, "Fulfilled", "update", 8)]]
    got = replay([spark.createDataFrame(b, kinds) for b in batches], "reservation", tempfile.mkdtemp(prefix="lendwise-state-"))
    away = sorted((x["reservation_id"], x["op"], x["reason"]) for x in got.filter("NOT accepted").collect())
    assert away == [(1, "update", MSG_NOT_OPEN), (2, "insert", A.MSG_RESERVATION), (4, "insert", A.MSG_RESERVATION),
                    (7, "insert", A.MSG_RESERVATION)]
