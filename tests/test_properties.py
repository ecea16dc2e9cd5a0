"""Hypothesis-generated inputs for the two set-based algorithms with the most moving parts."""

import datetime as dt
import itertools
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lendwise.operators import admission as A
from lendwise.operators.pairs import shared_item_pairs
from lendwise.sources.tables import from_rows

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

links_strategy = st.sets(st.tuples(st.integers(0, 9), st.integers(0, 5)), min_size=1, max_size=40)


@SETTINGS
@given(links=links_strategy, k=st.integers(1, 3), threshold=st.integers(1, 6))
def test_pairs_property(spark, links, k, threshold):
    members = {}
    for m, i in links:
        members.setdefault(i, set()).add(m)
    c = Counter(p for ms in members.values() for p in itertools.combinations(sorted(ms), 2))
    want = {p: n for p, n in c.items() if n >= k}
    df = spark.createDataFrame(sorted(links), "m long, i long")
    got = {(r["member1"], r["member2"]): r["shared"]
           for r in shared_item_pairs(df, "m", "i", k, block=threshold).collect()}
    assert got == want


loan_strategy = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 30), st.sampled_from([-1, 0, 5]),
                                   st.booleans()), min_size=1, max_size=25)


@SETTINGS
@given(rows=loan_strategy, existing_open=st.sets(st.integers(1, 3), max_size=2))
def test_loan_admission_property(spark, rows, existing_open):
    base = dt.datetime(2001, 1, 1)
    batch = [(i + 1, copy, 7, base + dt.timedelta(hours=h), base + dt.timedelta(hours=h, days=d),
              None if is_open else base + dt.timedelta(hours=h + 1))
             for i, (copy, h, d, is_open) in enumerate(rows)]
    existing = [(1000 + c, c, 7, base, base + dt.timedelta(days=1), None) for c in sorted(existing_open)]
    open_now = {c: 1 for c in existing_open}
    want = {}
    for r in sorted(batch, key=lambda r: (r[3], r[0])):
        if open_now.get(r[1], 0) > 0:
            want[r[0]] = A.MSG_COPY_ON_LOAN
        elif r[4] <= r[3]:
            want[r[0]] = A.MSG_LOAN_DATES
        else:
            want[r[0]] = None
            if r[5] is None:
                open_now[r[1]] = 1
    got = A.t01_admit_loans(from_rows(spark, "loan", batch), from_rows(spark, "loan", existing))
    assert {r["loan_id"]: r["reason"] for r in got.collect()} == want
