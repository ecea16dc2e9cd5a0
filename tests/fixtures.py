"""Small hand-written library data with the trap rows every operator must handle (FIXTURES.md §A)."""

import datetime as dt
from decimal import Decimal

from lendwise.sources.schemas import TABLES
from lendwise.sources.tables import Tables, from_rows

D = Decimal
ts = dt.datetime
AS_OF = dt.date(2001, 8, 2)

ROWS = {
    "address": [(1, "1 Elm St", "Town", None, None, "Land")],
    "publisher": [(1, "Pub One", 1)],
    # two authors share a last name: lists are ordered by (last, first)
    "author": [(1, "Bob", "Lee"), (2, "Ann", "Lee"), (3, "Cy", "Park")],
    "subject": [(1, "Art"), (2, "Bio"), (3, "Chem")],
    "term": [(1, "Fall", 2000, dt.date(2000, 9, 1), dt.date(2000, 12, 20))],
    # OTHER has no fines (payment rate over zero fines)
    "finereason": [(1, "LATE", "late"), (2, "LOST", "lost"), (3, "OTHER", None)],
    "provider": [(1, "Prov", None, 1)],
    "license": [(1, 1, dt.date(2001, 1, 1), dt.date(2002, 1, 1), 2)],
    "resourcetype": [(1, "Ebook")],
    "partnerlibrary": [(1, "Partner", 1)],
    "branch": [(1, "Main", 1), (2, "East", 1)],
    "book": [("0000000000001", "Alpha", 1, 2001), ("0000000000002", "Beta", 1, 2002),
             ("0000000000003", "Gamma", 1, 2003),  # no copies
             ("0000000000004", "Delta", None, 2004)],
    # Alpha has two subjects
    "booksubject": [("0000000000001", 1), ("0000000000001", 2), ("0000000000002", 2), ("0000000000004", 3)],
    "bookauthor": [("0000000000001", 1), ("0000000000001", 2), ("0000000000002", 1), ("0000000000002", 2),
                   ("0000000000004", 3)],
    "copy": [(1, "0000000000001", 1, 1, "B1"), (2, "0000000000001", 2, None, "B2"),
             (3, "0000000000002", 1, None, "B3"), (4, "0000000000004", 1, 1, None)],
    "patron": [(1, "Pat", "Able", "p1@x", "Student", 1, D("0.00")),
               (2, "Quin", "Baker", "p2@x", "Faculty", None, D("1.00")),
               (3, "Ray", "Cole", None, "Student", 1, D("0.00")),      # never borrowed
               (4, "Sam", "Dunn", None, "Staff", 1, D("0.00")),        # unpaid 49.50
               (5, "Tia", "Eve", "p5@x", "Alumni", 1, D("0.00"))],     # overdue, no fines
    "loan": [(1, 1, 1, ts(2001, 6, 1, 10), ts(2001, 6, 15), ts(2001, 6, 20)),
             (2, 3, 1, ts(2001, 7, 1), ts(2001, 7, 15), None),
             (3, 2, 2, ts(2001, 7, 10), ts(2001, 7, 24), ts(2001, 7, 20)),
             (4, 1, 4, ts(2001, 7, 20), ts(2001, 8, 2, 9), None),       # due earlier on the as-of day
             (5, 4, 5, ts(2001, 5, 1), ts(2001, 5, 15), None),
             (6, 3, 2, ts(2001, 3, 1), ts(2001, 3, 15), ts(2001, 3, 10))],
    "fine": [(1, 1, 1, 1, D("10.00"), "Paid", ts(2001, 6, 20)),
             (2, 4, 4, 1, D("49.50"), "Unpaid", ts(2001, 8, 1)),
             (3, 2, 1, 2, D("20.00"), "Unpaid", ts(2001, 7, 20))],
    "reservation": [(1, 3, "0000000000003", 1, ts(2001, 7, 1), "Active"),
                    (2, 1, "0000000000002", 1, ts(2001, 7, 2), "Waiting")],
    "eresource": [(1, "E1", 1, 1), (2, "E2", 1, 1)],
    "accesssession": [(1, 1, 1, ts(2001, 7, 1), None), (2, 2, 1, ts(2001, 7, 2), ts(2001, 7, 2, 1))],
    "illrequest": [(1, 1, 1, "0000000000003", "Requested", ts(2001, 7, 3))],
}


def fixture_tables(spark, empty=False, **overrides) -> Tables:
    rows = dict(ROWS)
    rows.update(overrides)
    return Tables({n: from_rows(spark, n, [] if empty else rows[n]) for n in TABLES})
