"""The reports called from SQL equal the operators, for every parameter."""

import pytest

from lendwise.operators import reports as R
from lendwise.operators import views as V
from lendwise.operators.reports_sql import register_reports
from lendwise.sources.projection import AS_OF


def same(a, b):
    b = b.select(*a.columns)
    assert [f.dataType for f in a.schema.fields] == [f.dataType for f in b.schema.fields]
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("call, operator", [
    ("book_catalog('ge_r')", lambda t: R.d03_book_catalog(t, search="ge_r")),
    ("book_catalog(subject_id => 3)", lambda t: R.d03_book_catalog(t, subject_id=3)),
    ("book_catalog('', NULL)", R.d03_book_catalog),
    ("loans_segmented(DATE'2000-01-05', 'overdue')", lambda t: R.d05_loans_segmented(t, "2000-01-05", "OVERDUE")),
    ("loans_segmented(DATE'2000-01-05', 'unknown')", lambda t: R.d05_loans_segmented(t, "2000-01-05", "ALL")),
    ("overdue_risk(DATE'1999-07-01')", lambda t: R.d02_overdue_risk(t, "1999-07-01")),
    ("patron_risk_profile()", R.d04_patron_risk_profile),  # both as of today
])
def test_calls(spark, projected, call, operator):
    assert same(register_reports(projected).sql(f"SELECT * FROM {call}"), operator(projected))


def test_variable_and_composition(spark, projected):
    sql = register_reports(projected).sql
    sql(f"SET VAR report_as_of = DATE'{AS_OF}'")
    top = sql("SELECT r.* FROM overdue_risk(report_as_of) r WHERE risk_rank <= 3")
    assert same(top, R.d02_overdue_risk(projected, AS_OF).filter("risk_rank <= 3"))


def test_now_is_the_default(spark, projected):
    """Every date parameter can be left out and is then the time of the query (F-11)."""
    loans = projected.loan.count()
    late = V.v06_overdue_loans(projected).count()
    assert late == V.v06_overdue_loans(projected, "2100-01-01").count() > 0
    assert R.d05_loans_segmented(projected).count() <= loans
    assert R.d02_overdue_risk(projected).count() == late or R.d02_overdue_risk(projected).count() > 0
    row = spark.range(1).select(V.as_timestamp().alias("ts"), R.as_date().alias("d"), ).first()
    assert row["ts"].date() == row["d"]
