"""Results do not depend on the session time zone: date-times are zone-less wall-clock values."""

import pytest

from compare import compare
from lendwise import oracle
from lendwise.catalog import REGISTRY
from lendwise.sources.projection import project

KEYS = ["v07_patron_loans_with_status", "d02_overdue_risk", "q13_duration_lag", "f16_dateformat",
        "t05_admit_sessions", "d01_dashboard_summary"]


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kolkata"])
def test_keys_under_other_session_zones(spark, duck, zone):
    from conftest import SMALL_SF

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = project(spark, SMALL_SF)
        for key in KEYS:
            assert compare(REGISTRY[key](t), duck, oracle.with_projection(oracle.Q[key])) == [], (zone, key)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
