"""Plan shape checks: no Cartesian products, column pruning and pushdown reach the parquet scans."""

import pytest

from lendwise.catalog import REGISTRY
from lendwise.plans import has_cartesian_product, pushed_filters, scan_schemas

# keys whose plan build runs a checkpoint job (distributed ranks) are still checked, just slower
KEYS = sorted(REGISTRY)


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_product(projected, key):
    assert not has_cartesian_product(REGISTRY[key](projected))


def test_scans_are_pruned(projected):
    schemas = scan_schemas(REGISTRY["q10_popular_books"](projected))
    line = [s for s in schemas if "l_orderkey" in s]
    assert line and all("l_quantity" not in s and "l_shipdate" not in s for s in line)
    orders = [s for s in schemas if "o_orderkey" in s]
    assert orders and all("o_totalprice" not in s for s in orders)


def test_filters_reach_the_scan(projected):
    # the event-type filter of the reservation projection is pushed into the events scan
    filters = " ".join(pushed_filters(REGISTRY["q16_reserved_never_borrowed"](projected)))
    assert "event_type" in filters
