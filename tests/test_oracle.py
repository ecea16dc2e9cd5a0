"""Every registered key against its DuckDB oracle on the small test tables (the driver's gate, stricter on
types), plus the projection itself table by table."""

import pytest

from compare import compare
from lendwise import oracle
from lendwise.catalog import REGISTRY
from lendwise.sources.schemas import TABLES


@pytest.mark.parametrize("table", list(TABLES))
def test_projection_matches(projected, duck, table):
    assert compare(projected[table], duck, oracle.table_sql(table)) == []


@pytest.mark.parametrize("key", [k for k in REGISTRY if k in oracle.Q])
def test_key_matches_oracle(projected, duck, key):
    assert compare(REGISTRY[key](projected), duck, oracle.with_projection(oracle.Q[key])) == []


def test_every_key_has_an_oracle():
    assert sorted(set(REGISTRY) - set(oracle.Q)) == []
