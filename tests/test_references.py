"""Foreign-key checks: one pass over each table, and row and key counts of a plain anti join."""

import tempfile

from pyspark.sql import functions as F

from lendwise import standins
from lendwise.operators import quality as C
from lendwise.plans import formatted_plan
from lendwise.sources.schemas import TABLES
from lendwise.sources.sinks import write_tables
from lendwise.sources.tables import load_tables


def test_each_table_is_read_once(spark, projected):
    root = tempfile.mkdtemp(prefix="lendwise-fk-")
    write_tables(projected, root)
    t = load_tables(spark, root)
    # address, for one, is the parent of five tables
    touched = {n for n, s in TABLES.items() if s.fks} | {p for s in TABLES.values() for _, p, _ in s.fks}
    for check, tables in ((C.c03_fk_orphans, touched), (C.c03_orphan_keys, touched)):
        plan = formatted_plan(check(t))
        for name in TABLES:
            assert plan.count(f"{root}/{name}.parquet]") <= 1
        if tables:
            assert all(f"{root}/{n}.parquet]" in plan for n in tables)


def test_counts_of_a_plain_anti_join(spark, projected):
    t = standins.with_violations(projected)
    rows = {(r["child_table"], r["child_column"]): r for r in C.c03_fk_orphans(t).collect()}
    keys = {(r["child_table"], r["child_column"]): r for r in C.c03_orphan_keys(t).collect()}
    assert len(rows) == len(keys) == sum(len(s.fks) for s in TABLES.values())
    for child, col, parent, pcol in [("loan", "copy_id", "copy", "copy_id"), ("branch", "address_id", "address", "address_id"),
                                     ("copy", "isbn", "book", "isbn")]:
        orphans = C.fk_orphan_rows(t, child, col, parent, pcol)
        assert rows[child, col]["orphan_rows"] == orphans.count()
        assert orphans.count() > 0 or child == "branch"
        assert rows[child, col]["checked_rows"] == t[child].filter(F.col(col).isNotNull()).count()
        assert keys[child, col]["orphan_keys"] == orphans.select(col).distinct().count()
        assert keys[child, col]["used_keys"] == t[child].select(col).dropna().distinct().count()


def test_empty_tables(spark, projected):
    t = projected.replace(**{n: projected[n].limit(0) for n in TABLES})
    assert all(r["checked_rows"] == r["orphan_rows"] == 0 for r in C.c03_fk_orphans(t).collect())
    assert all(r["used_keys"] == r["orphan_keys"] == 0 for r in C.c03_orphan_keys(t).collect())
