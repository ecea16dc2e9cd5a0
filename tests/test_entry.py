import importlib.util

from lendwise.catalog import REGISTRY


def _entry_module():
    from conftest import ROOT

    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    assert "risk_rank" in df.columns
    assert df.count() > 0


def test_queries_and_oracles_line_up():
    mod = _entry_module()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(REGISTRY) <= set(q)
    assert set(o) <= set(q)
    assert all(sql.lstrip().upper().startswith(("WITH", "SELECT")) for sql in o.values())


def test_entry_keys_match_in_native_types(spark, duck):
    from compare import compare
    from conftest import SMALL_SF

    mod = _entry_module()
    q, o = mod.queries(), mod.oracle_sql()
    for key in ("d02_overdue_risk", "q23_fine_analysis", "t09_license_insert", "v07_patron_loans_with_status"):
        assert compare(q[key](spark, SMALL_SF), duck, o[key]) == [], key


def test_command_line_list(capsys):
    from lendwise.__main__ import main

    main(["list"])
    out = capsys.readouterr().out
    assert "q10_popular_books" in out and len(out.splitlines()) == len(REGISTRY)
