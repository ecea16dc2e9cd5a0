import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import decontamination as D

COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
PASSAGE = " ".join(f"Passage{i}" for i in range(40))
ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "short item of five words"[:24]), (3, None), (4, ""), (5, "..."), (6, "one"),
         (None, "an item that has no id at all but is long enough to be found by its windows"),
         (10, " ".join(f"Passage{i}" for i in range(5, 30)))]
MORE = [(20, "x " * 50 + PASSAGE.upper() + " y" * 30, "en", "s", 1),
        (21, " ".join(PASSAGE.split()[3:16]), "en", "s", 1), (22, " ".join(PASSAGE.split()[3:15]), "en", "s", 1),
        (23, "An item that has no id at all but is long enough to be found by its windows, too", "en", "s", 1),
        (24, PASSAGE.replace(" ", ", ") + " w" * 2000, "en", "s", 1), (25, PASSAGE + " " + PASSAGE, "en", "s", 1)]


def test_equals_brute_force(spark):
    docs = H.docs(spark, H.TRICKY + MORE, extra=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = H.rows_of(D.decontaminate(docs, items), *COLS)
    rows = [(r[0], r[1]) for r in H.TRICKY + MORE]
    assert got == sorted(H.contamination(rows, ITEMS), key=repr)
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(
        repr(r[0]) for r in H.contamination(rows, ITEMS) if not r[5])


@pytest.mark.parametrize("docs_empty, items_empty", [(True, False), (False, True), (True, True)])
def test_empty_tables(spark, docs_empty, items_empty):
    docs = H.docs(spark, [] if docs_empty else H.TRICKY)
    items = spark.createDataFrame([] if items_empty else ITEMS, "item_id long, text string")
    out = D.decontaminate(docs, items)
    assert out.count() == (0 if docs_empty else len(H.TRICKY))
    if items_empty:
        assert out.filter("n_hit > 0 OR contaminated").count() == 0


def test_shortest_guaranteed_span(spark):
    """Every alignment of a 13-word passage inside a longer text is found."""
    span = " ".join(f"s{i}" for i in range(13))
    rows = [(i, " ".join(["pad"] * i + [span] + ["tail"] * (7 - i % 8)), "en", "s", 1) for i in range(20)]
    items = spark.createDataFrame([(1, "lead " + span + " trail more")], "item_id long, text string")
    assert {r.n_hit for r in D.decontaminate(H.docs(spark, rows), items).collect()} == {13}


def test_all_lengths_in_one_pass(spark):
    """Items of 1 to 13 words: as by brute force, and the candidates' texts are read once for all window lengths."""
    import tempfile

    from lendwise.plans import formatted_plan

    rng_words = [f"t{k}" for k in range(200)]
    items = [(n, " ".join(rng_words[n * 14:n * 14 + n])) for n in range(1, 14)] + [(50, " ".join(rng_words[180:195]))]
    rows = [(k, " ".join(rng_words[k * 3:k * 3 + 40]), "en", "s", 1) for k in range(55)] + [(99, "t14", "en", "s", 1)] * 30
    root = tempfile.mkdtemp(prefix="lendwise-decon-")
    H.docs(spark, rows).write.parquet(f"{root}/documents")
    docs = spark.read.parquet(f"{root}/documents")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = H.rows_of(D.decontaminate(docs, bench), *COLS)
    assert got == sorted(H.contamination([(r[0], r[1]) for r in rows], items), key=repr)
    written, put = [], D.materialize
    D.materialize = lambda df, label: written.append((label, formatted_plan(df).count(f"{root}/documents]"))) or put(df, label)
    try:
        D.decontaminate(docs, bench)
    finally:
        D.materialize = put
    assert sum(n for _, n in written) == 2 and dict(written)["window-hits"] == 0


def test_shared_windows_name_every_item_once(spark):
    """A window that many items and texts share: each item is counted once per text."""
    shared = " ".join(f"s{k}" for k in range(13))
    items = [(k, shared + f" own{k}") for k in range(40)] + [(None, shared)]
    rows = [(k, f"x{k} {shared} y {shared}", "en", "s", 1) for k in range(20)]
    out = D.decontaminate(H.docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["n_items"], r["n_hit"]) for r in out} == {(40, 26)}
