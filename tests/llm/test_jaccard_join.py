import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import jaccard_join as J


def near_copies(groups=6, each=9, seed=3):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10_000)}" for _ in range(200)]
        for k in range(each):
            w = list(base)
            for _ in range(rng.randrange(8)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10_000)}"
            rows.append((1000 + g * 100 + k, " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("block, diff", [(256, 1024), (4, 1024), (4, 3)])
def test_equals_brute_force(spark, monkeypatch, block, diff):
    monkeypatch.setattr(J, "BLOCK_TEXTS", block)
    monkeypatch.setattr(J, "DIFF_TEXTS", diff)
    rows = H.TRICKY + near_copies()
    got = H.rows_of(J.near_duplicates(H.docs(spark, rows, extra=True)), "doc_id", "class_id", "links")
    assert got == sorted(H.classes([(r[0], r[1]) for r in rows]), key=repr)


def test_crowded_runs_keep_the_recall(spark, monkeypatch):
    """Runs of one or two representatives are cut to longer prefixes, and shortened again where recall is short."""
    monkeypatch.setattr(J, "CROWD", 1)
    shared = [f"line{k}" for k in range(150)]  # half of every text: unlike texts that share many prefixes
    rows = near_copies(4, 6) + [(5000 + k, " ".join(shared + [f"own{k}x{j}" for j in range(100)]), "en", "s", 1) for k in range(40)]
    docs = H.docs(spark, rows)
    forest = J._forest(J._signed(docs).withColumn("node", J.F.xxhash64("__t")))
    assert J._links(forest, 1).filter("cut > 0").count() > 0 and J._links(forest, None).filter("cut > 0").count() == 0
    got = H.rows_of(J.near_duplicates(docs), "doc_id", "class_id", "links")
    assert got == sorted(H.classes([(r[0], r[1]) for r in rows]), key=repr)


def test_a_large_group_ships_each_text_once(spark, monkeypatch):
    """3,000 different near copies of one text, all partners of each other: links are counted, not compared."""
    monkeypatch.setattr(J, "BLOCK_TEXTS", 64)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(3000):
        w = list(base)
        w[rng.randrange(400)] = f"edit{k}"
        rows.append((k, " ".join(w), "en", "s", 1))
    apply = J._verify
    calls = spark.sparkContext.accumulator(0)
    texts = spark.sparkContext.accumulator(0)

    def counted(key, table):
        calls.add(1)
        texts.add(table.num_rows)
        return apply(key, table)

    monkeypatch.setattr(J, "_verify", counted)
    out = J.near_duplicates(H.docs(spark, rows)).collect()
    assert {(r["class_id"], r["links"]) for r in out} == {(0, 2999)} and len(out) == 3000
    assert texts.value <= 3000 + calls.value and calls.value == 47  # every text once, and the head to each chunk


def test_links_in_a_run_are_fewer_than_its_texts():
    rng = np.random.default_rng(4)
    run, links = J.Run(), []
    base = rng.integers(0, 2, 160).astype(np.uint8)
    for k in range(500):
        bits = base.copy()
        bits[rng.integers(0, 160, rng.integers(0, 50))] ^= 1
        links += run.add(k, np.frombuffer(np.packbits(bits).tobytes().ljust(J.SKETCH, b"\0"), np.uint64))
    assert len(links) < 500 and len({x for pair in links for x in pair}) == 500


def test_sample_table_and_one_per_class(spark):
    df = spark.read.parquet(f"{H.SF}/documents.parquet")
    want = H.classes([(r.doc_id, r.text) for r in df.collect()])
    assert H.rows_of(J.near_duplicates(df), "doc_id", "class_id", "links") == sorted(want, key=repr)
    kept = J.one_per_class(df)
    assert kept.schema.names == df.schema.names
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})


def test_one_row_of_repeated_rows(spark):
    docs = H.docs(spark, H.TRICKY + H.TRICKY, extra=True)
    out = J.one_per_class(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 1
    # 1 and 2 are the same empty text, 9 has no words but its own text


def test_empty_table(spark):
    assert J.near_duplicates(H.docs(spark, [])).count() == 0
    assert J.one_per_class(H.docs(spark, [])).count() == 0


def test_prefixes_reach_the_recall():
    assert J.missed([J.SHORT] * J.TREES) < 1 - J.RECALL < J.missed([J.DEPTH] * J.TREES)
    assert J.missed([1]) == pytest.approx(0.2) and J.missed([]) == 1.0


def test_one_row_of_equal_ids_and_texts_is_chosen_by_content(spark):
    rows = [(1, "one two three four five six", lang, src, n) for lang in ("en", "de", None) for src in ("a", "b") for n in (1, 2)]
    kept = {tuple(J.one_per_class(H.docs(spark, rows).repartition(k)).first()) for k in (1, 3, 5)}
    assert len(kept) == 1


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30_000, n).astype(np.uint64)) for n in (0, 5, 3000, 20_000, 20_000)]
    got = J.overlaps(sets[1:], sets)
    for i, a in enumerate(sets[1:]):
        assert got[i].tolist() == [len(np.intersect1d(a, b)) for b in sets]
