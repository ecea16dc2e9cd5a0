"""Queries whose steps must not gather their rows in one task or on the driver: plans, and results on repeated keys."""

import re
from collections import Counter

from fixtures import AS_OF, fixture_tables
from pyspark.sql import functions as F

from lendwise import standins as S
from lendwise.operators import pairs, queries as Q, ranking
from lendwise.operators import reports as R
from lendwise.operators import search
from lendwise.operators.reports_sql import register_reports
from lendwise.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sql_reports_broadcast_no_growing_table(spark):
    """the planner takes these tables for small, whatever their rows."""
    text = plan(register_reports(fixture_tables(spark)).sql(f"SELECT * FROM loans_segmented(DATE'{AS_OF}', NULL)"))
    assert not re.search(r"Broadcast\w+Join \[(copy_id|isbn|patron_id)#", text)
    assert len(re.findall(r"SortMergeJoin \[(?:copy_id|isbn|patron_id)#", text)) >= 3


def test_pairs_join_keeps_its_tasks(spark):
    """both sides of the join that makes the pairs have the number of partitions asked for."""
    links = spark.createDataFrame([(m, i) for i in range(5) for m in range(4)], "m long, i long")
    got = pairs.shared_item_pairs(links, "m", "i", tasks=16)
    assert len(re.findall(r"hashpartitioning\(i#\d+L, p#\d+, q#\d+, 16\), REPARTITION_BY_NUM", plan(got))) == 2
    assert {tuple(r) for r in got.collect()} == {(a, b, 5) for a in range(4) for b in range(a + 1, 4)}


def test_pairs_are_shuffled_as_lists(spark):
    """the pairs become rows where they are counted, and the blocks are made once."""
    members = [None, *range(7)]
    links = [(m, i) for i in (1, 2, None) for m in members] + [(3, 1), (3, 3), (5, 4), (6, 4)]  # twice; one member; one pair
    df = spark.createDataFrame(links, "m long, i long")
    for block in (1, 2, 3, 100):
        got = pairs.shared_item_pairs(df, "m", "i", block=block, tasks=3)
        made = {tuple(r) for r in got.collect()}
        assert made == {(a, b, 3 if (a, b) == (5, 6) else 2) for a in range(7) for b in range(a + 1, 7)}
        text = plan(got)
        counted = text.index("HashAggregate(keys=[member1#")
        assert text.index("Generate explode(after#") < text.index("hashpartitioning(member1#", counted)
        assert "ReusedExchange" in text


def test_coauthors_collect_no_books(projected):
    """links are dealt by book once, and the books are not broadcast."""
    text = plan(Q.q30_coauthors(projected))
    assert re.search(r"ShuffledHashJoin \[isbn#\d+\]", text) and not re.search(r"BroadcastHashJoin \[isbn#", text)


def test_texts_are_dealt_out_before_their_trigrams(spark, tmp_path, monkeypatch):
    """the texts of one file do not become the postings in one task."""
    asked = []

    def spread(df, *keys, tasks=None):
        asked.append((df.columns, tasks))
        return tables.spread(df, *keys, tasks=tasks)

    monkeypatch.setattr(search, "spread", spread)
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 100)
    books = spark.range(300).select(F.format_string("%013d", "id").alias("isbn"), F.concat(F.lit("title "), "id").alias("title"))
    index = search.TitleIndex(str(tmp_path), 4).write(books.coalesce(1))
    assert "folded_title" in asked[0][0] and asked[0][1] == 48 and "trigram" in asked[1][0]
    assert index.search(spark, "title 29").count() == 11


def test_subjects_with_repeated_rows(spark):
    """repeated books, copies, subjects and their links count as often as in the join of them all, and the rows per
    subject are made behind the last shuffle of the loans."""
    base = fixture_tables(spark)
    t = base.replace(**{n: base[n].unionAll(base[n].limit(k)) for n, k in
                        (("book", 1), ("copy", 2), ("booksubject", 3), ("subject", 2), ("loan", 4))})
    got = Q.q22_subject_patterns(t, min_total=0)
    subject = t.subject.select("subject_id", F.col("name").alias("s"))
    rows = (t.loan.select("patron_id", "copy_id").join(t.copy.select("copy_id", "isbn"), "copy_id").join(t.book.select("isbn"), "isbn")
            .join(t.booksubject, "isbn").join(subject, "subject_id").select("patron_id", "s", "isbn").collect())
    loans, books = Counter((r[0], r[1]) for r in rows), {(r[0], r[1]): set() for r in rows}
    for r in rows:
        books[r[0], r[1]].add(r[2])
    want = {(p, s, n, len(books[p, s])) for (p, s), n in loans.items()}
    assert {(r["patron_id"], r["subject_name"], r["loan_count"], r["unique_books"]) for r in got.collect()} == want
    text = plan(got)
    assert text.index("Generate inline") < text.index("REPARTITION_BY_NUM") and "count(distinct" not in text


def test_changes_are_made_in_one_pass(spark):
    """inserts and updates are not a union, which would make the loans twice."""
    t = fixture_tables(spark)
    changes = S.loan_changes(t)
    assert "Union" not in plan(changes)
    rows = {(r["loan_id"], r["op"], r["at"], r["return_ts"]) for r in changes.collect()}
    loans = t.loan.collect()
    assert rows == {(r["loan_id"], "insert", r["loan_ts"], None) for r in loans} | {
        (r["loan_id"], "update", r["return_ts"], r["return_ts"]) for r in loans if r["return_ts"]}


def test_lag_numbers_only_large_partitions(spark, monkeypatch):
    """a window where a task can hold the partition, positions where it cannot, null partitions too."""
    df = spark.createDataFrame([(p, i % 3, i) for p, n in ((1, 2), (2, 9), (None, 8), (3, 1)) for i in range(n)],
                               "p long, s long, id long")
    order = [("s", False), ("id", False)]
    want = []
    for p in (1, 2, None, 3):
        rows = sorted((r["s"], r["id"]) for r in df.collect() if r["p"] == p)
        want += [(p, s, i, b[1] if b else None) for (s, i), b in zip(rows, [None, *rows])]
    for limit in (1, 5, 100):
        got = ranking.lag_within(df, ["p"], order, "id", "prev", limit)
        assert Counter(tuple(r) for r in got.collect()) == Counter(want)

    twice = df.unionAll(df.filter("id < 2"))  # rows that share a key: the same rows on either path
    assert Counter(ranking.lag_within(twice, ["p"], order, "id", "prev").collect()) == Counter(
        ranking.lag_within(twice, ["p"], order, "id", "prev", 0).collect())

    def never(*a):
        raise AssertionError("numbered")

    monkeypatch.setattr(ranking, "prefix_counts", never)
    ranking.lag_within(df, ["p"], order, "id", "prev")


def test_loans_are_shuffled_without_a_regrouping(spark):
    """F8, F9: no shuffle of the loans by (patron, copy); the wide columns come last."""
    t = fixture_tables(spark)
    for df in (R.d05_loans_segmented(t, AS_OF), Q.q19_repeat_borrowers(t)):
        assert not re.search(r"hashpartitioning\(patron_id#\d+L, copy_id#", plan(df))
    assert re.search(r"hashpartitioning\(patron_id#\d+L, isbn#\d+, \d+\), REPARTITION_BY_NUM", plan(Q.q19_repeat_borrowers(t)))


def test_lines_are_shuffled_once(projected):
    """F6 to F9: distinct lines arrive where their orders do."""
    text = plan(projected.loan)
    assert len(re.findall(r"Exchange \w+\(?l_orderkey|Exchange SinglePartition, REPARTITION|hashpartitioning\(l_orderkey", text)) == 1
