import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import warc

PAGES = "page_id long, url string, html string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 666\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
BIG = "é" * 700
ROWS = [(1, "http://a", BIG), (2, "http://b", BIG), (3, None, BIG), (4, "http://c\r\nX-Page-Id: 9", "small"), (5, "u", "small"),
        (6, "http://WARC/1.1", None), (7, "u", ""), (8, "u", "text\r\n\r\n" + FAKE + "more\n" + FAKE * 3 + "end"),
        (9, "u", "\n" + FAKE), (10, "u", FAKE * 40), (11, "u", FAKE * 40), (12, "u", "x" * 300_000 + "\n" + FAKE + "y" * 90_000),
        (None, "u", BIG), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (13, "u", "\nWARC/1."), (14, "u", "\r\n\r\n\r\n"),
        (15, "u", "rep" * 400), (15, "u", "rep" * 400), (16, "u", "WARC/1.1\r\n" * 300 + "\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n")]
COLS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def expected(rows):
    data = [(p, (h or "").encode()) for p, h in rows]
    out = []
    for p, b in data:
        same = [q for q, c in data if c == b]
        keep = max((q for q in same if q is not None), default=None) if len(b) >= 1000 and len(same) > 1 else None
        again = keep is not None and p != keep
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", ["128m", "40k", "3k"])
def test_round_trip(spark, block):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'x' AS file", "1 AS start", "'y' AS digest").coalesce(1)
    path = warc.shared_path(spark, "warc-test")
    warc.write_archives(pages, path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = H.rows_of(warc.read_archives(spark, path), *COLS)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == expected([(r[0], r[2]) for r in ROWS])


def test_foreign_archive(spark, tmp_path):
    """Older version, reordered fields, a record cut off at the end of the file."""
    good = b"WARC/1.0\r\nContent-Length: 5\r\nWARC-Type: resource\r\nX-Page-Id: 1\r\n\r\nhello\r\n\r\n"
    cut = b"WARC/1.0\r\nContent-Length: 50\r\nWARC-Type: resource\r\n\r\nhello"
    (tmp_path / "a.warc").write_bytes(good + good + cut)
    (tmp_path / "b.warc").write_bytes(b"junk\n" + good)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in got] == [(1, 5, "resource")] * 2


def test_oracle_and_empty(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{H.SF}/pages.parquet'")
    got = H.rows_of(warc.round_trip(spark.read.parquet(f"{H.SF}/pages.parquet")), *COLS)
    assert got == sorted(con.execute(warc.ORACLE).fetchall(), key=repr)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_ids_over_the_whole_long_range(spark):
    ids = [2 ** 63 - 1, -2 ** 63, 1234567890123456789, -1234567890123456789, 10 ** 18]
    rows = [(i, f"http://h/{i}", "x" * 2000) for i in ids]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(r.page_id for r in out) == sorted(ids)
    assert {r.page_id: r.refers_to for r in out} == {i: None if i == max(ids) else max(ids) for i in ids}
    assert warc._number("9223372036854775808") is None
