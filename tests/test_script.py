"""INSERT scripts: written and read back over many splits; the statement forms of a hand-written script."""

import datetime as dt
import random
import tempfile
from decimal import Decimal

import pytest

from lendwise.sources import script as S
from lendwise.sources.tables import from_rows

NASTY = ["O'Neil", 'say "x"', "a\nb", "a\r\nb\n", "; -- no; comment", "/* no */", "x'); DROP (", "\\", "\\'", "'", "''", "NULL", " ", "",
         "(((", "漢字 é", "#x", "tab\there", "INSERT INTO author (a) VALUES (1)", "-- ", "`b`", "end\\n"]


@pytest.fixture(params=[37, 64, 1 << 20])
def split(request, spark):
    """Bytes per file split."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_round_trip(spark, split):
    rng = random.Random(split)
    rows = [(k, rng.choice(NASTY) + rng.choice(NASTY), rng.choice(NASTY)) for k in range(60)]
    path = tempfile.mkdtemp(prefix="lendwise-script-") + "/s"
    S.write_script(from_rows(spark, "author", rows).coalesce(2), "author", path)
    got = S.load_script(spark, "author", path)
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
    if split < 100:
        assert spark.read.text(path).rdd.getNumPartitions() > 20
    assert S.load_script(spark, "book", path).collect() == []


SCRIPT = """-- it's a comment (with a parenthesis
USE x; CREATE TABLE Author (author_id INT, note VARCHAR(3) DEFAULT ')');
/* a block; comment '
   over lines */
INSERT INTO Author (author_id, first_name, last_name) VALUES
(1, 'Ann', 'O''Neil'), -- first
(2, 'B\\'s', 'semi;colon'),
(3,
 'line
break (', NULL);
insert into `Author` (`last_name`, "author_id") values ("dou""ble", 4);
INSERT INTO author VALUES (5, 'x', 'y'), (6, NOW(), 'z') ;
INSERT INTO Patron (patron_id, first_name, balance) VALUES (1, 'p', 12.50), (2, 'q', -0.5);
DELETE FROM Author WHERE author_id IN (1, 2);
# INSERT INTO Author VALUES (7, 'no', 'no');
INSERT INTO Loan (loan_id, copy_id, patron_id, loan_ts, due_ts, return_ts) VALUES
(1, 2, 3, '2001-01-02 03:04:05', '2001-02-02', NULL)"""


def test_statement_forms(spark, split):
    path = tempfile.mkdtemp(prefix="lendwise-script-") + "/s.sql"
    with open(path, "w") as f:
        f.write(SCRIPT)
    authors = sorted(((r["author_id"], r["first_name"], r["last_name"]) for r in S.load_script(spark, "author", path).collect()))
    assert authors == [(1, "Ann", "O'Neil"), (2, "B's", "semi;colon"), (3, "line\nbreak (", None), (4, None, 'dou"ble'),
                       (5, "x", "y"), (6, "NOW()", "z")]
    patrons = S.load_script(spark, "patron", path).select("patron_id", "first_name", "balance", "email").collect()
    assert sorted(map(tuple, patrons)) == [(1, "p", Decimal("12.50"), None), (2, "q", Decimal("-0.50"), None)]
    loan = S.load_script(spark, "loan", path).collect()
    assert [tuple(r) for r in loan] == [(1, 2, 3, dt.datetime(2001, 1, 2, 3, 4, 5), dt.datetime(2001, 2, 2), None)]


def test_bad_values(spark):
    root = tempfile.mkdtemp(prefix="lendwise-script-")
    with open(f"{root}/s.sql", "w") as f:
        f.write("INSERT INTO author (author_id, first_name, last_name) VALUES ('many', 'a', 'b'), (2, 'c', 'd');")
    with pytest.raises(Exception, match="author.author_id is not a bigint: many"):
        S.load_script(spark, "author", f"{root}/s.sql").collect()
    assert S.load_script(spark, "author", f"{root}/s.sql", quarantine=f"{root}/away").count() == 1
    assert spark.read.parquet(f"{root}/away").first()["bad"] == ["author_id"]
    with open(f"{root}/t.sql", "w") as f:
        f.write("INSERT INTO author (author_id, first_name) VALUES (1, 'a', 'b');")
    with pytest.raises(Exception, match="3 values for 2 columns"):
        S.load_script(spark, "author", f"{root}/t.sql").collect()
    open(f"{root}/empty.sql", "w").close()
    assert S.load_script(spark, "author", f"{root}/empty.sql").collect() == []
