"""Micro-batch admission over a file stream equals the batch rule over the same rows in the same order."""

import tempfile

from pyspark.sql import functions as F

from lendwise.operators.admission import t01_admit_loans
from lendwise.sources.schemas import TABLES
from lendwise.streaming import start_admission_stream


def test_stream_equals_batch(spark, projected):
    root = tempfile.mkdtemp(prefix="lendwise-stream-")
    loans = projected.loan.select(*[c.name for c in TABLES["loan"].columns])
    cuts = ["1997-01-01", "1999-01-01"]
    parts = [loans.filter(F.col("loan_ts") < cuts[0]),
             loans.filter((F.col("loan_ts") >= cuts[0]) & (F.col("loan_ts") < cuts[1])),
             loans.filter(F.col("loan_ts") >= cuts[1])]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{root}/in/{i}")
    # one file per micro-batch, in time order
    import glob
    import os
    import shutil
    os.makedirs(f"{root}/src")
    for i in range(3):
        for j, f in enumerate(sorted(glob.glob(f"{root}/in/{i}/*.parquet"))):
            shutil.copy(f, f"{root}/src/{i:02d}-{j}.parquet")
            os.utime(f"{root}/src/{i:02d}-{j}.parquet", (1000 + i, 1000 + i))
    stream = (spark.readStream.schema(TABLES["loan"].schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{root}/src"))
    q = start_admission_stream(stream, "loan", f"{root}/table", f"{root}/quarantine", f"{root}/ckpt")
    q.awaitTermination(300)
    accepted = spark.read.parquet(f"{root}/table").select("loan_id")
    rejected = spark.read.parquet(f"{root}/quarantine").select("loan_id")
    want = t01_admit_loans(loans)
    assert accepted.count() + rejected.count() == loans.count()
    assert accepted.exceptAll(want.filter("accepted").select("loan_id")).count() == 0
    assert want.filter("accepted").select("loan_id").exceptAll(accepted).count() == 0


def test_session_stream_equals_batch(spark, projected):
    import glob
    import os
    import shutil

    from lendwise.operators.admission import t05_admit_sessions

    root = tempfile.mkdtemp(prefix="lendwise-stream-s-")
    ses = projected.accesssession.select(*[c.name for c in TABLES["accesssession"].columns])
    cuts = ["2024-01-01 08:00:00", "2024-01-01 16:00:00"]
    parts = [ses.filter(F.col("start_time") < cuts[0]),
             ses.filter((F.col("start_time") >= cuts[0]) & (F.col("start_time") < cuts[1])),
             ses.filter(F.col("start_time") >= cuts[1])]
    os.makedirs(f"{root}/src")
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{root}/in/{i}")
        for j, f in enumerate(sorted(glob.glob(f"{root}/in/{i}/*.parquet"))):
            shutil.copy(f, f"{root}/src/{i:02d}-{j}.parquet")
            os.utime(f"{root}/src/{i:02d}-{j}.parquet", (1000 + i, 1000 + i))
    stream = (spark.readStream.schema(TABLES["accesssession"].schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{root}/src"))
    q = start_admission_stream(stream, "accesssession", f"{root}/table", f"{root}/quarantine", f"{root}/ckpt",
                               eresource=projected.eresource, license_=projected.license, now="2024-02-01")
    q.awaitTermination(300)
    accepted = spark.read.parquet(f"{root}/table").select("session_id")
    want = t05_admit_sessions(ses, projected.eresource, projected.license, now="2024-02-01").filter("accepted").select("session_id")
    assert accepted.exceptAll(want).count() == 0 and want.exceptAll(accepted).count() == 0


def test_state_without_batch_ids_and_missing_state(spark, projected):
    """Rows appended by a batch job count as state; a state folder that has gone is an error after the first batch."""
    import datetime as dt

    import pytest

    from lendwise.sources.tables import from_rows
    from lendwise.streaming import admission_batch_writer

    root = tempfile.mkdtemp(prefix="lendwise-stream-b-")
    at = dt.datetime(2001, 1, 1)
    from_rows(spark, "loan", [(1, 7, 1, at, at + dt.timedelta(days=9), None)]).write.parquet(f"{root}/table")
    batch = from_rows(spark, "loan", [(2, 7, 1, at + dt.timedelta(days=1), at + dt.timedelta(days=9), None)])
    admission_batch_writer("loan", f"{root}/table", f"{root}/away")(batch, 0)
    assert [r["loan_id"] for r in spark.read.parquet(f"{root}/away").collect()] == [2]
    admission_batch_writer("loan", f"{root}/fresh", f"{root}/away2")(batch, 0)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        admission_batch_writer("loan", f"{root}/nowhere", f"{root}/away3")(batch, 1)
