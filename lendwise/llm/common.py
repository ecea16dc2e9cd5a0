"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwise.session import ensure_checkpoint_dir

# A word is a run of ASCII letters, ASCII digits and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # in a text whose A-Z are lower-cased
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # in any text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read back: lineage ends there, a lost
    executor costs only a re-read, and the planner knows the real size (it broadcasts only what is small enough)."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text in order, in their own letter case; a null text has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), BETWEEN_WORDS), "")


def text_key(c: Column) -> Column:
    """128-bit key of a text; equal texts share one, a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))


def hashed_sample(df: DataFrame, column: str, n: int) -> DataFrame:
    """About ``n`` rows, those whose hash of ``column`` lies below a share of the hash space; all rows if there are no
    more than ``n``. A filter, so no task gathers a sorted prefix of every other task; rows that repeat one value are
    in or out together, and 2 n is the most that is returned."""
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(column), F.lit(1 << 32)) < int((1 << 32) * n / total)).limit(2 * n)


def held_out(c: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(c: Column) -> Column:
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 != 0, F.lit(False))
