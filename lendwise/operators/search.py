"""Case- and accent-insensitive substring search over titles and ISBNs by trigram postings (P-06, F-14).

The index is two tables stored with the books:

* ``texts``: isbn, title and, per searched field, its folded text (lower case, accents removed, no trailing spaces);
* ``postings``: (field, trigram, isbn), one row per distinct trigram of a folded text, partitioned by a hash bucket of the
  trigram and sorted by it, so a needle's trigrams are a few buckets (partition filter) and in those a few row groups
  (pushed filter). A frequent trigram is dealt over several files of its bucket.

A needle is folded the same way. As in LIKE, '%' and '_' in it are wildcards. Every run of literal characters gives its
trigrams; a book is a candidate if one of its fields has them all, and the pattern itself is tested on the candidates'
folded texts last. A needle without a literal run of three characters has no trigram and tests every folded text.

Cases: a null text has no postings and matches nothing; a null or empty needle matches every book (no filter); repeated
books are found as often as they are stored; an empty table gives an empty index and no matches.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwise.sources.tables import spread, tasks_for

FIELDS = ("title", "isbn")
BUCKETS, SPREAD = 64, 8
GRAMS = 16  # postings that a book is taken to have when their number of partitions is chosen


def _fold_table(limit: int = 0x2E80) -> tuple[str, str]:
    """Lower-case letters below ``limit`` whose canonical form is a letter with marks, and those letters."""
    pairs = {}
    for code in range(0x80, limit):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and all(unicodedata.combining(m) for m in base[1:]) and c == c.lower():
            pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _fold_table()
MARKS = "[̀-ͯ]"  # fixed values: combining marks of decomposed letters


def fold(c: Column) -> Column:
    """Lower case, without accents and trailing spaces."""
    return F.rtrim(F.regexp_replace(F.translate(F.lower(c), _MARKED, _PLAIN), MARKS, ""))


def fold_text(needle: str) -> str:
    """``fold`` of a needle; its trailing spaces stay, since text may follow the match."""
    low = needle.lower().translate(str.maketrans(_MARKED, _PLAIN))
    return re.sub(MARKS, "", low)


def trigrams(needle: str) -> list[str]:
    """Trigrams of the literal runs of a LIKE needle, folded; empty if no run has three characters."""
    runs = re.split("[%_]", fold_text(needle))
    return sorted({r[i:i + 3] for r in runs for i in range(len(r) - 2)})


def like_pattern(needle: str) -> str:
    """The LIKE pattern of 'contains needle'; a backslash in the needle is a plain character."""
    return "%" + fold_text(needle).replace("\\", "\\\\") + "%"


def matches(folded: Column, needle: str) -> Column:
    return folded.like(like_pattern(needle))


def _grams(c: Column) -> Column:
    n = F.char_length(c)
    at = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(c, i, F.lit(3))))


def _postings_of(field: int) -> Column:
    """Array of (field, trigram) of a book."""
    grams = _grams(F.coalesce(F.col(f"folded_{FIELDS[field]}"), F.lit("")))
    return F.transform(grams, lambda g: F.struct(F.lit(field).alias("field"), g.alias("trigram")))


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class TitleIndex:
    """A stored index; ``write`` makes it, ``search`` reads what a needle needs of it."""

    root: str
    buckets: int = BUCKETS

    def write(self, books: DataFrame) -> TitleIndex:
        """Stores texts and postings of ``books`` (isbn, title), replacing what is there."""
        folded = [fold(F.col(f).cast("string")).alias(f"folded_{f}") for f in FIELDS]
        books.select("isbn", "title", *folded).write.mode("overwrite").parquet(f"{self.root}/texts")
        texts = self.texts(books.sparkSession)
        grams = F.explode(F.flatten(F.array(*[_postings_of(k) for k in range(len(FIELDS))]))).alias("g")
        # the texts are dealt out before their trigrams are made: a few MB of them would be read, and made distinct, by one task
        tasks = tasks_for(books.sparkSession, GRAMS * texts.count())
        rows = spread(texts.filter("isbn IS NOT NULL"), "isbn", tasks=tasks).select("isbn", grams)
        rows = rows.select("g.field", "g.trigram", "isbn").distinct().withColumn("bucket", _bucket(F.col("trigram"), self.buckets))
        (spread(rows, "bucket", F.pmod(F.xxhash64("isbn"), F.lit(SPREAD)), tasks=tasks).sortWithinPartitions("bucket", "trigram", "isbn")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings"))
        return self

    def texts(self, spark: SparkSession) -> DataFrame:
        kinds = ", ".join(f"folded_{f} string" for f in FIELDS)
        return spark.read.schema(f"isbn string, title string, {kinds}").parquet(f"{self.root}/texts")

    def postings(self, spark: SparkSession, grams: list[str]) -> DataFrame:
        """The postings of some trigrams: their buckets, and of those their rows."""
        # the bucket numbers are literals, so that the scan is pruned when it is planned
        row = spark.range(1).select(*[_bucket(F.lit(g), self.buckets).alias(str(k)) for k, g in enumerate(grams)]).first()
        rows = spark.read.schema("field int, trigram string, isbn string, bucket int").parquet(f"{self.root}/postings")
        return rows.filter(F.col("bucket").isin(sorted(set(row))) & F.col("trigram").isin(grams))

    def candidates(self, spark: SparkSession, needle: str) -> DataFrame | None:
        """ISBNs of which a field has all trigrams of the needle; None if it has no trigram."""
        grams = trigrams(needle)
        if not grams:
            return None
        hits = self.postings(spark, grams).groupBy("isbn", "field").agg(F.count(F.lit(1)).alias("n"))
        return hits.filter(F.col("n") == len(grams)).select("isbn").distinct()

    def search(self, spark: SparkSession, needle: str | None) -> DataFrame:
        """isbn and title of the books with a field that contains the needle."""
        texts = self.texts(spark)
        if needle:
            found = self.candidates(spark, needle)
            texts = texts if found is None else texts.join(found, "isbn", "left_semi")
            hit = matches(F.col(f"folded_{FIELDS[0]}"), needle)
            for f in FIELDS[1:]:
                hit = hit | matches(F.col(f"folded_{f}"), needle)
            texts = texts.filter(hit)
        return texts.select("isbn", "title")


def search_all(index: TitleIndex, spark: SparkSession, needles: list[str]) -> DataFrame:
    """needle, isbn, title of the matches of several needles."""
    parts = [index.search(spark, n).select(F.lit(n).alias("needle"), "isbn", "title") for n in needles]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
