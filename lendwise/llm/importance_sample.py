"""Importance resampling towards a target distribution, on hashed n-gram features.

Reading a text: a 256-byte table lower-cases A-Z and blanks every separator in the UTF-8 bytes, ``bytes.split`` yields
the words, and zlib.crc32, given the hash of the words before as its seed, extends an n-gram by a word. Counters reduce
a batch to its distinct n-grams before anything is hashed, and a task to one row per bucket.

Three passes of Spark jobs: features per bucket of the raw and of the target texts, over all rows; a gain per bucket from
the two counts; a weight per document, the sum of the gains of its features. With Gumbel noise from the document's id the
highest scores are a sample without replacement (Gumbel top-k). The order of the scores comes from range partitions of
narrow rows, a row number inside each and the offsets of the partitions, never from one sorted task.

Cases: a null text has no words; documents of fewer than ``MIN_WORDS`` words have a weight and a score but no rank; ties
go to the smaller doc_id; a null doc_id hashes as the empty string and stands after all others; repeated rows are
documents of their own with equal scores and ranks that follow each other; empty tables give counts of zero (gains of
zero if both are empty); a text of any length is read whole, one at a time; only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendwise.llm.common import materialize

LONGEST, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20
CACHE = 1 << 18  # words whose hash a task remembers

TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Features:
    """Buckets of the n-grams of up to ``longest`` words; hashes of single words are remembered."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS):
        self.longest, self.buckets, self.known = longest, buckets, {}

    def count(self, words: list[bytes]) -> Counter:
        """Features per bucket, repeats counted."""
        found: Counter = Counter()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w, n in Counter(words).items():
            h = known.get(w)
            if h is None:
                h = known[w] = zlib.crc32(w)
            found[h % self.buckets] += n
        if self.longest > 1:
            seeds = [known[w] for w in words]
            for length in range(2, min(self.longest, len(words)) + 1):
                # the hash of the words before is the seed of the next: crc32(b" " + w, crc32(before))
                seeds = [zlib.crc32(b" " + w, h) for h, w in zip(seeds, words[length - 1:])]
                found.update(h % self.buckets for h in seeds)
        return found


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all texts per bucket; at most ``buckets`` numbers reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]):
        features, total = Features(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for b, n in features.count(words(text.as_py())).items():
                    total[b] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    parts = texts.select("text").mapInArrow(task, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(target share / raw share)) per bucket, each count raised by one."""
    s, t = sum(raw.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((raw.get(b, 0) + 1) * (t + buckets))))
                     for b in range(buckets)], np.int64)


def weights(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight per document row. ``gain`` has one number per bucket."""
    buckets = len(gain)

    def task(batches: Iterator[pa.RecordBatch]):
        features = Features(longest, buckets)
        value = gain.tolist()
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(1):
                found = words(text.as_py())
                counts = features.count(found)
                n_words.append(len(found))
                n_features.append(sum(counts.values()))
                weight.append(sum(value[b] * n for b, n in counts.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, n_words long, n_features long, weight long")


def with_scores(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score = weight + Gumbel noise in thousandths; the noise is a function of seed and doc_id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return weighted.withColumn("score", F.col("weight") + noise)


def with_ranks(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds rank to the ``percent`` per cent of the rows of ``min_words`` words or more that score highest."""
    spark = scored.sparkSession
    # a number per row, fixed by writing it, parts rows that are equal in everything else
    rows = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    able = rows.filter(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the range of each row is fixed by writing it too: a lost executor cannot draw other ranges for the recount
    ranged = materialize(able.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # a number per partition
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    drawn = before * percent // 100
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))  # a row per partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = ranged.join(starts, "part").withColumn("place", place)
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("part", "before", "place")
    rest = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("row")


def resample(documents: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``documents``; the texts of ``target`` give the
    distribution that is drawn towards."""
    gain = gains(bucket_counts(documents, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    return with_ranks(with_scores(weights(documents, gain, longest), seed), percent)


def sample(documents: DataFrame, target: DataFrame) -> DataFrame:
    """The query's columns."""
    return resample(documents, target).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = rf"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
toks AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (),
         regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
per AS (SELECT side, r, w, count(*) AS n FROM (SELECT side, r, unnest(ws) AS w FROM toks) GROUP BY side, r, w),
vocab AS (SELECT DISTINCT w FROM per),
coded AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda i:
                  CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
                lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM vocab, crc_table),
counts AS (
  SELECT bucket, sum(n) FILTER (WHERE side = 'd') AS s, sum(n) FILTER (WHERE side = 'b') AS t
  FROM per JOIN coded USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + {BUCKETS}) AS DOUBLE)
                                      / CAST((coalesce(s, 0) + 1) * (tt + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS g
  FROM counts, totals),
weighed AS (SELECT r, sum(n) AS n, sum(n * g) AS weight FROM per JOIN coded USING (w) JOIN gain USING (bucket)
            WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT id AS doc_id, toks.r, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM toks LEFT JOIN weighed USING (r) WHERE side = 'd'),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS able
           FROM noisy WHERE n_features >= {MIN_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN place <= {PERCENT} * able // 100 THEN place END AS "rank"
FROM noisy LEFT JOIN placed USING (r)
"""
