"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of 13 consecutive words is represented by the smallest of its seven 7-word hashes. Equal windows pick
equal hashes, so joining the chosen hashes of documents and benchmark finds every shared span of 13 or more words;
neighbouring windows mostly choose the same hash, so only about a quarter of the hashes travel. Hits are then
extended: the 13-word windows at the matching places are compared word for word. An item of fewer than 13 words is
one window of its own length L; it is found with hash length L and a winnowing window of one.

Cases: a null text has no words; an item without words has no windows; a null item_id adds hits but is not counted
as an item; repeated document rows each get their row; repeated item rows count once per item_id; empty tables give
empty or hit-free results; a text of any length is read whole, its windows are compared in one task; only doc_id,
item_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import ascii_lower, materialize, text_key, words

SPAN = 13  # guaranteed span, words
GRAM = 7   # hash length; winnowing window = SPAN - GRAM + 1
BUCKETS = 1 << 20  # hash buckets of candidate texts that are broadcast: at most so many numbers


def _pairs(df: DataFrame, src: str, dst: str, gap: int, combine) -> DataFrame:
    """dst[i] = combine(src[i], src[i + gap]) for every i that has both."""
    n = F.greatest(F.size(src) - gap, F.lit(0))
    return df.withColumn(dst, F.zip_with(F.slice(src, 1, n), F.slice(src, gap + 1, n), combine))


def _rolling(df: DataFrame, src: str, dst: str, width: int, combine) -> DataFrame:
    """dst[i] = combine over src[i .. i + width - 1], built by doubling; a last, overlapping step reaches width."""
    have, cur, made = 1, src, []
    while have < width:
        gap = min(have, width - have)
        nxt = dst if have + gap == width else f"{dst}_{have + gap}"
        df = _pairs(df, cur, nxt, gap, combine)
        made.append(nxt)
        have, cur = have + gap, nxt
    return df.drop(*made[:-1]) if width > 1 else df.withColumn(dst, F.col(src))


def with_fingerprints(df: DataFrame, words_col: str, lengths: list[int], keep: tuple[str, ...]) -> DataFrame:
    """Adds, for each window length L, the array ``__fp_L`` whose element i is the fingerprint of the window that
    starts at word i. Keeps only the columns named in ``keep``."""
    df = df.withColumn("__h", F.transform(words_col, lambda w: F.xxhash64(F.lower(w)))).select(*keep, "__h")
    mix = lambda a, b: F.xxhash64(a, b)
    for length in lengths:
        gram = GRAM if length == SPAN else length
        df = _rolling(df, "__h", "__g", gram, mix)
        out = f"__fp_{length}"
        df = _rolling(df, "__g", out, length - gram + 1, lambda a, b: F.least(a, b)).drop("__g")
        if length != SPAN:
            df = df.withColumn(out, F.transform(out, lambda x: F.xxhash64(x, F.lit(length))))
    return df.drop("__h")


def _benchmark_windows(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", ascii_lower(F.col("text")).alias("text"))
    items = items.select("item_id", words(F.col("text")).alias("__w")).filter(F.size("__w") > 0)
    return items.select("item_id", "__w", F.least(F.size("__w"), F.lit(SPAN)).alias("length"))


def _positions(length_col: Column, pick: Column) -> Column:
    """(start, window text) structs of the windows at the starts in ``pick``; __w is referenced twice on purpose, so
    that the planner keeps it as a column and does not recompute it per element."""
    return F.transform(pick, lambda i: F.struct(
        i.alias("start"), F.when(F.size("__w") > 0, F.array_join(F.slice("__w", i + 1, length_col), " ")).alias("window")))


def benchmark_index(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(fingerprint rows, window rows, window lengths in use). The lengths are at most 13 numbers."""
    spans = _benchmark_windows(benchmark)
    starts = F.sequence(F.lit(0), F.size("__w") - F.col("length"))
    windows = spans.withColumn("__p", _positions(F.col("length"), starts)).select(
        "item_id", "length", F.explode("__p.window").alias("window"))
    # a window stands for its list of items; windows of the same items share the list
    windows = windows.groupBy("length", "window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    windows = materialize(windows.withColumn("list", F.xxhash64("items")), "bench-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    # explode_outer: a plain explode adds a size filter, which the optimizer would push down through every step of the
    # rolling hashes, repeating their expressions once per reference
    prints = with_fingerprints(spans, "__w", lengths, ("length",))
    parts = [prints.filter(F.col("length") == n).select(F.explode_outer(f"__fp_{n}").alias("fp"))
             .filter("fp IS NOT NULL") for n in lengths]
    fps = parts[0] if parts else windows.select(F.lit(0).cast("long").alias("fp")).limit(0)
    for p in parts[1:]:
        fps = fps.unionAll(p)
    return materialize(fps.distinct(), "bench-fps"), windows, lengths


def text_hits(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, text key, n_words; hits: text key, start, length, item list for each matching window; lists: the items
    of each list). The documents are read twice, whatever the number of window lengths."""
    fps, windows, lengths = benchmark_index(benchmark)
    docs = documents.select("doc_id", text_key(F.col("text")).alias("__t"), words(F.col("text")).alias("__w"))
    docs = docs.withColumn("n_words", F.size("__w").cast("long"))
    docs = with_fingerprints(docs, "__w", lengths, ("doc_id", "__t", "n_words"))
    cols = [F.col(f"__fp_{n}") for n in lengths]
    chosen = F.array_distinct(F.concat(*cols)) if cols else F.array().cast("array<bigint>")
    rows = materialize(docs.select("doc_id", "__t", "n_words", chosen.alias("__fp")), "doc-fps")

    found = rows.select("__t", F.explode("__fp").alias("fp")).join(fps, "fp").groupBy("__t").agg(
        F.collect_set("fp").alias("__match"))
    found = materialize(found, "doc-candidates")

    # most texts are no candidates: a bounded broadcast of the candidates' hash buckets keeps them out of the shuffle, and
    # the copies of a text are reduced map-side, so a text that a third of all rows repeat is a row per task
    bucket = F.pmod(F.xxhash64("__t"), F.lit(BUCKETS)).alias("bucket")
    buckets = F.broadcast(found.select(bucket).distinct())
    texts = documents.select(text_key(F.col("text")).alias("__t"), "text").select("*", bucket).join(
        buckets, "bucket", "left_semi").select("__t", "text").dropDuplicates(["__t"]).join(found, "__t")
    texts = materialize(texts.select("__t", "__match", words(ascii_lower(F.col("text"))).alias("__w")), "candidate-texts")
    # all window lengths in one pass over the candidates
    marked = with_fingerprints(texts, "__w", lengths, ("__t", "__match", "__w"))
    at = [F.transform(F.filter(F.transform(f"__fp_{n}", _matched), lambda x: x.isNotNull()), _window(n)) for n in lengths]
    none = F.array().cast("array<struct<length:int,start:int,window:string>>")
    places = marked.select("__t", F.explode_outer(F.concat(none, *at)).alias("p")).select("__t", "p.*")
    hits = places.join(windows, ["length", "window"]).select("__t", "start", "length", "list")
    return rows.drop("__fp"), materialize(hits, "window-hits"), windows.select("list", "items").dropDuplicates(["list"])


def _matched(print_: Column, i: Column) -> Column:
    return F.when(F.array_contains("__match", print_), i)


def _window(length: int):
    """(length, start, window text) at a start; __w is referenced twice on purpose, so that the planner keeps it as a
    column and does not recompute it per element."""
    return lambda i: F.struct(F.lit(length).alias("length"), i.alias("start"), F.when(
        F.size("__w") > 0, F.array_join(F.slice("__w", i + 1, length), " ")).alias("window"))


def _covered(spans: Column) -> Column:
    """Number of words in the union of (start, length) spans, given sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        end = (s["start"] + s["length"]).cast("long")
        return F.struct(F.greatest(acc["upto"], end).alias("upto"),
                        (acc["n"] + F.greatest(end - F.greatest(acc["upto"], s["start"].cast("long")), F.lit(0)))
                        .cast("long").alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, hits, lists = text_hits(documents, benchmark)
    covered = hits.groupBy("__t").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("__s"))
    # each list of items comes to a text once, however many windows share it
    items = hits.select("__t", "list").distinct().join(lists, "list").groupBy("__t").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__i"))
    per_text = covered.join(items, "__t").select("__t", _covered(F.col("__s")).alias("n_hit"), F.size("__i").cast("long").alias("n_items"),
                               F.sha2(F.array_join("__i", ",").cast("binary"), 256).alias("items_sha256"))
    out = rows.join(materialize(per_text, "doc-hits"), "__t", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, same columns, that are not contaminated. Only the contaminated texts' keys travel to the
    documents; repeated rows share their text's verdict."""
    rows, hits, _ = text_hits(documents, benchmark)
    covered = hits.groupBy("__t").agg(_covered(F.sort_array(F.collect_set(F.struct("start", "length")))).alias("n_hit"))
    words_of = rows.select("__t", "n_words").join(covered, "__t").filter("20 * n_hit >= n_words")
    bad = materialize(words_of.select("__t").distinct(), "contaminated")
    names = [F.col(f"`{c}`") for c in documents.columns]
    return documents.select(*names, text_key(F.col("text")).alias("__t")).join(bad, "__t", "left_anti").select(*names)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, win)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit
           FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items,
            sha256(coalesce(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '')) AS items_sha256
          FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""
