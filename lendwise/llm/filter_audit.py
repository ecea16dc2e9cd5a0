"""Audit of text filters that are applied one after the other, in every order, with duplicates found in radix tries.

Every document gets a mask of the filters that it fails. Four depend on its own text. The fifth fails a document if a
smaller doc_id anywhere in the table has the identical text, and is found without hashing texts:

* The ranges are adaptive text prefixes: quantiles of the texts' first bytes part the key space, and a prefix that holds
  more than its share is lengthened to where its texts fork and parted again by the quantiles of the bytes there, level
  by level. The splitters are a list of byte strings of different lengths, at most a few per range.
* Each task inserts the texts of a bounded batch into a compressed trie whose terminals hold the smallest doc_id. A row
  above its terminal's minimum fails already; it travels on without its text. One row per distinct text keeps it, so a
  group of copies of any size sends its range about a row per task.
* The texts of a range meet in one trie of full texts, and the walk over the rows flags those above the minimum of their
  terminal.

The masks are counted per part and per label, and the counts of the 32 masks answer all 120 orders: what is left after
filters S is the number of masks disjoint from S.

Cases: a null text is empty, and equal to an empty one; a null doc_id neither fails by another's id nor makes others
fail; rows of one doc_id and text are not duplicates of each other; a null source is the part ''; a document with several
label rows has a label if one of them says so; labels of a null doc_id are ignored; a text of any length is inserted
whole; an empty table gives no rows; only doc_id, text and source are read, whatever other columns are called.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import islice, permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
NARROW = [("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())]
DUPLICATE = 1 << FILTERS.index("E")
BATCH_BYTES, BATCH_ROWS = 32 << 20, 1 << 16  # texts that a task's trie holds before it is emptied
RANGES_PER_PARTITION = 4
STEP, AHEAD = 6, 1024  # bytes whose quantiles part a prefix (a double holds them exactly), bytes searched for where it forks
LEVELS, HEAVY = 12, 64  # these bound the jobs and the size of a level; beyond them a range is larger, its rows are the same


def own_mask(text: str) -> int:
    """Filters A to D that a text fails, as bits."""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()  # ASCII white space only
    mask = 1 if len(found) < FEW_WORDS else 0
    if 100 * len(set(found)) < DISTINCT_PERCENT * len(found):
        mask |= 2
    if 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text):
        mask |= 4
    if len(raw) != len(raw.translate(None, MARKS)):
        mask |= 8
    return mask


class Trie:
    """Compressed trie of byte strings; a terminal holds the smallest id inserted there."""

    __slots__ = ("edges", "low")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Trie]] = {}  # by first byte: the edge's bytes and the node below
        self.low = None

    def insert(self, text: bytes, key) -> Trie:
        """The terminal of ``text``, its minimum lowered to ``key``."""
        node, at = self, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                below = Trie()
                node.edges[text[at]] = (text[at:], below)
                node, at = below, len(text)
                break
            label, below = edge
            if not text.startswith(label, at):
                same = _shared(label, text, at)
                middle = Trie()
                middle.edges[label[same]] = (label[same:], below)
                node.edges[text[at]] = (label[:same], middle)
                label, below = label[:same], middle
            node, at = below, at + len(label)
        if key is not None and (node.low is None or key < node.low):
            node.low = key
        return node


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and ``text[at:]``, by halving."""
    low, high = 1, min(len(label), len(text) - at)  # the first byte is equal
    while low < high:
        half = (low + high + 1) // 2
        if text.startswith(label[:half], at):
            low = half
        else:
            high = half - 1
    return low


def splitters(texts: DataFrame, ranges: int) -> list[bytes]:
    """Sorted byte strings that part the texts into about ``ranges`` ranges of like numbers of rows."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found, heavy, total = set(), [b""], 0
    for _ in range(LEVELS):
        if not heavy:
            break
        which = F.coalesce(*[F.when(F.startswith(raw, F.lit(p)), F.lit(k)) for k, p in enumerate(heavy)])
        depth = F.element_at(F.array(*[F.lit(len(p)) for p in heavy]), F.col("k") + 1)
        rows = texts.select(raw.alias("raw"), which.alias("k")).filter("k is not null").select(
            "k", F.substring("raw", depth + 1, F.lit(AHEAD)).alias("ahead"))
        number = F.conv(F.rpad(F.hex(F.substring("ahead", 1, STEP)), 2 * STEP, "0"), 16, 10).cast("double")
        level = rows.groupBy("k").agg(
            F.count(F.lit(1)).alias("n"), F.min("ahead").alias("low"), F.max("ahead").alias("high"),
            F.percentile_approx(number, [k / ranges for k in range(1, ranges)], 5 * ranges).alias("cuts")).collect()
        total = total or sum(r["n"] for r in level)
        mass: dict[bytes, float] = {}
        for r in level:
            before, low, high = heavy[r["k"]], bytes(r["low"]), bytes(r["high"])
            same = _shared(low, high, 0) if low[:1] == high[:1] and low else 0
            if same == len(low) == len(high) < AHEAD:
                continue  # one text only
            if same >= STEP:
                mass[before + low[:same]] = r["n"]
                continue
            cuts = [int(c) for c in r["cuts"]]
            every = max(1, int(total / r["n"]))
            found.update(before + c.to_bytes(STEP, "big").rstrip(b"\0") for c in cuts[::every])
            for c in set(cuts):
                if (n := cuts.count(c) / ranges * r["n"]) > 2 * total / ranges:
                    mass[before + c.to_bytes(STEP, "big")] = n
        heavy = sorted(sorted(mass, key=lambda p: (-mass[p], p))[:HEAVY])
    return sorted(found)


class Combiner:
    """A task's rows on their way: equal rows become one with a count, rows above the minimum of their text are flagged
    and lose it. Texts that repeat stay known when the trie is emptied."""

    def __init__(self, cuts: list[bytes], spread: int):
        self.cuts, self.spread, self.flushed = cuts, spread, 0
        self.trie, self.rows, self.size = Trie(), {}, 0

    def add(self, key, part: str, text: str) -> bool:
        """True when it is time to ``flush``."""
        raw = text.encode("utf-8", "surrogatepass")
        node = self.trie.insert(raw, key)
        row = self.rows.get((id(node), key, part))
        if row is None:
            self.rows[id(node), key, part] = [node, own_mask(text), 1, raw]
            self.size += len(raw)
        else:
            row[2] += 1
        return self.size > BATCH_BYTES or len(self.rows) >= BATCH_ROWS

    def flush(self) -> Iterator[tuple]:
        """(doc_id, part, mask, n, text, range) of the rows so far. Rows that need no comparison have no text and go
        to negative ranges in turn."""
        copies: dict[int, list] = {}
        for (at, key, part), (node, mask, n, raw) in self.rows.items():
            copies.setdefault(at, [node, raw, 0])[2] += 1
            if key is None or key > node.low:
                self.flushed += 1
                yield key, part, mask | (0 if key is None else DUPLICATE), n, None, -1 - self.flushed % self.spread
            else:
                yield key, part, mask, n, raw, bisect.bisect_right(self.cuts, raw)
        self.trie, self.rows, self.size, kept = Trie(), {}, 0, 0
        for node, raw, n in copies.values():
            if n > 1 and node.low is not None and (kept := kept + len(raw)) < BATCH_BYTES // 4:
                self.trie.insert(raw, node.low)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, 1024)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def masks(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: the filters that documents fail, equal rows counted together or in several rows."""
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    cuts = splitters(rows, RANGES_PER_PARTITION * partitions)

    def combine(batches: Iterator[pa.RecordBatch]):
        held, schema = Combiner(cuts, RANGES_PER_PARTITION * partitions), None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), *NARROW, ("text", pa.binary()),
                                          ("range", pa.int32())])
            for key, part, text in zip(*(batch.column(k) for k in range(3))):
                if held.add(key.as_py(), part.as_py(), text.as_py() or ""):
                    yield from _batches(held.flush(), schema)
        if schema:
            yield from _batches(held.flush(), schema)

    def judge(batches: Iterator[pa.RecordBatch]):
        trie, held, now, schema = Trie(), [], None, None

        def flagged():
            """The walk over a range's rows: a text is in the trie once, however many rows it has."""
            return [(key, part, mask | (DUPLICATE if node is not None and key > node.low else 0), n)
                    for key, part, mask, n, node in held]

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(k) for k in range(4)])
            for *row, text, where in zip(*(batch.column(k) for k in range(6))):
                where, key = where.as_py(), row[0].as_py()
                if where != now or len(held) >= BATCH_ROWS and where < 0:
                    yield from _batches(flagged(), schema)
                    trie, held, now = Trie(), [], where
                node = trie.insert(text.as_py(), key) if where >= 0 else None
                held.append((key, *(x.as_py() for x in row[1:]), node))
        if schema:
            yield from _batches(flagged(), schema)

    name = documents.schema["doc_id"].dataType.simpleString()
    sent = rows.mapInArrow(combine, f"doc_id {name}, part string, mask int, n long, text binary, range int")
    met = sent.repartition(partitions, "range").sortWithinPartitions("range")
    return met.mapInArrow(judge, f"doc_id {name}, part string, mask int, n long")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = masks(documents).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))

    def disjoint(c: str):
        """Element S: documents that fail none of the filters S."""
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0))
                         for s in range(1 << len(FILTERS))]).alias(c)

    alone = F.array(*[F.sum(F.when(F.col("mask") == (1 << k), F.col("n")).otherwise(0)) for k in range(len(FILTERS))])
    parts = counts.groupBy("part").agg(disjoint("n"), disjoint("good"), disjoint("toxic"), alone.alias("alone"))
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            steps.append(("".join(order), step, FILTERS.index(name), before))
            before |= 1 << FILTERS.index(name)
    fixed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("f"),
                               F.lit(b).alias("before")) for o, s, f, b in steps])
    at = parts.withColumn("s", F.explode(fixed)).select("*", "s.*")
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), F.col("f") + 1)
    get = lambda c, s: F.element_at(F.col(c), s.cast("int") + 1)
    after = F.col("before").bitwiseOR(bit)
    none = F.lit(0)
    lost = lambda c: get(c, F.col("before")) - get(c, after)
    at = at.select(
        "part", "filter_order", "step", "f", get("n", after).alias("kept"), lost("n").alias("removed"),
        (get("n", none) - get("n", bit) - lost("n")).alias("redundant"), F.element_at("alone", F.col("f") + 1).alias(
            "unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    total = at.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    return at.join(total, ["part", "f"]).select(
        "part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in (
            "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS {0}({0}, {0}_bit)"
_ORDERS = ", ".join(_LETTERS.format(f"f{k}") for k in range(1, 6))
ORACLE = rf"""
WITH judged AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d."text", '') AS body,
         regexp_extract_all(coalesce(d."text", ''), '[^\x20\x09-\x0D]+') AS ws,
         min(d.doc_id) OVER (PARTITION BY coalesce(d."text", '')) AS low,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                                     max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l
    ON l.doc_id = d.doc_id),
masked AS (
  SELECT part, good, toxic,
         CASE WHEN len(ws) < {FEW_WORDS} THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(body) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS mask
  FROM judged),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
orders AS (
  SELECT f1 || f2 || f3 || f4 || f5 AS filter_order, [f1_bit, f2_bit, f3_bit, f4_bit, f5_bit] AS bits
  FROM {_ORDERS} WHERE f1_bit + f2_bit + f3_bit + f4_bit + f5_bit = 31 AND (f1_bit | f2_bit | f3_bit | f4_bit | f5_bit) = 31),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own,
         CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before
  FROM orders, range(1, 6) AS r(step)),
told AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""
