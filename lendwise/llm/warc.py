"""WARC archives: a deduplicating writer and a reader that verifies the chain of record boundaries.

Writing goes through Spark's text writer (one record per row, the record trailer as line separator), so archives land
in any file system Spark can reach, committed per task. Of equal payloads of at least MIN_BYTES bytes the record with
the largest page_id is the response, the others are revisits without a body.

Reading cuts the files at every "\\nWARC/1." with Spark's splittable text reader; a cut may lie inside a payload. Each
task parses the candidates of its file blocks into record-to-successor offsets and contracts the chains inside a
block; pointer jumping from each file's start then finds the block entries that are reachable, in a number of rounds
that is the logarithm of the blocks per file, and only candidates on a reachable chain are records. Payloads that
contain the cut are put together again from their pieces.

Cases: a null html is an empty payload, a null url or page_id is left out of the record and read back as null; magic
in payloads or header values is not a record; rows that repeat the largest page_id of a payload are all responses; a
null page_id never is the largest, and if all are null, all are responses; a record whose body is cut off ends its
file; an empty table gives empty archives and an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendwise.llm.common import materialize, shared_path

MIN_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
CUT = "\nWARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes one record per page below ``path``."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"),
                        F.octet_length(payload).cast("long").alias("n"))
    copies = rows.filter(F.col("n") >= min_bytes).groupBy("digest", "n").agg(
        F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND keep IS NOT NULL")
    copies = materialize(copies.select("digest", "n", "keep"), "payload-copies")
    rows = rows.join(copies, ["digest", "n"], "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    field = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\r\n"))
    some = lambda c: F.coalesce(c, F.lit(""))
    name = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url", "digest").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    record = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))), field("WARC-Date", F.lit(DATE)),
        some(field("WARC-Target-URI", one_line(F.col("url")))), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        some(field("X-Page-Id", F.col("page_id"))), field("X-Payload-Bytes", F.col("n")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(REVISIT)), field("X-Refers-To-Page", F.col("keep")))).otherwise(""),
        field("Content-Type", F.lit("text/html")), field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
        F.lit("\r\n"), F.when(revisit, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at CUT: (value, file, block)."""
    return spark.read.option("lineSep", CUT).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


def _header(piece: bytes) -> dict | None:
    """Header fields (lower-case names) of a piece that starts after the magic, with ``body``, the payload's place."""
    # the cut takes the line end before the magic with it: it may be the header's last one
    end = (piece + b"\n").find(b"\r\n\r\n")
    if end < 0 or not re.match(rb"[01]\r\n", piece):
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(key.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        return None
    return fields | {"body": end + 4}


SEGMENT = ("file string, block long, no long, start long, consumed long, candidate boolean, step long, exit long, "
           "last long, kind string, page_id long, n long, digest string, refers long, whole boolean")
_KINDS = [pa.string(), *[pa.int64()] * 4, pa.bool_(), *[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.string(),
          pa.int64(), pa.bool_()]
_NAMES = [c.split(" ")[0] for c in SEGMENT.split(", ")]
MAGIC = CUT[1:].encode()


def _number(text: str | None) -> int | None:
    """A number in the range of a long, or none."""
    n = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return n if n is not None and -2 ** 63 <= n < 2 ** 63 else None


def _described(fields: dict, payload: bytes | None) -> tuple:
    """(kind, page_id, n, digest, refers) of a record; from the payload where it has one, else from the header."""
    kind = fields["warc-type"]
    digest, n = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, _number(fields.get("x-payload-bytes"))
    if kind != "revisit" and payload is not None:
        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
    return kind, _number(fields.get("x-page-id")), n, digest, _number(fields.get("x-refers-to-page"))


def _candidates(batches):
    """Rows of SEGMENT; starts, exits and last starts are relative to the block's first byte."""

    def closed(rows):
        at = {r[3]: k for k, r in enumerate(rows) if r[5]}
        for r in reversed(rows):
            if r[5]:
                target = r[3] + r[6]
                k = at.get(target) if target > r[3] else None
                r[7], r[8] = (rows[k][7], rows[k][8]) if k is not None else (target, r[3])
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)

    here, rows, used = None, [], 0
    for batch in batches:
        for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != here:
                if rows:
                    yield closed(rows)
                here, rows, used = (file, block), [], 0
            head = not block and not rows
            consumed = len(value) + (0 if head else len(CUT))
            start = used if head else used + 1
            piece = value
            if head:
                piece = value[len(MAGIC):] if value.startswith(MAGIC) else b""
            fields = _header(piece)
            row = [file, block, len(rows), start, consumed, fields is not None, *[None] * 8, False]
            if fields:
                size = int(fields["content-length"])
                payload = piece[fields["body"]:fields["body"] + size]
                whole = len(payload) == size
                row[6] = len(MAGIC) + fields["body"] + size + 4
                row[9:14] = _described(fields, payload if whole else None)
                row[14] = whole
            rows.append(row)
            used += consumed
    if rows:
        yield closed(rows)


def _raw(batches):
    """(file, block, no, value) of every piece."""
    here, no = None, 0
    for batch in batches:
        numbers = []
        for place in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            here, no = place, no + 1 if place == here else 0
            numbers.append(no)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(numbers, pa.int64()), batch.column(0)],
                                         names=["file", "block", "no", "value"])


def _reachable_entries(segments: DataFrame) -> DataFrame:
    """(file, start): the first record of the chain in each block that the chain from the file's start meets."""
    chains = segments.filter("candidate")
    zero = segments.select("file", F.lit(0).cast("long").alias("start")).distinct()
    nodes = chains.select("file", F.col("exit").alias("start")).unionAll(zero).distinct()
    jump = materialize(chains.join(nodes, ["file", "start"]).select("file", "start", "exit"), "warc-jumps")
    blocks = segments.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 1
    reach = materialize(zero, "warc-reach")
    for _ in range(max(1, math.ceil(math.log2(blocks + 1)))):
        hop = reach.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))
        reach = materialize(reach.unionAll(hop).distinct(), "warc-reach")
        later = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("exit2"))
        jump = materialize(jump.join(later, ["file", "exit"]).select("file", "start", F.col("exit2").alias("exit")),
                           "warc-jumps")
    return reach


def _walk(key, segments, entries):
    """The candidates of a block on the chain from its entry."""
    keep = []
    if entries.num_rows and segments.num_rows:
        starts, steps = segments.column("start").to_pylist(), segments.column("step").to_pylist()
        at = {s: k for k, (s, ok) in enumerate(zip(starts, segments.column("candidate").to_pylist(), strict=True)) if ok}
        for entry in sorted(entries.column("start").to_pylist()):
            while (k := at.pop(entry, None)) is not None:
                keep.append(k)
                entry = starts[k] + steps[k]
    names = [n for n in segments.schema.names if n != "base"]
    return segments.select(names).take(pa.array(keep, pa.int64()))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = materialize(_pieces(spark, path).mapInArrow(_candidates, SEGMENT), "warc-segments")
    in_order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.groupBy("file", "block").agg(F.sum("consumed").alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(in_order), F.lit(0)).cast("long").alias("base"))
    bases = materialize(bases, "warc-blocks")
    moved = {c: F.col(c) + F.col("base") for c in ("start", "exit", "last")}
    segments = found.join(bases, ["file", "block"]).withColumns(moved).drop("base").select(*_NAMES)
    segments = materialize(segments, "warc-chains")
    entries = _reachable_entries(segments)
    placed = segments.select("file", "block", "start").join(entries, ["file", "start"])
    placed = placed.select(*[F.col(c).alias(c) for c in placed.columns])  # columns of its own for the cogroup
    records = segments.groupBy("file", "block").cogroup(placed.groupBy("file", "block")).applyInArrow(_walk, SEGMENT)
    records = materialize(records, "warc-records")
    out = ["page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
           F.col("kind").alias("record_type"), F.col("refers").alias("refers_to")]
    whole = records.filter("whole").select(*out)
    cut = records.filter("NOT whole").select("file", "start", "step")
    if cut.isEmpty():
        return whole
    return whole.unionAll(_joined(spark, path, segments, records).select(*out))


def _joined(spark: SparkSession, path: str, segments: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose payload holds the cut, put together from their pieces. Pieces find their record as the last
    record start at or before them: in their own block, else the last of the blocks before. Windows pass over a block's
    narrow rows, or over one row per block of a file, so one huge archive is shared by many tasks."""
    block = Window.partitionBy("file", "block").orderBy("start")
    marks = records.select("file", F.col("start").alias("record"), F.col("whole").alias("done"))
    spots = segments.join(marks.withColumn("start", F.col("record")), ["file", "start"], "left")
    owner = F.when(F.col("record").isNotNull(), F.struct("record", "done"))
    latest = F.last(owner, ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0))
    ends = spots.groupBy("file", "block").agg(F.max(owner).alias("end"))  # the largest start of a record, or null
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(ends.select("file", "block", F.last("end", ignorenulls=True).over(before).alias("carried")),
                          "warc-carried")
    owned = spots.withColumn("owner", latest).join(carried, ["file", "block"]).withColumn(
        "owner", F.coalesce("owner", "carried")).filter("NOT owner.done").select(
        "file", "block", "no", "start", F.col("owner.record").alias("record"))
    owned = materialize(owned, "warc-parts")
    parts = _pieces(spark, path).mapInArrow(_raw, "file string, block long, no long, value binary").join(
        owned, ["file", "block", "no"])

    def join(table):
        values = [v for _, v in sorted(zip(table.column("start").to_pylist(), table.column("value").to_pylist(), strict=True))]
        first = values[0][len(MAGIC):] if table.column("record")[0].as_py() == 0 else values[0]
        text = CUT.encode().join([first, *values[1:]])
        fields = _header(text)
        size = int(fields["content-length"])
        payload = text[fields["body"]:fields["body"] + size]
        row = _described(fields, payload) if len(payload) == size else None
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.Table.from_arrays([pa.array([x] if row else [], k) for x, k in zip(row or [None] * 5, kinds, strict=True)],
                                    names=["kind", "page_id", "n", "digest", "refers"])

    return parts.groupBy("file", "record").applyInArrow(
        join, "kind string, page_id long, n long, digest string, refers long")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages' archives (below ``path`` or a new shared folder) and reads them back."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000
      GROUP BY ALL HAVING count(*) > 1 AND max(page_id) IS NOT NULL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""
