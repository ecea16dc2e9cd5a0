"""Bounded-space online packing of documents into token sequences.

Each task keeps ``OPEN`` windows. A document's full windows go out on their own; what remains is placed best-fit, in
the open window with the least room that still holds it. If none holds it and all windows are taken, the fullest one
is topped up from the document and goes out, full. A task's last windows are merged: those of ``MERGE`` neighbouring
tasks at a time are joined end to end and cut into full sequences, so at most one sequence in each such group is
padded. Memory per task is bounded by the open windows, and per merge by OPEN * MERGE windows.

The tasks' pieces are written once to the shared folder, so sequence ids come from one committed attempt per task.

Cases: a null or empty text is one piece holding only the end id; a very long text spans many sequences; repeated
rows are packed each; a null doc_id is kept as null; an empty table gives an empty result; only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import materialize
from lendwise.llm.tokens import Encoder, vocabulary

LENGTH, END_ID = 2048, 1
OPEN, MERGE = 16, 32
COLUMNS = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MERGED_FROM = 1 << 62  # sequence ids of merged windows start here


class _Windows:
    """Open windows of one task. Pieces are [doc_id, start, ids, doc_tokens]."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.windows = size, most, []

    def place(self, doc_id, ids: np.ndarray):
        """Places a document; yields each window (a list of pieces) that goes out full."""
        start, total = 0, len(ids)
        while total - start >= self.size:
            yield [[doc_id, start, ids[start:start + self.size], total]]
            start += self.size
        while start < total:
            need = total - start
            fits = [w for w in self.windows if w[0] >= need]
            if fits:
                window = min(fits, key=lambda w: w[0])
                take = need
            elif len(self.windows) < self.most:
                window, take = [self.size, []], need
                self.windows.append(window)
            else:
                window = min(self.windows, key=lambda w: w[0])
                take = window[0]
            window[1].append([doc_id, start, ids[start:start + take], total])
            window[0] -= take
            start += take
            if not window[0]:
                self.windows = [w for w in self.windows if w is not window]
                yield window[1]


def pack(documents: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    content = documents.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = documents.schema["doc_id"].dataType.simpleString()
    arrow = None

    def batch_of(rows, id_type):
        cols = list(zip(*rows, strict=True))
        kinds = [id_type, *[pa.int64()] * 6, pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "window", "ids"])

    def rows_of(pieces, sequence, task, window):
        """window: -1 for a window that went out; else its number, and the ids travel along for the merge."""
        at, out = 0, []
        for doc_id, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            out.append((doc_id, start, len(ids), zlib.crc32(raw), total, sequence, at, task, window,
                        raw if window >= 0 else None))
            at += len(ids)
        return out

    def task(batches):
        me, done, id_type = TaskContext.get().partitionId(), 0, arrow
        encoder, open_windows, rows = Encoder(content.value), _Windows(length, OPEN), []
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(encoder.encode(text or ""), "<u4"), np.uint32(end_id))
                for pieces in open_windows.place(doc_id, ids):
                    rows += rows_of(pieces, (me << 32) + done, me, -1)
                    done += 1
                if len(rows) > 20_000:
                    yield batch_of(rows, id_type)
                    rows = []
        for k, (_, pieces) in enumerate(open_windows.windows):
            rows += rows_of(pieces, -1, me, k)
        if rows:
            yield batch_of(rows, id_type)

    def merge(table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["task"], r["window"], r["offset"]))
        sequence, at, out = MERGED_FROM + (rows[0]["task"] // MERGE << 32), 0, []
        for r in rows:
            ids, done = np.frombuffer(r["ids"], "<u4"), 0
            while done < len(ids):
                part = ids[done:done + length - at]
                out.append((r["doc_id"], r["start"] + done, len(part), zlib.crc32(part.tobytes()), r["doc_tokens"],
                            sequence, at))
                done, at = done + len(part), at + len(part)
                if at == length:
                    sequence, at = sequence + 1, 0
        cols = list(zip(*out, strict=True))
        kinds = [table.schema.field("doc_id").type, *[pa.int64()] * 6]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    pieces = documents.select("doc_id", "text").mapInArrow(
        task, COLUMNS.format(kind) + ", task long, window int, ids binary")
    pieces = materialize(pieces, "pieces")
    names = [c.strip().split(" ")[0] for c in COLUMNS.split(",")]
    last = pieces.filter("window >= 0").withColumn("__group", F.expr(f"task div {MERGE}"))
    merged = last.groupBy("__group").applyInArrow(merge, COLUMNS.format(kind))
    return pieces.filter("window < 0").select(*names).unionAll(merged)
