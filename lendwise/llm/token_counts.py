"""Token counts by prefix dynamic programming: each text gets the exact token count of every prefix, from which its
total, its count after any truncation and the longest prefix within a budget are read without encoding again.

Cases: a null text is empty and has no tokens; special strings inside a text count as one token, as the library does
by default; a budget that nothing exceeds leaves the whole text; repeated rows each get their row; an empty table
gives an empty result; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.tokens import PrefixCounter, vocabulary


def groups(texts: list[str], size: int = 1 << 21):
    """Runs of texts of about ``size`` characters, to be learned together."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def _with_counts(documents: DataFrame, path: str | None, names: dict, columns) -> DataFrame:
    """doc_id and what ``columns(prefix counts, text)`` gives for each text."""
    content = documents.sparkSession.sparkContext.broadcast(vocabulary(path))

    def task(batches):
        counter = PrefixCounter(content.value)
        for batch in batches:
            texts, made = [t or "" for t in batch.column(1).to_pylist()], []
            for group in groups(texts):
                made += [columns(c, t) for c, t in zip(counter.counts_of(group), group, strict=True)]
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(names.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names])

    kinds = {pa.int64(): "long", pa.list_(pa.int32()): "array<int>"}
    schema = ", ".join([f"doc_id {documents.schema['doc_id'].dataType.simpleString()}",
                        *[f"{n} {kinds[k]}" for n, k in names.items()]])
    return documents.select("doc_id", "text").mapInArrow(task, schema)


def prefix_table(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``prefix_tokens``: element k is the token count of the first k characters (k from 1)."""
    return _with_counts(documents, path, {"prefix_tokens": pa.list_(pa.int32())}, lambda c, t: (c.astype(np.int32),))


def tokens_after(prefix_tokens: Column, n_chars: Column) -> Column:
    """Token count of a text cut to its first n_chars characters, from a stored table."""
    n = F.least(n_chars, F.size(prefix_tokens))
    return F.when(n > 0, F.get(prefix_tokens, (n - 1).cast("int"))).otherwise(F.lit(0))


def chars_within(prefix_tokens: Column, budget: Column) -> Column:
    """Longest prefix, in characters, of at most ``budget`` tokens, from a stored table."""
    fit = F.transform(prefix_tokens, lambda c, k: F.when(c <= budget, k + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(fit), F.lit(0))


def token_counts(documents: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_tokens, over_limit, and kept_chars, the longest prefix within the
    limit."""

    def columns(counts, text):
        fit = np.flatnonzero(counts <= limit)
        return len(text.encode("utf-8")), int(counts[-1]) if len(counts) else 0, int(fit[-1]) + 1 if len(fit) else 0

    out = _with_counts(documents, path, {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "kept_chars": pa.int64()}, columns)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept_chars")
