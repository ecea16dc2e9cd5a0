"""Quality classifier: a factorisation machine over hashed words, structure statistics of the text and the stored
character count. Pairwise interactions have rank ``RANK`` and are scored in time linear in a text's features with

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ].

It is fitted on about ``TRAIN_ROWS`` (at most twice as many) labelled, learnable documents (those with the smallest hash of their id), whose
features go to the driver; every document is then scored in tasks. Labels, language, source and id are never features.

Cases: a null text is empty and gets the score of an empty text; a null or wrong n_chars only sets its own feature;
labels other than 0 and 1, null labels and null ids are not learned from, repeated labels of a document count each;
without any label every score is 0.5; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import hashed_sample, held_out, learnable, text_key

TRAIN_ROWS = 8192
BUCKETS = 1 << 13
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.02, 1e-4
THRESHOLD = 0.3

_ALPHA = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
_STOP = np.array([chr(b) in ".,;:!?'\"()-" for b in range(256)])
_LEAD = np.array([b >= 0xC0 for b in range(256)])
_TAIL = np.array([0x80 <= b < 0xC0 for b in range(256)])
_TOKEN = re.compile(r"\S+")


def structure(text: str, words: list[str], counts: Counter, n_chars) -> list[float]:
    """Statistics of a text's form; the last two describe the stored character count."""
    raw = text.encode("utf-8", "surrogatepass")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(int(by[~_TAIL].sum()), 1)
    symbols = by[~(_ALPHA | _DIGIT | _SPACE | _STOP | _LEAD | _TAIL)].sum()
    n, kinds = max(len(words), 1), max(len(counts), 1)
    lines = [s for s in text.split("\n") if s.strip()]
    n_lines = max(len(lines), 1)
    pairs = Counter(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?")
    share = [by[_UPPER].sum(), by[_DIGIT].sum(), by[_SPACE].sum(), by[_STOP].sum(), symbols, by[_LEAD].sum()]
    return [np.log1p(chars), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), kinds / n,
            max(counts.values(), default=0) / n, len(pairs) / max(n - 1, 1), max(pairs.values(), default=0) / n,
            marked / n, np.log1p(len(lines)), np.log1p(chars / n_lines), 1 - len(set(lines)) / n_lines,
            max(Counter(lines).values(), default=0) / n_lines, text.count("http") / n,
            sum(s[-1] in ".!?" for s in (x.rstrip() for x in lines)) / n_lines, *[s / chars for s in share],
            float(not words), float(n_chars is None), np.log1p(abs(n_chars or 0)) - np.log1p(chars)]


N_STRUCTURE = 25


def features(text: str | None, n_chars) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(word buckets, their weights with unit norm, structure statistics)."""
    text = text or ""
    words = _TOKEN.findall(text.lower())
    counts = Counter(words)
    crc = zlib.crc32
    at = np.fromiter((crc(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in counts), np.int64, len(counts))
    total = np.bincount(at, np.fromiter(counts.values(), float, len(counts)), BUCKETS)
    bucket = np.flatnonzero(total)
    weight = np.log1p(total[bucket])
    norm = np.sqrt((weight ** 2).sum())
    return bucket, (weight / norm if norm else weight).astype(np.float32), structure(text, words, counts, n_chars)


@dataclass
class Model:
    """bias, linear weights and factors over [structure statistics, word buckets]; centre and scale of the former."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, bucket: np.ndarray, weight: np.ndarray, stats: list[float]) -> float:
        dense = np.clip((np.array(stats) - self.centre) / self.scale, -4, 4)
        at = np.concatenate([np.arange(N_STRUCTURE), N_STRUCTURE + bucket])
        x = np.concatenate([dense, weight])
        vx = self.factors[at] * x[:, None]
        z = self.bias + self.linear[at] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float], int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on the logistic loss, in mini-batches; the same rows in the same order give the same model."""
    width = N_STRUCTURE + BUCKETS
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(width), rng.normal(0, 0.05, (width, RANK)), np.zeros(N_STRUCTURE), np.ones(N_STRUCTURE))
    if not rows:
        model.factors[:] = 0
        return model
    stats = np.array([r[2] for r in rows])
    model.centre, model.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    dense = np.clip((stats - model.centre) / model.scale, -4, 4)
    label = np.array([r[3] for r in rows], float)
    rate = np.clip(label.mean(), 0.01, 0.99)
    params = {"b": np.array([np.log(rate / (1 - rate))]), "w": model.linear, "v": model.factors}
    first = {k: np.zeros_like(p) for k, p in params.items()}
    second = {k: np.zeros_like(p) for k, p in params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at:at + BATCH]
            x = np.zeros((len(pick), width), np.float32)
            x[:, :N_STRUCTURE] = dense[pick]
            for k, r in enumerate(pick):
                x[k, N_STRUCTURE + rows[r][0]] = rows[r][1]
            vx = x @ params["v"]
            z = params["b"] + x @ params["w"] + 0.5 * ((vx ** 2).sum(1) - (x ** 2 @ params["v"] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) / len(pick)
            grads = {"b": np.array([g.sum()]), "w": x.T @ g + DECAY * params["w"],
                     "v": x.T @ (g[:, None] * vx) - (x.T ** 2 @ g)[:, None] * params["v"] + DECAY * params["v"]}
            step += 1
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad ** 2
                fast = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                params[k] = params[k] - fast * first[k] / (np.sqrt(second[k]) + 1e-8)
    model.bias, model.linear, model.factors = float(params["b"][0]), params["w"], params["v"]
    return model


def _featured(batches):
    for batch in batches:
        made = [features(t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32())),
            pa.array([m[2] for m in made], pa.list_(pa.float64())), batch.column(2), batch.column(3)],
            names=["bucket", "weight", "stats", "label", "place"])


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model from a bounded sample of the labelled learnable documents. Repeated rows of a document train once; at most
    4 * train_rows rows reach the driver, however many rows a chosen document has."""
    known = labels.filter(learnable(F.col("doc_id")) & F.col("quality").isin(0, 1)).select(
        "doc_id", F.col("quality").cast("int").alias("label"))
    chosen = hashed_sample(known, "doc_id", train_rows)
    rows = documents.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")  # at most 2 * train_rows rows
    rows = rows.withColumn("__t", text_key(F.col("text"))).dropDuplicates(["doc_id", "__t", "label"])
    rows = rows.select("text", F.col("n_chars").cast("long"), "label", F.xxhash64("doc_id").alias("place"), F.xxhash64(
        "doc_id", "__t", "label").alias("row"))
    rows = hashed_sample(rows, "row", 2 * train_rows).drop("row")
    table = rows.mapInArrow(_featured, "bucket array<int>, weight array<float>, stats array<double>, label int, place long")
    got = table.toArrow().sort_by([("place", "ascending"), ("label", "ascending")])
    parts = [got.column(k).combine_chunks() for k in range(3)]
    bucket, weight, stats = ([c[k].values.to_numpy() for k in range(len(c))] for c in parts)
    return fit(list(zip(bucket, weight, stats, got.column("label").to_pylist(), strict=True)))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def task(batches):
        m = model.value
        for batch in batches:
            scores = [m.score(*features(t, n)) for t, n in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    docs = documents.select("doc_id", "text", F.col("n_chars").cast("long"))
    out = docs.mapInArrow(task, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
