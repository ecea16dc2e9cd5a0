"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments; per segment the mean m and deviation s of the components are kept, coarse (few
segments) and fine (many). For two vectors the squared distance is at least the sum over segments of
length * ((m1 - m2)^2 + (s1 - s2)^2); with the norms known, this lower bound on the distance is an upper bound on the
inner product. Candidates whose bound lies below the k-th best score found so far are dropped, coarse level first, and
exact scores are computed for the survivors only.

The bounds also decide what is shipped. Vectors are range-partitioned by the directions of their coarse means, so that a
block holds like vectors, and each block is summed up by the least and greatest value of every coarse statistic: a bound
for all of its vectors at once. A query first meets the one block that promises most; its k-th best score there is a
floor, and then it is sent only to blocks whose bound reaches the floor. A block's vectors travel once per round, and
again only where more than QUERY_BLOCK queries come to it. The blocks' best k per query are merged in a window (which
Spark limits to k rows per task before the shuffle). Block summaries are bounded: at most MAX_BLOCKS blocks.

Cases: rows with a null vec_id, a null vector, or a null, NaN or infinite component take no part; repeated rows are
candidates of their own, kept as one vector with a count until the k best are written out; repeated query rows give every
candidate row once per query row, and the k best of all these; a query never meets rows of its own vec_id; vectors of
different lengths are not compared; ties go to the smaller vec_id; fewer candidates than k give fewer rows; scores are
exact integers, held at the ends of the long range if they exceed it; an empty table gives an empty result; only vec_id
and embedding are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendwise.llm.common import materialize

K, EVERY = 20, 20
QUERY_BLOCK, CANDIDATE_BLOCK, STEP = 2048, 4096, 512
MAX_BLOCKS = 1 << 16
LEVELS = (4, 16)  # segments per vector, coarse to fine
DENSE = 0.1       # share of survivors from which a whole block is cheaper than picked pairs


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row [sqrt(length) * mean, sqrt(length) * deviation] of each segment: inner products of these rows bound the
    vectors' inner products from above."""
    edges = np.linspace(0, x.shape[1], min(segments, max(x.shape[1], 1)) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    if not parts:
        return np.zeros((len(x), 1))
    root = np.sqrt([p.shape[1] for p in parts])
    return np.hstack([np.stack([p.mean(1) for p in parts], 1) * root, np.stack([p.std(1) for p in parts], 1) * root])


def _doubles_are_exact(q: np.ndarray, x: np.ndarray) -> bool:
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1) < 2.0 ** 53


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows."""
    if _doubles_are_exact(q, x):
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q.tolist(), x.tolist(), strict=True)]
    return np.array([max(-2 ** 63, min(2 ** 63 - 1, w)) for w in whole], np.int64)


def _exact_block(q, x, ok, qid, xid, floor, k: int):
    """(scores, query rows, candidate rows) of the surviving pairs that reach their query's floor or the k-th best of
    this block, whichever is higher; all pairs of the block are multiplied at once where doubles are exact."""
    if not _doubles_are_exact(q, x):
        rows, cols = np.nonzero(ok)
        return exact_scores(q[rows], x[cols]), rows, cols
    scores = np.where(ok & (qid[:, None] != xid[None, :]), q @ x.T, -np.inf)
    least = floor
    if len(x) > k:
        least = np.maximum(floor, np.partition(scores, len(x) - k, axis=1)[:, len(x) - k])
    rows, cols = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    return scores[rows, cols].astype(np.int64), rows, cols


def best_in_block(qid, q, xid, x, k: int = K, floor=None):
    """(query row, candidate row, score) of each query's k best among the candidates, by bounds, coarse to fine; scores
    below a query's ``floor`` may be left out."""
    order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")  # long vectors first: the thresholds rise early
    x, xid = x[order], xid[order]
    qs, xs = [segment_stats(q, s) for s in LEVELS], [segment_stats(x, s) for s in LEVELS]
    slack = 1e-9 * (np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(x, axis=1).max(initial=0)) + 1e-6
    floor = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    none = np.zeros(0, np.int64)
    held_q, held_x, held_s = none, none, none
    for at in range(0, len(x), STEP):
        end = min(at + STEP, len(x))
        need = (floor - slack)[:, None]
        ok, few = np.ones((len(q), end - at), bool), False
        for a, b in zip(qs, xs, strict=True):
            if few:  # so few are left that they are bounded one by one
                keep = np.einsum("ij,ij->i", a[rows], b[cols + at]) >= floor[rows] - slack
                rows, cols = rows[keep], cols[keep]
            else:
                ok &= a @ b[at:end].T >= need
                few = ok.sum() <= DENSE * ok.size
                rows, cols = np.nonzero(ok) if few else (None, None)
        if few:
            got = exact_scores(q[rows], x[cols + at])
        else:
            got, rows, cols = _exact_block(q, x[at:end], ok, qid, xid[at:end], floor, k)
        other = (qid[rows] != xid[cols + at]) & (got >= floor[rows])
        rows, cols, got = rows[other], cols[other] + at, got[other]
        hq, hx, hs = (np.concatenate(p) for p in ((held_q, rows), (held_x, cols), (held_s, got)))
        o = np.lexsort((xid[hx], ~hs, hq))  # ~ reverses the order of integers without overflow
        hq, hx, hs = hq[o], hx[o], hs[o]
        first = np.searchsorted(hq, np.arange(len(q)))
        rank = np.arange(len(hq)) - first[hq]
        keep = rank < k
        full = rank == k - 1
        floor[hq[full]] = np.maximum(floor[hq[full]], hs[full])
        held_q, held_x, held_s = hq[keep], hx[keep], hs[keep]
    return held_q, order[held_x], held_s


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(column), width))


def _direction(x: np.ndarray) -> np.ndarray:
    """A number per vector that orders vectors by the directions of their coarse means, most telling bits first."""
    means = segment_stats(x, LEVELS[0])[:, :LEVELS[0]]
    length = np.linalg.norm(x, axis=1, keepdims=True) + 1e-300
    bits = ((0.5 + np.arctan(4 * means / length) / np.pi) * 255).astype(np.uint64)
    code = np.zeros(len(x), np.uint64)
    for bit in range(7, -1, -1):
        for j in range(bits.shape[1]):
            code = (code << np.uint64(1)) | ((bits[:, j] >> np.uint64(bit)) & np.uint64(1))
    return code.astype(np.int64)


def _by_width(batches, one):
    """``one(vectors, batch)`` on the rows of each width of each batch."""
    for batch in batches:
        widths = batch.column(batch.schema.get_field_index("width")).to_numpy()
        for width in np.unique(widths):
            part = batch.filter(pa.array(widths == width))
            yield one(_matrix(pa.chunked_array([part.column(part.schema.get_field_index("v"))]), int(width)), part)


def blocked(rows: DataFrame) -> DataFrame:
    """The vectors (vec_id, v, width, n) with ``block``: ranges of like vectors, fixed by writing them."""
    def coded(batches):
        yield from _by_width(batches, lambda x, part: part.append_column("code", pa.array(_direction(x), pa.int64())))

    blocks = max(1, min(MAX_BLOCKS, -(-rows.count() // CANDIDATE_BLOCK)))
    kinds = "vec_id long, v array<double>, width int, n long"
    ranged = rows.mapInArrow(coded, f"{kinds}, code long").repartitionByRange(blocks, "width", "code", "vec_id")
    return materialize(ranged.withColumn("block", F.spark_partition_id()).drop("code"), "vector-blocks")


def summaries(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per width: block numbers, and the least and greatest coarse statistics of each block. At most MAX_BLOCKS rows per
    width reach the driver."""
    def summed(batches):
        def one(x, part):
            stats, of = segment_stats(x, LEVELS[0]), part.column(part.schema.get_field_index("block")).to_numpy()
            ids = np.unique(of)
            low, high = ([f(stats[of == b], 0).tolist() for b in ids] for f in (np.min, np.max))
            width = part.column(part.schema.get_field_index("width")).to_numpy()[0]
            return pa.RecordBatch.from_arrays([pa.array([int(width)] * len(ids), pa.int32()), pa.array(ids, pa.int32()),
                                               pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64()))],
                                              names=["width", "block", "low", "high"])
        yield from _by_width(batches, one)

    parts = vectors.mapInArrow(summed, "width int, block int, low array<double>, high array<double>")
    dims = 2 * LEVELS[0]
    ends = [f(F.get("low" if f is F.min else "high", F.lit(j))).alias(f"{name}{j}") for f, name in ((F.min, "l"), (F.max, "h"))
            for j in range(dims)]
    found: dict[int, list] = {}
    for r in parts.groupBy("width", "block").agg(*ends).collect():
        row = [[r[f"{name}{j}"] for j in range(dims) if r[f"{name}{j}"] is not None] for name in "lh"]
        found.setdefault(r["width"], []).append((r["block"], *row))
    return {w: tuple(np.array(c) for c in zip(*sorted(rows, key=lambda r: r[0]))) for w, rows in found.items()}


def promises(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per query and block an upper bound on the inner product with any vector of the block."""
    stats = segment_stats(q, LEVELS[0])
    up, down = np.maximum(stats, 0), np.minimum(stats, 0)
    bound = up @ high.T + down @ low.T
    return bound + 1e-9 * np.abs(bound) + 1e-6  # rounding never hides a block


def routed(queries: DataFrame, blocks: dict, first: bool) -> DataFrame:
    """(query, cb): each query with the block that promises most, or, by its ``floor``, with all others that reach it."""
    def task(batches):
        def one(q, part):
            ids, low, high = blocks[int(part.column(part.schema.get_field_index("width")).to_numpy()[0])]
            bound = promises(q, low, high)
            best = bound.argmax(1)
            if first:
                rows, cols = np.arange(len(q)), best
            else:
                floors = part.column(part.schema.get_field_index("floor")).to_numpy(zero_copy_only=False).astype(float)
                ok = bound >= np.where(np.isnan(floors), -np.inf, floors)[:, None]
                ok[np.arange(len(q)), best] = False
                rows, cols = np.nonzero(ok)
            return part.take(pa.array(rows)).append_column("cb", pa.array(ids[cols], pa.int32()))
        yield from _by_width(batches, one)

    return queries.mapInArrow(task, T.StructType([*queries.schema.fields, T.StructField("cb", T.IntegerType())]))


def _searched(routes: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qrow, query_id, vec_id, score, n, floor, floor_id) of the k best of each routed query in its block, without those
    that come after its k-th best so far (``floor`` and, among equal scores, ``floor_id``). A block that many queries come
    to is sent once per QUERY_BLOCK of them."""
    routes = materialize(routes, "routes")
    parts = routes.groupBy("width", "cb").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    q = routes.join(parts, ["width", "cb"]).withColumn("part", F.pmod(F.xxhash64("qrow", F.lit(3)), "parts").cast("int")).drop("parts")
    x = vectors.select("vec_id", "v", "width", "n", F.col("block").alias("cb")).join(parts, ["width", "cb"])
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(key, q, x):
        width = key[0].as_py()
        out = [np.zeros(0, np.int64)] * 5 + [np.zeros(0), np.zeros(0, np.int64)]
        if q.num_rows and x.num_rows:
            qid, xid = q.column("vec_id").to_numpy(), x.column("vec_id").to_numpy()
            floor = q.column("floor").to_numpy().astype(float)
            floor = np.where(np.isnan(floor), -np.inf, floor)
            hq, hx, scores = best_in_block(qid, _matrix(q.column("v"), width), xid, _matrix(x.column("v"), width), k, floor)
            full = np.bincount(hq, minlength=len(qid)) >= k  # rows come query by query, best first
            last, last_id = np.full(len(qid), np.nan), np.zeros(len(qid), np.int64)
            last[hq], last_id[hq] = scores, xid[hx]  # the last written is the least
            last[~full] = np.nan
            weight = q.column("n").to_numpy()[hq] * x.column("n").to_numpy()[hx]
            out = [q.column("qrow").to_numpy()[hq], qid[hq], xid[hx], scores, weight, last[hq], last_id[hq]]
            ends = q.column("floor_id").to_numpy().astype(float)[hq]
            before = ~((scores == floor[hq]) & (xid[hx] > ends))
            out = [o[before] for o in out]
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(o, kind, from_pandas=True) for o, kind in zip(out, kinds)],
                                    names=["qrow", "query_id", "vec_id", "score", "n", "floor", "floor_id"])

    keys = ["width", "cb", "part"]
    return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(
        search, "qrow long, query_id long, vec_id long, score long, n long, floor double, floor_id long")


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of the components floor(64 x)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    # scaled here, floored in the tasks: Spark's floor gives longs, which would overflow on huge components
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.transform("embedding", lambda x: x.cast("double") * 64).alias("v"))
    rows = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).select("vec_id", "v", F.size("v").alias("width"), "n")
    vectors = blocked(materialize(rows, "vectors"))
    blocks = summaries(vectors)
    queries = vectors.filter(F.col("vec_id") % every == 0).select(
        "vec_id", "v", "width", "n", F.xxhash64("vec_id", "v").alias("qrow"))
    first = materialize(_searched(routed(queries.withColumns({
        "floor": F.lit(None).cast("double"), "floor_id": F.lit(None).cast("long")}), blocks, True), vectors, k), "first-block")
    floors = first.groupBy("qrow").agg(F.max("floor").alias("floor"), F.max("floor_id").alias("floor_id"))
    rest = routed(queries.join(floors, "qrow", "left").select(
        "vec_id", "v", "width", "n", "qrow", "floor", "floor_id"), blocks, False)
    found = first.unionByName(_searched(rest, vectors, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("n").over(order)).filter(F.col("place") <= k)
    # repeated rows are written out, up to the k-th
    start = F.col("upto") - F.col("n") + 1
    found = found.filter(start <= k).select("query_id", "vec_id", "score", F.explode(F.sequence(
        start, F.least("upto", F.lit(k).cast("long")))).alias("rank"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
