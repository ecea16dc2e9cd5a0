import math
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import topk as K

VECTORS = "vec_id long, embedding array<float>, label int"
COLS = ("query_id", "rank", "vec_id", "score")


def brute(rows, k=20):
    fine = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % 20 == 0}):
        hits = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for j, a in fine if j == q
                      for i, b in fine if i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])]
    return sorted(out, key=repr)


def data():
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(size=16)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[40][1]) for i in range(40)]  # ties
    rows += [(500, None), (501, []), (502, [1.0, None]), (503, [float("nan")] * 16), (504, [float("inf")] * 16), (None, rows[1][1]),
             (520, [0.5, -0.25]), (521, [0.5, 0.75]), (540, []), (560, [0.0] * 16), (7, rows[7][1]), (0, rows[0][1])]
    rows += [(41, rows[40][1])] * 3 + [(20, rows[21][1]), (20, rows[22][1])]  # repeated candidates; a query of three vectors
    return rows


def test_equals_brute_force(spark, monkeypatch):
    for sizes in ((2048, 4096, 512), (5, 40, 16)):
        for name, n in zip(("QUERY_BLOCK", "CANDIDATE_BLOCK", "STEP"), sizes, strict=True):
            monkeypatch.setattr(K, name, n)
        df = spark.createDataFrame([(*r, 1) for r in data()], VECTORS).selectExpr("*", "1 AS rank", "2 AS score", "3 AS v", "4 AS qb")
        assert H.rows_of(K.nearest(df), *COLS) == brute(data())


def test_oracle_and_empty(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{H.SF}/embeddings.parquet'")
    got = H.rows_of(K.nearest(spark.read.parquet(f"{H.SF}/embeddings.parquet")), *COLS)
    assert got == sorted(con.execute(K.ORACLE).fetchall(), key=repr)
    assert K.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_huge_components(spark):
    rows = [(0, [3e38, 1.0]), (1, [1e20, 1.0]), (2, [-1e20, 0.0]), (3, [0.0, 2.0])]
    got = K.nearest(spark.createDataFrame([(*r, 1) for r in rows], VECTORS)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2 ** 63 - 1), (3, 64 * 128), (2, -2 ** 63)]


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, x = np.floor(rng.normal(size=(20, 50)) * 64), np.floor(rng.normal(size=(30, 50)) * 64)
    coarse, fine = (K.segment_stats(q, s) @ K.segment_stats(x, s).T for s in K.LEVELS)
    exact = q @ x.T
    assert (coarse >= fine - 1e-6).all() and (fine >= exact - 1e-6).all()


def test_repeated_rows_equal_the_oracle(spark):
    import duckdb

    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    got = H.rows_of(K.nearest(spark.createDataFrame([(*r, 1) for r in rows], VECTORS)), *COLS)
    assert got == sorted(con.execute(K.ORACLE).fetchall(), key=repr) and len(got) == 5


def test_promises_hold_and_spare_block_pairs(spark, monkeypatch):
    """Clustered vectors: most queries are sent to few of the blocks, and the result is the brute force's."""
    monkeypatch.setattr(K, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 32)) * 8
    rows = [(i, np.float32(centres[i % 25] + rng.normal(size=32) * 0.05).tolist()) for i in range(1000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    assert H.rows_of(K.nearest(df), *COLS) == brute(rows)
    vectors = K.blocked(spark.createDataFrame([(i, [float(64 * x) for x in v], 32, 1) for i, v in rows], "vec_id long, v array<double>, width int, n long"))
    blocks = K.summaries(vectors)
    ids, low, high = blocks[32]
    held = vectors.toPandas()
    x = np.floor(np.stack(held["v"].to_numpy()))
    bound = K.promises(x[:50], low, high)
    exact = x[:50] @ x.T
    for b, number in enumerate(ids):
        assert (bound[:, b] >= exact[:, (held["block"] == number).to_numpy()].max(1)).all()
    queries = vectors.filter("vec_id % 20 = 0").select("vec_id", "v", "width", "n", K.F.col("vec_id").alias("qrow"))
    floors = {q: float(min(s for i, _, _, s in brute(rows) if i == q)) for q in range(0, 1000, 20)}
    known = queries.join(spark.createDataFrame(list(floors.items()), "qrow long, floor double"), "qrow").select(*queries.columns, "floor")
    sent = K.routed(known, blocks, False).count() + 50
    assert sent < 0.4 * 50 * len(ids)
