"""Language ID and the quality classifier: held-out accuracy, model identities and edge rows."""

import math
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import language_id as L
from lendwise.llm import quality_fm as Q

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert sum(r.rejected for r in out) == 0
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edge_rows(spark):
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars)
            for r in spark.read.parquet(f"{H.SF}/documents.parquet").collect()]
    noise = (900_001, " ".join("".join(chr(97 + (i * i * 7 + k * 13) % 26) for k in range(9)) for i in range(300)),
             None, "s", 1)
    rows = base + [(900_100 + (r[0] or 0), *r[1:]) for r in H.TRICKY if r[0]] + [(None, "text without id", "en", "s", 1), noise]
    docs = H.docs(spark, rows, extra=True)
    got = {r.doc_id: r for r in L.language_id(docs).collect()}
    assert len(got) == len({r[0] for r in rows})
    for bare in (900_101, 900_102, 900_103, 900_109):
        assert (got[bare].lang_pred, got[bare].score, got[bare].rejected) == ("und", 0.0, True)
    assert got[900_001].rejected
    kept = L.accepted(docs)
    assert kept.columns == docs.columns and 900_001 not in {r.doc_id for r in kept.select("doc_id").collect()}


def test_nothing_to_learn_from(spark):
    assert {r.lang_pred for r in L.language_id(H.docs(spark, [(1, "some text", None, "s", 1)])).collect()} == {"und"}
    assert L.language_id(H.docs(spark, [])).count() == 0


def test_probabilities_sum_to_one():
    """Over the alphabet and the unseen letter, in every context that was seen."""
    table = L.letter_table()
    rows = []
    for lang, text in (("a", "abba baab ab bab abab " * 3), ("b", "bcc cbc bbc ccb " * 4)):
        key, _ = L.grams([(0, text)], table)
        g, n = np.unique(key, return_counts=True)
        rows.append((lang, g, n))
    model = L.build(rows)
    letters = np.unique(np.concatenate([r[1] for r in rows]) & np.uint64(0xFFFF))
    for context in model.contexts[0].tolist():
        keys = np.array([context << 16 | int(c) for c in [*letters.tolist(), 0x3B1]], np.uint64)
        total = np.exp2(L._log_probs(model, keys, 0).astype(float)).sum(0)
        assert np.allclose(total, 1, atol=1e-5)


def test_long_text_in_parts():
    texts = ["ab cd " * 1000, "", "x"]
    parts = list(L.chunks(texts, 700))
    assert "".join(p for c in parts for r, p in c if r == 0) == texts[0] and all(len(p) <= 700 for c in parts for _, p in c)


def test_quality_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = Q.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.93
    assert all(0 <= r.score <= 1 for r in out)


def test_quality_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (4, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (8, 5, 0)],
                                   "doc_id long, quality int, toxic int")
    out = Q.classify(H.docs(spark, H.TRICKY, extra=True), labels).collect()
    assert len(out) == len(H.TRICKY) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.classify(H.docs(spark, H.TRICKY), none).collect()} == {0.5}
    assert Q.classify(H.docs(spark, []), labels).count() == 0


def test_linear_time_identity():
    """The score equals the sum over all feature pairs."""
    rng = np.random.default_rng(5)
    bucket, weight, stats = Q.features("some words and some more words, 12 !!", 30)
    assert len(stats) == Q.N_STRUCTURE
    width = Q.N_STRUCTURE + Q.BUCKETS
    m = Q.Model(0.3, rng.normal(size=width) * 0.1, rng.normal(size=(width, Q.RANK)) * 0.1, np.zeros(Q.N_STRUCTURE),
                np.ones(Q.N_STRUCTURE))
    at = np.concatenate([np.arange(Q.N_STRUCTURE), Q.N_STRUCTURE + bucket])
    x = np.concatenate([np.clip(stats, -4, 4), weight])
    z = m.bias + m.linear[at] @ x
    for i in range(len(at)):
        for j in range(i):
            z += m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j]
    assert np.isclose(m.score(bucket, weight, stats), 1 / (1 + np.exp(-z)))


def test_model_in_tables_is_the_whole_model(spark):
    """More counts than tasks hold: no count is left out, and the scores are those of the model in arrays."""
    docs = spark.read.parquet(f"{H.SF}/documents.parquet")
    docs = docs.unionByName(H.docs(spark, H.TRICKY).select(*docs.columns))
    whole, written = L.train(docs), L.train(docs, max_pairs=100)
    assert isinstance(whole, L.Model) and isinstance(written, L.Tables) and whole.langs == written.langs
    want, got = ([(r.text or "", r.lang_pred, round(r.score, 4), r.chars, r.bits) for r in L.scored(docs, m, ["text"]).selectExpr(
        "text", "__lang_pred lang_pred", "__score score", "__chars chars", "__bits bits").collect()] for m in (whole, written))
    want, got = sorted(want), sorted(got)
    assert [r[:4] for r in want] == [r[:4] for r in got]
    assert np.allclose([r[4] for r in want], [r[4] for r in got], atol=1e-4)


def test_rare_language_is_calibrated_in_a_large_table(spark):
    """A language with few documents among very many has its limit: noise in its letters is rejected."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter(
        "lang = 'de' AND length(text) BETWEEN 500 AND 3000").orderBy("doc_id").limit(40).collect()]
    rare = [(i, t, "de", "s", 1) for i, t in enumerate(texts)]
    noise = (50, "".join(texts[0][(i * 367) % len(texts[0])] for i in range(len(texts[0]))), None, "s", 1)
    many = spark.range(1000, 41000).selectExpr("id AS doc_id", "'μερικα απλα λογια της κοινης γλωσσας' AS text",
                                               "'el' AS lang", "'s' AS source", "1L AS n_chars")
    docs = H.docs(spark, [*rare, noise]).unionByName(many)
    out = L.language_id(docs).filter("lang_pred = 'de'").collect()
    assert len(out) == 41 and [r.doc_id for r in out if r.rejected] == [50]


def test_quality_training_rows_are_bounded(spark):
    """One chosen document with thousands of rows, equal or not, sends a bounded number of rows to the driver."""
    from lendwise.llm import quality_fm as Q

    doc = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5)
    labels = spark.createDataFrame([(doc, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fit, Q.fit = Q.fit, lambda rows: seen.append(len(rows)) or fit(rows)
    try:
        same = spark.range(5000).selectExpr(f"CAST({doc} AS LONG) AS doc_id", "'a text of words' AS text", "15L AS n_chars")
        Q.train(same, labels, 16)
        Q.train(same.selectExpr("doc_id", "concat(text, uuid()) AS text", "n_chars"), labels, 16)
    finally:
        Q.fit = fit
    assert seen[0] == 1 and seen[1] <= 64


def test_cuts_change_nothing():
    """However a text is cut into parts, its 4-grams are those of the whole text, gaps and long blanks included."""
    rng = np.random.default_rng(8)
    table = L.letter_table()
    texts = ["".join(rng.choice(list("abcé, 1\n"), n)) for n in (0, 1, 5, 900, 3000)] + ["a" + " " * 500 + "b", " " * 300, "1" * 400 + "ab c"]
    want = L.grams([(k, t) for k, t in enumerate(texts)], table)
    for size in (1, 2, 3, 7, 64, 1000):
        read = L.Grams(table)
        got = [read(parts) for parts in L.chunks(texts, size)]
        assert np.concatenate([k for k, _ in got]).tolist() == want[0].tolist()
        assert np.concatenate([r for _, r in got]).tolist() == want[1].tolist()


def kneser_ney(counts, context, letter, alphabet):
    """log2 probability by the textbook, from a dict {gram: count} of 4-letter tuples of one language."""
    levels = [counts]
    for k in (3, 2, 1):
        shorter = {}
        for g in levels[-1]:
            shorter[g[1:]] = shorter.get(g[1:], 0) + 1
        levels.append(shorter)

    def p(level, ctx, c):
        if level == 4:
            return 1 / alphabet
        table = levels[level]
        n1, n2 = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.1, 0.1), 0.95)
        seen = {g: v for g, v in table.items() if g[:-1] == ctx}
        low = p(level + 1, ctx[1:], c)
        if not seen:
            return low
        total = sum(seen.values())
        return max(seen.get((*ctx, c), 0) - d, 0) / total + d * len(seen) / total * low

    return math.log2(p(0, context, letter))


def test_probabilities_are_the_textbooks():
    """Every 4-gram of three small texts under each language's model, by dictionaries and recursion."""
    table = L.letter_table()
    texts = {"a": "abba baab ab bab abab cab " * 2, "b": "bcc cbc bbc ccb abc", "c": "éa éb éé a"}
    rows, plain = [], {}
    for lang, text in texts.items():
        key, _ = L.grams([(0, text)], table)
        rows.append((lang, *np.unique(key, return_counts=True)))
        plain[lang] = {}
        for k in key.tolist():
            g = tuple(k >> 16 * j & 0xFFFF for j in (3, 2, 1, 0))
            plain[lang][g] = plain[lang].get(g, 0) + 1
    model = L.build(rows)
    alphabet = len({g[3] for c in plain.values() for g in c}) + 1
    keys = np.unique(np.concatenate([r[1] for r in rows]))
    got = L._log_probs(model, keys, 0)
    for k, logs in zip(keys.tolist(), got):
        g = tuple(k >> 16 * j & 0xFFFF for j in (3, 2, 1, 0))
        for lang, value in zip(model.langs, logs):
            assert abs(value - kneser_ney(plain[lang], g[:3], g[3], alphabet)) < 1e-4


def test_rare_languages_reject_too(spark):
    """A language with two documents takes its limit from the others' spread."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars)
            for r in spark.read.parquet(f"{H.SF}/documents.parquet").collect()]
    rare = "жили были старик со старухой у самого синего моря они жили в ветхой землянке ровно тридцать лет и три года "
    rng = np.random.default_rng(2)
    noise = " ".join("".join(rng.choice(list("жбшщцфхэюя"), 9)) for _ in range(200))
    ids = [k for k in range(910_000, 910_040) if zlib.crc32(str(k).encode()) % 5]
    rows = base + [(ids[0], rare * 3, "ru", "s", 1), (ids[1], rare * 2, "ru", "s", 1), (ids[2], noise, None, "s", 1),
                   (ids[3], rare, None, "s", 1)]
    got = {r.doc_id: r for r in L.language_id(H.docs(spark, rows)).collect()}
    assert got[ids[2]].lang_pred == got[ids[3]].lang_pred == "ru"
    assert got[ids[2]].rejected and not got[ids[3]].rejected and not got[ids[0]].rejected


def test_written_model_in_blocks_and_slices(spark, monkeypatch):
    """The bits depend neither on where blocks end nor on how many 4-grams' sums are held at once; letters that the model
    has not seen have no terms; rows keep their other columns, repeated and null ones included."""
    docs = spark.read.parquet(f"{H.SF}/documents.parquet")
    model = L.train(docs, max_pairs=100)
    texts = [r.text for r in docs.orderBy("doc_id").limit(12).collect()] + ["", None, "ჟღერს 123 მთა"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["c0", "c1"])
    monkeypatch.setattr(L.TaskContext, "get", lambda: type("", (), {"partitionId": lambda self: 3})())

    def bits(cells, grams):
        monkeypatch.setattr(L, "CELLS", cells)
        monkeypatch.setattr(L, "GRAMS", grams)
        monkeypatch.setattr(L, "CHUNK", 1 << 12 if grams < 1000 else 1 << 20)
        packed = pa.Table.from_batches(list(L._packed([batch, batch.slice(0, 0)])))
        wanted = spark.createDataFrame(packed.select(["block", "kind", "key"]).filter(pc.greater_equal(packed["kind"], 0)))
        found = wanted.join(model.deltas, ["kind", "key"]).toArrow()
        out = []
        for row in packed.filter(pc.less(packed["kind"], 0)).to_pylist():
            terms = L.Terms(found.filter(pc.equal(found["block"], row["block"])), len(model.langs))
            for rows in pa.ipc.open_stream(row["data"]):
                out += zip(rows["c0"].to_pylist(), rows["c1"].to_pylist(),
                           *L._bits(rows["c1"].to_pylist(), terms, model.unseen), strict=True)
        return packed["block"].unique().to_pylist(), out

    blocks, want = bits(1 << 22, 1 << 18)
    more, got = bits(4001, 10)
    assert blocks == [3 << 32] and len(more) > 1 and [r[:2] for r in want] == [r[:2] for r in got] == list(enumerate(texts))
    assert np.allclose([r[2] for r in want], [r[2] for r in got]) and [r[3] for r in want] == [r[3] for r in got]
    assert want[12][3] == want[13][3] == 0 and want[14][3] > 0
    rows = docs.limit(30).selectExpr("doc_id", "text", "NULL AS `a.b`").union(docs.limit(30).selectExpr("doc_id", "text", "'x'"))
    monkeypatch.undo()
    out = L.scored(rows, model, ["doc_id", "a.b"])
    assert out.columns == ["doc_id", "a.b", *L.SCORES] and out.count() == 60
    assert L.scored(rows.limit(0), model, ["doc_id"]).count() == 0
