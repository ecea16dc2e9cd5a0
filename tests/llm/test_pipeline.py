"""The pipeline against brute-force stages, its contract, and the separation of this package."""

import re
import sys
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H
from test_tokens import check_packing

import corpus_pipeline as P
from lendwise.llm import language_id, packing, queries, tokens

ROOT = Path(__file__).resolve().parents[2]


def expected(rows, items, rejected):
    """Rows (doc_id, text) that reach packing, with secrets masked."""
    kept = [r for r in rows if r[0] not in rejected]
    first = {c for _, c, _ in H.classes(kept)}
    kept = [r for r in kept if r[0] in first]
    dirty = {r[0] for r in H.contamination(kept, items) if r[5]}
    return [(d, H.masked(t)) for d, t in kept if d not in dirty]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{H.SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{H.SF}/benchmark.parquet").collect()]
    rejected = {r.doc_id for r in language_id.language_id(docs).filter("rejected").collect()}
    want = expected([(r.doc_id, r.text) for r in docs.collect()], items, rejected)
    library = Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT))
    lengths = check_packing(P.run(spark, H.SF).collect(), want, library)
    assert len(want) < docs.count() and sum(n < packing.LENGTH for n in lengths) <= 1


def test_stages_keep_the_documents_columns(spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "packing"]
    base = spark.read.parquet(f"{H.SF}/documents.parquet")
    docs = H.docs(spark, H.TRICKY, extra=True)
    for name, stage in P.STAGES:
        got = stage(spark, docs, H.SF)
        if name != "packing":
            assert got.schema.names == docs.schema.names, name
            assert stage(spark, base.limit(0), H.SF).columns == base.columns and stage(spark, base.limit(0), H.SF).count() == 0
        assert got.count() > 0, name


def test_one_query_for_each_operator():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(names)


def test_nothing_else_imports_this_package():
    for path in (ROOT / "lendwise").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"lendwise\.llm|from lendwise import llm|corpus_pipeline", path.read_text()), path


def test_native_operators_use_no_python_in_tasks():
    for name in ("url_filter", "decontamination", "secret_scan", "components", "chat_format"):
        text = (ROOT / "lendwise" / "llm" / f"{name}.py").read_text()
        assert not re.search(r"udf|mapIn|applyIn|toPandas|\.rdd", text), name
