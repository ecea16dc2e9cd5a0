"""Registered queries of this package: key -> (spark, sf_dir) -> DataFrame over the whole intended tables, and the
DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from lendwise.llm import (
    chat_format,
    decontamination,
    filter_audit,
    importance_sample,
    jaccard_join,
    language_id,
    packing,
    quality_fm,
    secret_scan,
    token_counts,
    topk,
    url_filter,
    warc,
)
from lendwise.llm.common import table


def op1_url_filter(spark, sf_dir):
    """Rule and link-graph verdict of every page's url."""
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


def op2_decontamination(spark, sf_dir):
    """Winnowing decontamination of all documents against all benchmark items."""
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark, sf_dir):
    """Secret spans of every document, found through a trigram index."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens, a row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    """All pages written as WARC records and read back by their boundary chain."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark, sf_dir):
    """Near-duplicate class and number of links of every document."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    """Quality score of every document from a factorisation machine."""
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark, sf_dir):
    """Token counts of every document by prefix dynamic programming."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    """Language of every document by Kneser-Ney character models."""
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op10_topk(spark, sf_dir):
    """The 20 nearest vectors of every twentieth vector, exactly."""
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op11_importance_sample(spark, sf_dir):
    """Weight, score and rank of every document in a draw towards the benchmark's word distribution."""
    return importance_sample.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark, sf_dir):
    """What each of five filters removes, at every place of every order, per source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_chat_format(spark, sf_dir):
    """All conversations folded from an event log, formatted, and read back."""
    return chat_format.round_trip(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_decontamination, op3_secret_scan, op4_packing, op5_warc, op6_ngram_jaccard, op7_quality,
    op8_token_counts, op9_language_id, op10_topk, op11_importance_sample, op12_filter_audit, op13_chat_format)}
ORACLES = {"op1_url_filter": url_filter.ORACLE, "op2_decontamination": decontamination.ORACLE,
           "op5_warc": warc.ORACLE, "op6_ngram_jaccard": jaccard_join.ORACLE, "op10_topk": topk.ORACLE,
           "op11_importance_sample": importance_sample.ORACLE, "op12_filter_audit": filter_audit.ORACLE,
           "op13_chat_format": chat_format.ORACLE}
