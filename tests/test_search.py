"""Trigram search: the books that a folded LIKE over all titles finds, from the needle's postings alone."""

import re
import tempfile
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendwise.operators import reports as R
from lendwise.operators import search as S
from lendwise.plans import formatted_plan
from lendwise.sources.tables import with_collation

BOOKS = [("9780000000001", "Crème Brûlée  "), ("9780000000002", "CREME DE LA CREME"), ("9780000000003", "100% Cotton_wool"),
         ("9780000000004", None), ("9780000000005", ""), ("9780000000006", "ab"), ("9780000000007", "Ångström und Öl"),
         ("9780000000008", "Crème, décomposée"), ("9780000000009", "a\\b path"), ("9780000000009", "a\\b path"),
         (None, "creme without a number"), ("9780000000010", "ΆΛΦΑ ёлка"), ("9780000000011", "x" * 5000 + "end")]
NEEDLES = ["creme", "CRÈME", "br%lee", "c_eme", "100%", "n_w", "ol", "a", "", None, "97800000000", "009", "zzz", "\\b p",
           "angstrom und", "αλφα", "елка", "decompose", "end", "%", "creme%creme", "e  "]


def plain(text):
    out = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in out if not "̀" <= c <= "ͯ")


def found(needle):
    if not needle:
        return sorted(BOOKS, key=repr)
    pattern = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in plain(needle)), re.S)
    return sorted((b for b in BOOKS if any(t is not None and pattern.search(plain(t).rstrip(" ")) for t in (b[1], b[0]))), key=repr)


@pytest.fixture(scope="module")
def index(spark):
    books = spark.createDataFrame(BOOKS, "isbn string, title string")
    return S.TitleIndex(tempfile.mkdtemp(prefix="lendwise-index-"), 8).write(books)


@pytest.mark.parametrize("needle", NEEDLES)
def test_finds_what_like_finds(spark, index, needle):
    got = sorted((tuple(r) for r in index.search(spark, needle).collect()), key=repr)
    # a book without an ISBN has no postings: only needles without trigrams find it
    lost = [(None, "creme without a number")] if needle and S.trigrams(needle) else []
    assert got == [b for b in found(needle) if b not in lost]


def test_reads_only_the_postings_of_its_trigrams(spark, index):
    plan = formatted_plan(index.candidates(spark, "creme"))
    buckets = re.search(r"PartitionFilters: \[bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))\]", plan)
    want = {r[0] for r in spark.createDataFrame([(g,) for g in S.trigrams("creme")], "g string").select(
        S._bucket(F.col("g"), 8)).collect()}
    assert {int(b) for b in (buckets[1] or buckets[2]).split(",")} == want and "In(trigram" in plan
    assert index.candidates(spark, "c_e") is None


def test_empty_index(spark):
    index = S.TitleIndex(tempfile.mkdtemp(prefix="lendwise-index-")).write(spark.createDataFrame([], "isbn string, title string"))
    assert index.search(spark, "abc").collect() == [] and index.search(spark, "a").collect() == []


def test_catalog_by_index_fold_and_collation_agree(spark, projected):
    index = S.TitleIndex(tempfile.mkdtemp(prefix="lendwise-index-")).write(projected.book)
    key = lambda df: sorted((str(r["isbn"]), r["subject_popularity_rank"]) for r in df.collect())
    want = key(R.d03_book_catalog(projected, search="WÍDGET", fold=True))
    assert want == key(R.d03_book_catalog(projected, search="WÍDGET", index=index)) and len(want) > 3
    assert want == key(R.d03_book_catalog(with_collation(projected, "UNICODE_CI_AI_RTRIM"), search="WÍDGET"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abÉ%_ç ", max_size=12), st.text(alphabet="abéc ", max_size=12))
def test_trigrams_are_necessary(needle, text):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in plain(needle))
    if re.search(pattern, plain(text)):
        assert all(g in plain(text) for g in S.trigrams(needle))
