"""Token counts, prefix tables and packing against the tokenizer library."""

import struct
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import packing, token_counts, tokens

SPECIAL = "<|endoftext|>"
MORE = [(40, f"a {SPECIAL}{SPECIAL} b  \n\n c{SPECIAL}", "en", "s", 1), (41, "  two  spaces\n\n\nlines   ", "en", "s", 1),
        (42, "it's we're they've you'll I'd I'm don't 'tis ''re'r 'l", "en", "s", 1), (43, "a" * 3000, "en", "s", 1),
        (44, " " * 500 + "x", "en", "s", 1), (45, " \x85\xa0 　x\x1c\x1dy", "en", "s", 1), (46, SPECIAL, "en", "s", 1),
        (47, "<|endof text|> 12345 !!!'re ---", "en", "s", 1)]
ROWS = H.TRICKY + MORE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT))


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_every_prefix(library):
    counter = tokens.PrefixCounter(tokens.vocabulary())
    texts = [r[1] for r in ROWS if r[1] and len(r[1]) < 1000]
    texts += [t[:300] for t in ("naïve déjà-vu\t\t x", "  a  'll  b'v", f"q  {SPECIAL}  '{SPECIAL}'re z")]
    for text in texts:
        want = [len(ids(library, text[:n])) for n in range(1, len(text) + 1)]
        assert counter.counts(text).tolist() == want, text


def test_sample_table_prefixes(spark, library):
    counter = tokens.PrefixCounter(tokens.vocabulary())
    for row in spark.read.parquet(f"{H.SF}/documents.parquet").filter("n_chars < 900").limit(12).collect():
        assert counter.counts(row.text).tolist() == [
            len(ids(library, row.text[:n])) for n in range(1, len(row.text) + 1)]


def test_every_character(library):
    """Encoder and splitter agree with the library around every code point."""
    splitter, encoder = tokens.Splitter(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary())
    for first in range(0, 0x110000, 256):
        cps = [c for c in range(first, first + 256) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}1 {chr(c)}.{chr(c)} " for c in cps)
        if text:
            want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert splitter.words(text) == want, hex(first)
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(library, text), hex(first)


def test_runs_too_deep_for_the_rank_encoder(library):
    encoder = tokens.Encoder(tokens.vocabulary())
    for text in (" " * 300_000 + "x", "\n" * 50_000, "a" * 100_000, "a" + "\t " * 100_000 + "b"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(library, text)


def test_counts(spark, library):
    got = H.rows_of(token_counts.token_counts(H.docs(spark, ROWS, extra=True)), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for r in ROWS:
        n = len(ids(library, r[1]))
        want.append((r[0], len((r[1] or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(H.docs(spark, [])).count() == 0


def test_stored_table_answers(spark, library):
    rows = [r for r in ROWS if not r[1] or len(r[1]) < 600]
    table = token_counts.prefix_table(H.docs(spark, rows)).select(
        "doc_id", token_counts.tokens_after(F.col("prefix_tokens"), F.lit(7)).alias("after"),
        token_counts.chars_within(F.col("prefix_tokens"), F.lit(5)).alias("within"))
    for r in table.collect():
        text = next(t[1] for t in rows if t[0] == r.doc_id) or ""
        assert r.after == len(ids(library, text[:7]))
        assert r.within == max(n for n in range(len(text) + 1) if len(ids(library, text[:n])) <= 5)


def check_packing(pieces, rows, library):
    want, got, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for doc, text in rows:
        want[doc].append(ids(library, text) + [1])
    for p in pieces:
        got[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(got) == set(want)
    for doc, all_ids in want.items():
        if len(all_ids) > 1:  # repeated ids: only the totals are comparable
            assert sum(p.length for p in got[doc]) == sum(map(len, all_ids))
            continue
        at = 0
        for p in sorted(got[doc], key=lambda p: p.start):
            part = all_ids[0][p.start:p.start + p.length]
            assert (p.start, p.doc_tokens) == (at, len(all_ids[0]))
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(all_ids[0])
    lengths = []
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lengths.append(at)
    assert max(lengths) <= packing.LENGTH
    return lengths


def test_packing(spark, library):
    rows = ROWS + [(100 + i, "word " * (i * 37 % 4000), "en", "s", 1) for i in range(60)]
    df = H.docs(spark, rows, extra=True).repartition(5)
    df = spark.createDataFrame(df.collect(), df.schema).coalesce(3)
    lengths = check_packing(packing.pack(df).collect(), [(r[0], r[1]) for r in rows], library)
    assert sum(n < packing.LENGTH for n in lengths) <= 1
    assert packing.pack(H.docs(spark, [])).count() == 0


def test_packing_sample_table(spark, library):
    df = spark.read.parquet(f"{H.SF}/documents.parquet")
    lengths = check_packing(packing.pack(df).collect(), [(r.doc_id, r.text) for r in df.collect()], library)
    assert sum(lengths) / (packing.LENGTH * len(lengths)) > 0.98


def test_long_words_take_linear_time():
    """A word of 2,000,000 random letters: its work is a few lookups per byte, and its counts are the encoder's."""
    import random
    import time

    content = tokens.vocabulary()
    counter, encoder, rng = tokens.PrefixCounter(content), tokens.Encoder(content), random.Random(1)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2_000_000))
    counter.counts("w" * 100)  # makes the automaton
    began = time.process_time()
    counts = counter.counts(word)
    assert time.process_time() - began < 15  # about 4 s; 60 microseconds a byte would be 120 s
    for n in (1, 7, 48, 49, 1000, 50_000):
        assert counts[n - 1] == len(encoder.encode(word[:n])) // 4
    assert counter.held > 8_000_000
    list(counter.counts_of(["x"] * 2))
    counter.held = tokens.CACHE_BYTES + 1
    list(counter.counts_of(["y z"]))
    assert counter.held < 100 and len(counter.known) < 10  # the memory is bounded by bytes, too
