import hashlib
import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import importance_sample as I

ITEMS = "item_id long, text string"


def brute(rows, items, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """Sorted (doc_id, n_features, weight, score, rank) of rows (doc_id, text), one n-gram at a time."""
    def features(text):
        w = H.words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1)
                for i in range(len(w) - n + 1)]

    raw, target = Counter(), Counter()
    for _, text in rows:
        raw.update(features(text))
    for text in items:
        target.update(features(text))
    s, t = sum(raw.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for k, (doc, text) in enumerate(rows):
        f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, k])
    able = sorted((r for r in out if len(H.words(rows[r[5]][1])) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return H.rows_of(df, "doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, longest):
    rows = [r for r in H.TRICKY] + [(100 + k, " ".join(f"w{(k * j) % 37}" for j in range(15 + k)), "en", "s", 0) for k in range(60)]
    rows += [(130, rows[-30][1], "en", "s", 0)] * 40  # repeated rows
    items = [(1, "w1 w2 w3 W4 w1"), (2, None), (3, ""), (None, "w5 one two")]
    out = I.resample(H.docs(spark, rows, extra=True), spark.createDataFrame(items, ITEMS), longest=longest)
    assert got(out) == brute([r[:2] for r in rows], [t for _, t in items], longest)


def test_empty_tables(spark):
    none, item = H.docs(spark, []), spark.createDataFrame([], ITEMS)
    assert I.sample(none, item).collect() == []
    rows = [(1, "a b", "en", "s", 0), (2, None, None, None, None)]
    assert got(I.sample(H.docs(spark, rows), item)) == brute([r[:2] for r in rows], [])


def test_ranks_cross_ranges(spark):
    """Hundreds of equal scores spread over several ranges still get every rank once."""
    rows = [(k // 50, "x " * 25, "en", "s", 0) for k in range(1000)]
    ranks = sorted(r["rank"] for r in I.sample(H.docs(spark, rows).repartition(7), spark.createDataFrame([], ITEMS)).collect() if r["rank"])
    assert ranks == list(range(1, 101))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aZ9 é-\n漢", max_size=60), st.integers(1, 4))
def test_chained_hashes(text, longest):
    w = H.words(text)
    want = Counter(zlib.crc32(" ".join(w[i:i + n]).encode()) % 97 for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    assert I.words(text) == [x.encode() for x in w] and I.Features(longest, 97).count(I.words(text)) == want
