import random
import re
import sys
from collections import defaultdict
from itertools import permutations
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, doc, low):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and low is not None and doc > low}


def brute(rows, labels):
    """Every order applied row by row to rows (doc_id, text, source)."""
    lows = {}
    for doc, text, _ in rows:
        if doc is not None:
            lows[text or ""] = min(doc, lows.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc, text, source in rows:
        parts[source or ""].append((doc, fails(text or "", doc, lows.get(text or ""))))
    out = []
    for part, members in parts.items():
        shapley, lines = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = members
            for step, name in enumerate(order, 1):
                gone = [d for d, f in left if f[name]]
                left = [(d, f) for d, f in left if not f[name]]
                redundant = sum(f[name] and any(f[x] for x in order[:step - 1]) for _, f in members)
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in members)
                shapley[name] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), redundant, alone,
                              sum(d in good for d in gone), sum(d in toxic for d in gone), name))
        out += [(*x[:9], shapley[x[9]]) for x in lines]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(r[0], r[1], r[3]) for r in H.TRICKY]
    long = [" ".join(rng.choice(["ab", "Cd", "e$", "f"]) + str(rng.randrange(400)) for _ in range(rng.randrange(150, 300))) for _ in range(20)]
    rows += [(rng.randrange(60), rng.choice(long), rng.choice(["a", None, "", "long"])) for _ in range(150)]
    rows += [(200 + k, long[0], "hot") for k in range(200)] + [(None, long[1], "a"), (-1, long[0] + "x", "a")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 260, 2)] + [(4, None, None), (4, 1, 1), (None, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = H.docs(spark, [(d, t, None, s, 0) for d, t, s in rows], extra=True).repartition(5)
    out = A.audit(docs, spark.createDataFrame(labels, LABELS))
    assert H.rows_of(out, *COLUMNS) == brute(rows, labels)


def test_small_batches_and_ranges(spark, monkeypatch):
    """Tries that are emptied after a few rows, and prefixes shared by most texts, give the same flags."""
    monkeypatch.setattr(A, "BATCH_ROWS", 3)
    head = "the same long beginning of many texts, over and over, "
    rows = [(k * 7 % 90, head * (k % 3) + str(k * k % 23), "s") for k in range(300)]
    docs = H.docs(spark, [(d, t, None, s, 0) for d, t, s in rows]).repartition(4)
    assert H.rows_of(A.audit(docs, spark.createDataFrame([], LABELS)), *COLUMNS) == brute(rows, [])


def test_empty(spark):
    assert A.audit(H.docs(spark, []), spark.createDataFrame([], LABELS)).collect() == []


def test_splitters_lengthen_heavy_prefixes(spark):
    head = "x" * 50
    texts = H.docs(spark, [(k, head + f"{k:04d}", None, None, 0) for k in range(900)] + [(k, f"{k}", None, None, 0) for k in range(100)])
    cuts = A.splitters(texts, 20)
    assert cuts == sorted(set(cuts)) and len(cuts) <= 80
    deep = [c for c in cuts if c.startswith(head.encode())]
    assert len(deep) >= 10 and max(map(len, deep)) > 50  # the shared beginning is skipped, the texts behind it are parted
    same = H.docs(spark, [(k, head, None, None, 0) for k in range(500)])
    assert len(A.splitters(same, 20)) <= 1  # one text cannot be parted


def test_copies_travel_once(spark):
    held = A.Combiner([b"m"], 4)
    for k in range(5000):
        held.add(5000 - k if k % 2 else k + 10_000, "s", "a text of many copies")
    sent = list(held.flush())
    assert sum(r[4] is not None for r in sent) == 1 and sum(r[3] for r in sent) == 5000
    held.add(20_000, "s", "a text of many copies")  # known after the trie was emptied
    assert [(r[2] & A.DUPLICATE, r[4]) for r in held.flush()] == [(A.DUPLICATE, None)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab\0é", max_size=8), st.integers(0, 9)), max_size=40))
def test_trie_holds_minima(rows):
    trie, low = A.Trie(), {}
    nodes = [trie.insert(t.encode(), k) for t, k in rows]
    for t, k in rows:
        low[t] = min(k, low.get(t, k))
    assert [n.low for n in (trie.insert(t.encode(), None) for t, _ in rows)] == [low[t] for t, _ in rows]
    assert len({id(trie.insert(t.encode(), None)) for t in low}) == len(low) and len(nodes) == len(rows)
