"""Rows that every document operator must survive, and brute-force versions of the operators."""

import hashlib
import re
import string
from collections import defaultdict

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"word{i % 997} filler" for i in range(30_000))
TRICKY = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "!!! ... ???", "fr", "a", 11), (4, "one", None, "b", 3),
    (5, "One two THREE", "en", None, 13), (6, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)),
    (None, "a row without an id", "en", "c", 19), (7, "naïve Straße ΑΣ 漢字 🎉🎉 end", "de", "c", -5),
    (8, "tab\tand\nlines\r\n\r\nWARC/1.1\r\nx", "en", "c", 30), (9, "\x01\x02\x03 \x04\x01", "en", "c", 7),
    (10, "same words here in this text", "en", "c", 1), (11, "same words here in this text", "en", "c", 1),
    (12, "Same, words: here in THIS text!", "en", "c", 1),
]
# names that operators use for their own columns
EXTRA = ("score", "rank", "label", "words", "start", "length", "node", "file", "key", "n", "kind", "host", "trigram", "c0")


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in EXTRA}) if extra else df


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows):
    """Per row (doc_id, text): (smallest doc_id of its component, links), by comparing every pair."""
    sets, n = [shingles(t) for _, t in rows], len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(n):
        ids[find(i)].append(rows[i][0])
    low = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(rows[i][0], low[find(i)], links[i]) for i in range(n)]


def contamination(rows, items):
    """Per row: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), by trying every window everywhere."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(item)
    sizes, out = {len(w) for w in windows}, []
    for doc, text in rows:
        w, hit, got = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    got |= {str(x) for x in found if x is not None}
        digest = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(got), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def secrets(text):
    """Sorted (start, kind number, end)."""
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in p.finditer(text or "") if ok(m))


def masked(text, mask="[REDACTED]"):
    out, at = "", 0
    for start, _, end in secrets(text):
        if start >= at:
            out += text[at:start] + mask
        at = max(at, end)
    return out + text[at:] if out else text


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
