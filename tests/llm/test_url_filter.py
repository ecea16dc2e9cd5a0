import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import url_filter as U

PAGES = "page_id long, url string, html string"
LINK = '<a HREF = "{}">x</a>'
ROWS = [
    (1, None, None), (2, "no scheme", "<a href='http://x.com/'>"), (3, "http://", ""), (4, "http://A.Example.NET", ""),
    (5, "http://a.example.net/en/1?x#y", LINK.format("https://Linked.com/a") + LINK.format("/relative")),
    (6, "http://a.example.net/EN/1", LINK.format("//second.com")), (7, "x://example.com/de/", LINK.format("http://third.com")),
    (8, "http://notexample.com/de/", ""), (9, "http://w.org/fr/", LINK.format("http://linked.com/q")),
    (10, "http://linked.com/", LINK.format("http://far.com/") * 3 + LINK.format("http://second.com")),
    (11, "http://far.com/1", LINK.format("http://example.com/z")), (12, "http://evil.com/", LINK.format("http://example.com/")),
    (12, "http://evil.com/", LINK.format("http://example.com/")), (None, "http://w.org/fr?q", None),
    (13, "http://second.com#http://b", "x" * 200_000)]


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host.translate(H.LOWER), path


def rule_of(host, path):
    fit = [r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def ranks(seeds, edges):
    """PageRank of a dict graph by a dense solve: rank = (1 - s) base + s P rank."""
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    hosts = sorted(set(seeds) | {h for e in edges for h in e})
    at = {h: i for i, h in enumerate(hosts)}
    p, base = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    for h, others in out.items():
        for other in others:
            p[at[other], at[h]] = 1 / len(others)
    for h in seeds:
        base[at[h]] = 1 / len(seeds)
    solved = np.linalg.solve(np.eye(len(hosts)) - U.STAY * p, (1 - U.STAY) * base) if hosts else base
    return dict(zip(hosts, solved))


def judged(rows):
    """Per row (page_id, host, path, rule, verdict, trust, distrust) from the dense solution."""
    edges, lean = set(), defaultdict(int)
    for _, url, html in rows:
        host, path = host_path(url)
        for m in re.finditer(r"""(?i)href\s*=\s*["'](?:https?:)?//([^/?#"'>\s]*)""", html or ""):
            other = m[1].translate(H.LOWER)
            if host and other and other != host:
                edges.add((host, other))
        if r := rule_of(host, path):
            lean[host] += 1 if r[0] == "allow" else -1
    good, bad = [h for h, n in lean.items() if n > 0], [h for h, n in lean.items() if n < 0]
    trust, distrust = ranks(good, edges), ranks(bad, {(b, a) for a, b in edges})
    want = []
    for page, url, _ in rows:
        host, path = host_path(url)
        r = rule_of(host, path)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        want.append((page, host, path, r and r[1] + r[2], r[0] if r else "block" if d > t * (1 + U.EQUAL) else "allow", t, d))
    return sorted(want, key=lambda r: repr(r[:5]))


def assert_judged(df, rows):
    got = sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()),
                 key=lambda r: repr(r[:5]))
    want = judged(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 2 * U.TOLERANCE and abs(g[6] - w[6]) < 2 * U.TOLERANCE
    return want


def test_equals_a_dense_solution(spark):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'x' AS host", "1 AS trust", "'y' AS rule", "2 AS src", "3 AS `a.b`")
    want = assert_judged(U.judge(pages), ROWS)
    assert any(r[3] is None and r[4] == "block" for r in want) and any(r[3] is None and r[5] > 0 for r in want)


def test_a_long_chain_and_a_hub(spark):
    """A chain of 40 hosts that ends at a blocked one, a cycle, and a hub of 1,000 links, ten of them blocked."""
    rows = [(k, f"http://c{k}.com/", LINK.format(f"http://c{k + 1}.com/" if k < 39 else "http://example.com/de/")) for k in range(40)]
    rows += [(100, "http://example.com/de/", None), (101, "http://x1.com/", LINK.format("http://x2.com")),
             (102, "http://x2.com/", LINK.format("http://x1.com"))]
    rows += [(200, "http://hub.com/", "".join(LINK.format(f"http://h{k}.{'net' if k < 10 else 'com'}/") for k in range(1000))),
             (201, "http://in.com/", LINK.format("http://hub.com/"))] + [(300 + k, f"http://h{k}.net/", "") for k in range(10)]
    rows += [(400, "http://a.org/fr/", LINK.format("http://x1.com/"))]
    want = assert_judged(U.judge(spark.createDataFrame(rows, PAGES)), rows)
    verdict = {r[0]: r[4] for r in want}
    assert all(verdict[k] == "block" for k in range(40)) and verdict[200] == verdict[201] == "block"


def test_ties_and_balanced_hosts(spark):
    """As many allowed as blocked urls make no seed; a host without either rank, or with equal ones, is allowed."""
    rows = [(1, "http://example.com/de/", ""), (2, "http://w.org/fr/", LINK.format("http://m.com")),
            (3, "http://m.com/", LINK.format("http://example.com/de/")), (4, "http://lonely.com/", ""), (5, "http://a.org/fr/", "")]
    rows += [(6, "http://a.org/fr/x", "")]
    want = assert_judged(U.judge(spark.createDataFrame(rows, PAGES)), rows)
    assert {r[0]: r[4] for r in want}[4] == "allow"


def test_oracle_and_empty(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{H.SF}/pages.parquet'")
    want = sorted(map(repr, con.execute(U.ORACLE).fetchall()))
    got = sorted(map(repr, map(tuple, U.verdicts(spark.read.parquet(f"{H.SF}/pages.parquet")).collect())))
    assert got == want
    assert U.judge(spark.createDataFrame([], PAGES)).count() == 0
