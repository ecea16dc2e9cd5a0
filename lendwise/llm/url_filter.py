"""URL filter by link-graph propagation over hosts, in DataFrame functions only.

Rules allow or block a host with its subdomains and a path prefix; the longest fitting rule decides a url. Hosts most
of whose ruled urls are allowed are trusted seeds, hosts most of whose ruled urls are blocked are distrusted seeds.
Personalised PageRank carries trust from trusted seeds along host links, and distrust from distrusted seeds against
them (who links to a blocked host is suspect). A url without a rule is blocked if its host's distrust exceeds its
trust.

A rank is the sum of what arrives over paths of every length: each round passes STAY of what arrived in the round before
on along the links, so what is still under way shrinks by STAY per round. Rounds go on until less than TOLERANCE of the
seeds' rank is under way and no host was reached for the first time since the last look; so a host any number of links
from a seed has a rank, and ranks are exact to TOLERANCE. A graph without links needs no round.

Cases: a null url, or one without ``://``, has empty host and path and fits no rule; a null html has no links; a host with
as many allowed as blocked urls is no seed; trust equal to distrust (to a billionth, as sums of doubles depend on the order
of rows in their last bits) allows; a html of any length is searched whole; repeated pages each get their row and add no
further edges; empty tables give an empty result; only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import ascii_lower, materialize

# Action, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TOLERANCE = 1e-6  # share of the seeds' rank that may still be under way at the end
STAY = 0.85  # share of a host's rank that follows its links
CUT_EVERY = 5  # rounds between written tables, and between looks at what is under way
EQUAL = 1e-9  # ranks this near to each other count as equal


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def longest_first(rules):
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def fits(rule, host: Column, path: Column) -> Column:
    _, rule_host, rule_path = rule
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs of different hosts, from absolute links in the html."""
    parts = F.split(F.coalesce("html", F.lit("")), r"""(?i)href\s*=\s*["']""")
    links = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ascii_lower(
        F.regexp_extract(p, r"""^(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'>\s]*)""", 1)))
    found = pages.select(host_path(F.col("url"))[0].alias("src"), F.explode_outer(F.array_distinct(links)).alias("dst"))
    return found.filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): personalised PageRank of each kind, a total of 1. edges: kind, src, dst; seeds: kind, host."""
    degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    edges = materialize(edges.join(degree, ["kind", "src"]), "host-edges")
    total = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    moving = materialize(seeds.join(F.broadcast(total), "kind").select(  # two rows: trust and distrust
        "kind", "host", (F.lit(1 - STAY) / F.col("n")).alias("rank")), "host-seeds")
    ranks = moving
    if edges.isEmpty():
        return ranks
    while True:
        parts = [ranks]
        for _ in range(CUT_EVERY):
            sent = moving.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.col("rank") * STAY / F.col("degree")).alias("rank"))
            moving = materialize(sent.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "host-moving")
            parts.append(moving)
        reached = parts[1]
        for p in parts[2:]:
            reached = reached.unionAll(p)
        new = reached.select("kind", "host").join(ranks, ["kind", "host"], "left_anti")
        under_way = moving.agg(F.sum("rank")).first()[0] or 0.0
        done = under_way * STAY / (1 - STAY) < tolerance and new.isEmpty()
        ranks = materialize(ranks.unionAll(reached).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "host-ranks")
        if done:
            return ranks


def host_scores(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host, trust, distrust) of every host that the propagation reaches."""
    host, path = host_path(F.col("url"))
    ordered = longest_first(rules)
    verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        verdict = F.when(fits(r, F.col("host"), F.col("path")), F.lit(r[0])).otherwise(verdict)
    ruled = pages.select(host.alias("host"), path.alias("path")).select("host", verdict.alias("v"))
    lean = ruled.filter("v IS NOT NULL").groupBy("host").agg(
        F.sum(F.when(F.col("v") == "allow", 1).otherwise(-1)).alias("lean"))
    seeds = lean.filter("lean <> 0").select(F.when(F.col("lean") > 0, "trust").otherwise("distrust").alias("kind"), "host")
    links = materialize(host_links(pages), "host-links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").unionAll(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    ranks = propagate(both, seeds)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    host, path = host_path(F.col("url"))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(longest_first(rules)):
        ok = fits(r, F.col("host"), F.col("path"))
        rule, action = F.when(ok, F.lit(r[1] + r[2])).otherwise(rule), F.when(ok, F.lit(r[0])).otherwise(action)
    scores = materialize(host_scores(pages, rules), "host-scores")
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.join(scores, "host", "left")
    zero = F.lit(0.0)
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(
        action, F.when(distrust > trust * (1 + EQUAL), "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))


def verdicts(pages: DataFrame) -> DataFrame:
    """The query's columns."""
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_ROUNDS = 120  # of the SQL, which cannot look at what is under way


def _oracle() -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    test = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    whens = [(test.format(h=r[1], p=r[2]), r) for r in longest_first(RULES)]
    rule = " ".join(f"WHEN {w} THEN '{r[1] + r[2]}'" for w, r in whens)
    act = " ".join(f"WHEN {w} THEN '{r[0]}'" for w, r in whens)
    sql = f"""
WITH u AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT *, coalesce({rest}, '') AS rest FROM pages)),
p AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {act} END AS act FROM u),
links AS (SELECT DISTINCT host AS src, dst FROM (SELECT host, {lower.format("d")} AS dst FROM (SELECT host, unnest(
    regexp_extract_all(html, '(?i)href\\s*=\\s*["''](?:https?:)?//([^/?#"''>\\s]*)', 1)) AS d FROM u))
    WHERE host <> '' AND dst <> '' AND host <> dst),
e AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM
    (SELECT 'trust' AS kind, src, dst FROM links UNION ALL SELECT 'distrust', dst, src FROM links)),
lean AS (SELECT host, sum(CASE act WHEN 'allow' THEN 1 ELSE -1 END) AS l FROM p WHERE act IS NOT NULL GROUP BY host),
s AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS rank FROM
    (SELECT CASE WHEN l > 0 THEN 'trust' ELSE 'distrust' END AS kind, host FROM lean WHERE l <> 0)),
r0 AS (SELECT * FROM s)"""
    for k in range(1, ORACLE_ROUNDS + 1):
        sql += f""",
r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (
    SELECT e.kind, dst AS host, rank * {STAY}::DOUBLE / degree AS rank FROM r{k - 1} r JOIN e ON r.kind = e.kind AND host = src
    UNION ALL SELECT kind, host, rank * {1 - STAY}::DOUBLE FROM s) GROUP BY kind, host)"""
    return sql + f""",
sc AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust,
         coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM r{ORACLE_ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {1 + EQUAL}::DOUBLE
       THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN sc USING (host)"""


ORACLE = _oracle()
