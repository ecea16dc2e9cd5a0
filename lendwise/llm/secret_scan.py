"""Secret scan with a trigram inverted index, in DataFrame functions only.

Each rule's regex is turned into a Boolean trigram query: alternatives of trigram sets, one of which every match must
contain. The inverted index holds (trigram, text) postings for the trigrams the rules ask for; intersecting a text's
postings with each alternative gives the candidates of a rule, and only those are verified with the regex. A rule
without mandatory trigrams is scanned over every text.

Spans are code point offsets, end exclusive, leftmost and non-overlapping per kind; matches that fail the rule's
``accept`` pattern are dropped after matching. Besides the base rules the method has rules for secrets with a form of
their own (private key headers, tokens of code hosts and chat services, signed web tokens); their spans are added to the
base spans, which they never change.

Cases: a null text is empty and has no spans; a text of any length is scanned whole; spans of several kinds at one place
are sorted by kind as listed, and overlapping ones are masked by one mask; repeated rows each get their row; an empty
table gives an empty result; only doc_id and text are read, so other columns may have any name, dots included.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import materialize, text_key

if sys.version_info >= (3, 11):
    from re import _constants as sre
    from re import _parser as sre_parser
else:
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """``regex`` finds, ``accept`` (matched against the whole match) keeps; ``present`` is an optional cheaper regex
    that every text with an accepted match contains, used as the full scan of a rule without trigrams."""

    kind: str
    regex: str
    accept: str
    present: str


# The rules, in the order in which kinds sort.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$""",
         r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{20,}$", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", r"^.{24,}$", r"[0-9a-f]{24}"),
)
# Forms of further secrets, after the base kinds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"^.", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", r"^.{40,}$", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", r"^.{15,}$", r"xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"^.{40,}$", r"eyJ[A-Za-z0-9_-]+\.eyJ"),
)
ALTERNATIVES = 64  # strings held while a literal run is expanded; beyond it the run is cut, which only weakens the query


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-cased trigrams, one of which is wholly in every text that matches; None if the regex has
    no mandatory trigram (the rule must then scan fully)."""
    clauses: list[frozenset[str]] = [frozenset()]
    run = {""}

    def grams(s: str) -> frozenset[str]:
        return frozenset(s[i:i + 3] for i in range(len(s) - 2))

    def strings(items) -> set[str] | None:
        """All strings a small sub-expression can match, or None."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                part = {chr(arg).lower()}
            elif op is sre.SUBPATTERN:
                part = strings(arg[-1])
            elif op is sre.BRANCH:
                parts = [strings(b) for b in arg[1]]
                part = None if None in parts else set().union(*parts)
            elif op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 1:
                part = strings(arg[2])
                part = None if part is None else part | ({""} if arg[0] == 0 else set())
            else:
                part = None
            if part is None or len(out) * len(part) > ALTERNATIVES:
                return None
            out = {a + b for a in out for b in part}
        return out

    def close() -> None:
        nonlocal clauses, run
        found = [grams(s) for s in run]
        if all(found) and len(clauses) * len(found) <= ALTERNATIVES:
            clauses = list({a | b for a in clauses for b in found})
        run = {""}

    def walk(items) -> None:
        nonlocal run
        for item in items:
            part = strings([item])
            if part is None and item[0] is sre.SUBPATTERN:
                walk(item[1][-1])
            elif part is None:
                close()
            elif len(run) * len(part) > ALTERNATIVES:
                close()
                run = part
            else:
                run = {a + b for a in run for b in part}

    walk(sre_parser.parse(regex))
    close()
    return None if any(not c for c in clauses) else clauses


def trigram_postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index of the given trigrams: (trigram, text key), one row per trigram that a text contains in either
    letter case."""
    docs = documents.select(text_key(F.col("text")).alias("__t"),
                            F.lower(F.coalesce("text", F.lit(""))).alias("__x"))
    found = F.array(*[F.when(F.contains("__x", F.lit(t)), F.lit(t)) for t in trigrams])
    # explode_outer keeps the optimizer from evaluating the array a second time in a pushed-down size filter
    return docs.select("__t", F.explode_outer(found).alias("trigram")).filter("trigram IS NOT NULL")


def candidates(postings: DataFrame, rules: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Text keys whose intersected postings satisfy a rule's query: (text key, kinds)."""
    got = postings.groupBy("__t").agg(F.collect_set("trigram").alias("__g"))

    def has(clause: frozenset[str]) -> Column:
        need = F.array(*[F.lit(t) for t in sorted(clause)])
        return F.size(F.array_intersect(F.col("__g"), need)) == len(clause)

    kinds = []
    for kind, clauses in rules.items():
        ok = has(clauses[0])
        for c in clauses[1:]:
            ok = ok | has(c)
        kinds.append(F.when(ok, F.lit(kind)))
    out = got.select("__t", F.filter(F.array(*kinds), lambda k: k.isNotNull()).alias("__kinds"))
    return out.filter(F.size("__kinds") > 0)


ESC, KEPT, OPEN, CLOSE = "\x01", "\x02", "\x03", "\x04"


def _pieces(text: Column, regex: str) -> Column:
    """The text as an array gap, match, gap, match, ..., gap: matches are marked in one pass and the text is cut at
    the marks. The mark character is escaped in the text first, so any text is safe."""
    safe = F.replace(text, F.lit(ESC), F.lit(ESC + KEPT))
    marked = F.regexp_replace(safe, regex, f"{ESC}{OPEN}$0{ESC}{CLOSE}")
    return F.split(marked, f"{ESC}[{OPEN}{CLOSE}]")


def _spans(pieces: Column, kind_no: int, accept: str) -> Column:
    """Accepted matches as (start, kind number, end) structs."""
    long0 = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def step(acc, x):
        end = (acc["at"] + x["n"]).cast("long")
        one = F.array(F.struct(acc["at"].alias("start"), F.lit(kind_no).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def piece(p, i):
        plain = F.replace(p, F.lit(ESC + KEPT), F.lit(ESC))
        return F.struct(F.char_length(plain).cast("long").alias("n"), ((i % 2 == 1) & plain.rlike(accept)).alias("ok"))

    return F.aggregate(F.transform(pieces, piece), F.struct(long0.alias("at"), empty.alias("out")), step,
                       lambda acc: acc["out"])


def find_spans(documents: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text key, the ``carry`` columns, and ``__spans``: sorted (start, kind number, end) of each document."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    docs = documents.select("doc_id", text_key(F.col("text")).alias("__t"),
                            F.coalesce("text", F.lit("")).alias("__x"), *[F.col(f"`{c}`") for c in carry])
    if queries:
        grams = sorted(set().union(*[c for q in queries.values() for c in q]))
        postings = materialize(trigram_postings(documents, grams), "trigram-postings")
        docs = docs.join(materialize(candidates(postings, queries), "secret-candidates"), "__t", "left")
    else:
        docs = docs.withColumn("__kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    parts = []
    for no, r in enumerate(rules):
        look = F.col("__x").rlike(r.present)
        if r.kind in queries:
            look = F.coalesce(F.array_contains("__kinds", r.kind), F.lit(False)) & look
        parts.append(F.when(look, _spans(_pieces(F.col("__x"), r.regex), no, r.accept)).otherwise(none))
    return docs.select("doc_id", "__t", *[F.col(f"`{c}`") for c in carry], "__x", F.sort_array(F.concat(*parts)).alias("__spans"))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """One row per document row: doc_id, n_<kind> per base rule, base_sha256 of the base spans, spans of all rules."""
    names = F.array(*[F.lit(r.kind) for r in rules + added])

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    found = find_spans(documents, rules + added).withColumn("spans", told("__spans")).withColumn(
        "base", told(F.filter("__spans", lambda s: s["kind"] < len(rules))))

    def count(no: int) -> Column:
        return F.size(F.filter("__spans", lambda s: s["kind"] == no)).cast("long")

    counts = [count(no).alias(f"n_{r.kind}") for no, r in enumerate(rules)]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redact(documents: DataFrame, mask: str = "[REDACTED]", rules: tuple[Rule, ...] = RULES + ADDED) -> DataFrame:
    """The documents, same columns, with every span's characters replaced by ``mask`` (overlapping spans of several
    kinds by one mask) and n_chars, if present, recounted. Documents without spans keep their row unchanged."""
    others = tuple(c for c in documents.columns if c not in ("doc_id", "text"))
    plain = documents.select("doc_id", "text", *[F.col(f"`{c}`") for c in others])
    docs = plain.withColumn("__text", F.col("text"))
    found = find_spans(docs, rules, carry=("__text", *others))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(F.col("__x"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.substr(F.col("__x"), (acc["at"] + 1).cast("int")))

    hit = F.size("__spans") > 0
    text = F.when(hit, F.aggregate("__spans", zero, step, finish)).otherwise(F.col("__text"))
    found = found.withColumn("__new", text)
    out = {"doc_id": F.col("doc_id"), "text": F.col("__new")}
    out |= {c: F.col(f"`{c}`") for c in others}
    if "n_chars" in others:
        kind = documents.schema["n_chars"].dataType
        out["n_chars"] = F.when(hit, F.char_length("__new").cast(kind)).otherwise(F.col("n_chars"))
    return found.select(*[out[c].alias(c) for c in documents.columns])
