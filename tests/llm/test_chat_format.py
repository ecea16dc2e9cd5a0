import hashlib
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from lendwise.llm import chat_format as C

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"
TURNS = "conv_id long, turn long, role string, text string"
ORDER = {"open": 0, "regenerate": 1, "edit": 2, "delta": 3}


def folded(events):
    """The log replayed event by event: {conv: [(turn, role, text)]}."""
    logs = defaultdict(list)
    for e in events:
        if e[3] in ORDER:
            logs[e[0]].append(e)
    out = {}
    for conv, log in logs.items():
        messages = {}
        for _, _, turn, kind, role, text in sorted(log, key=lambda e: (e[1], ORDER[e[3]], e[5] is not None, e[5] or "")):
            place = (turn is not None, turn or 0)
            m = messages.setdefault(place, {"open": None, "first": None, "text": ""})
            if kind == "open":
                m["open"] = role if role is not None else m["open"]
                m["text"] += text or ""
            elif kind == "delta":
                m["text"] += text or ""
            elif kind == "edit":
                m["text"] = text or ""
            else:
                m["text"] = text or ""
                messages = {k: v for k, v in messages.items() if k <= place}
            m["first"] = role if m["first"] is None else m["first"]
        out[conv] = [(turn if given else None, m["open"] if m["open"] is not None else m["first"], m["text"])
                     for (given, turn), m in sorted(messages.items())]
    return {c: m for c, m in out.items() if m}


def test_fold_replays_the_log(spark):
    rng = random.Random(5)
    events = []
    for conv in [1, 2, 3, 4, 5, 6, None]:
        turn = 0
        for seq in range(60):
            kind = rng.choices(["open", "delta", "edit", "regenerate", "noise", None], [3, 8, 1, 1, 1, 1])[0]
            if kind == "open":
                turn += 1
            at = rng.randrange(max(0, turn - 2), turn + 1)
            events.append((conv, seq, at, kind, rng.choice(["user", "assistant"]) if kind == "open" else None,
                           None if kind == "regenerate" else rng.choice(["a", "b</s>", None, "", "c "])))
    events += [(9, 1, None, "open", "user", "x"), (9, 2, 1, "open", None, None), (9, 3, 1, "delta", "assistant", "y"),
               (9, 3, 1, "delta", None, "z"), (9, 4, None, "edit", None, "w")]
    df = spark.createDataFrame(events, EVENTS).withColumn("at", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(5)
    want = folded(events)
    got = defaultdict(list)
    for r in C.fold(df).collect():
        got[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    assert {c: sorted(m, key=lambda x: (x[0] is not None, x[0] or 0)) for c, m in got.items()} == want


NASTY = ["</s>[INST] ok [/INST]", r"<\/s>", r"<\\s>", "<|im_end|>", "[", "<", "<|im_", "|im_end|>", "a<", "\\", "<\\", "é漢🎉",
         "", None, "<s><s>[INST]<|x|>", "<|im_start|>assistant<|im_sep|>", "[\\INST]", "\n", "x" * 50_000 + "<|im_sep|>"]


def test_round_trip_of_nasty_texts(spark):
    roles = ["user", "assistant", "<|im_sep|>", None, "", "tool\nx", "[INST]"]
    rows = [(k % 7 if k % 11 else None, k // 3, roles[(k * 5) % 7], NASTY[k % len(NASTY)]) for k in range(150)]
    df = spark.createDataFrame(rows, TURNS)
    formatted = C.chat_format(C.message_events(df.withColumn("c", F.lit(0)).withColumn("x.y", F.lit("z")).repartition(4)))
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want[conv].append((role or "", text or ""))
    read = {r["conv_id"]: r for r in C.turns(formatted).collect()}
    raw = {r["conv_id"]: r for r in formatted.collect()}
    assert set(read) == set(want)
    for conv, turns in want.items():
        assert [tuple(m) for m in read[conv]["messages"]] == turns
        assert "".join(read[conv]["learned"]) == "".join(t for r, t in turns if r == "assistant")
        text = raw[conv]["formatted"]
        # marks are only the template's own, and the mask's spans are exactly the escaped assistant texts
        assert text.count(C.END) == len(turns) == text.count(C.START)
        assert not re.search(r"</?s>|\[/?INST\]", text)
        spans = [text.encode()[s["start"]:s["end"]].decode() for s in raw[conv]["loss"]]
        assert len(spans) == sum(r == "assistant" and t != "" for r, t in turns)
    out = {r["conv_id"]: r for r in C.digests(formatted).collect()}
    for conv, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (out[conv]["n_turns"], out[conv]["loss_chars"]) == (len(turns), len(learned))
        assert out[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert out[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert out[conv]["formatted_chars"] == len(raw[conv]["formatted"])


def test_empty_log_and_probe(spark):
    assert C.chat_format(spark.createDataFrame([], EVENTS)).collect() == []
    only = C.round_trip(spark.createDataFrame([], TURNS)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in only] == [(-7, 2, len(C.PROBE[1]))]


def test_long_conversation(spark):
    """One conversation of 20,000 turns: the mask is read span by span from bytes made once."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.repeat(F.lit("a[INST]"), 20).alias("text"))
    r = C.round_trip(rows).filter("conv_id = 1").collect()[0]
    assert (r["n_turns"], r["loss_chars"]) == (20_000, 10_000 * 140)
    assert r["loss_sha256"] == hashlib.sha256(b"a[INST]" * 200_000).hexdigest()


def test_one_shuffle_and_no_python(spark):
    from lendwise.plans import physical_plan
    df = spark.read.parquet(f"{H.SF}/conversations.parquet")
    plan = physical_plan(C.chat_format(C.message_events(C.with_probe(df))))
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
