"""Chat formatting from an event log, in DataFrame functions only.

A log row is an event of a conversation: (conv_id, seq, turn, kind, role, text). The log is partitioned by conversation
and sorted by sequence; the fold of its events is the final conversation:

* ``open`` starts message ``turn`` with a role; its text begins the message (usually null or empty);
* ``delta`` appends its text to the message (streamed output);
* ``edit`` replaces the message's text; later deltas append to the edited text;
* ``regenerate`` restarts the message with its text (usually null) and drops every later message opened so far; the deltas
  that follow are its new text, and later turns can be opened again.

The fold needs no loop: an event counts unless a later ``regenerate`` of its conversation names a smaller turn, or a
later ``edit`` or ``regenerate`` names its own. The first rule is a running minimum and the second a running maximum
over the log from its end. One shuffle by conversation serves both windows, the fold per message and the rendering.

Rendering: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>`` per message. Control strings (the template's own and
those of other chat formats) inside roles and texts get a backslash after their first character, and those that hold
backslashes there already get one more, so that reading takes one away and nothing is ambiguous. The loss mask is a list
of [start, end) byte spans of the formatted text's UTF-8, one per non-empty assistant text.

Cases: a null text is empty, a null role is an empty role; a null kind or one of another name is no event; a message
without a live ``open`` takes the role of its first event that has one; null turns come before all others and are one
message per conversation, a null conv_id is a conversation of its own; events of equal seq are ordered by kind (open,
regenerate, edit, delta), then text; conversations all of whose messages are dropped vanish; an empty log gives an empty
result. A conversation is one output value, so one task holds a conversation's text, however long it is: a single
conversation over 2 GB cannot be formatted. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwise.llm.common import materialize

# The template's marks and the control strings that are escaped inside texts.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"/?s>|/?INST\]|\|[a-z_]+\|>"  # behind a first character < or [
ESCAPE = rf"([<\[])(\\*)({CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"
ORDER = ("open", "regenerate", "edit", "delta")
EVENTS = ("conv_id", "seq", "turn", "kind", "role", "text")


def escape(c: Column) -> Column:
    """No control string is left in the result; ``unescape`` gives the text back."""
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text."""
    rank = F.lit(None).cast("int")
    for k, name in enumerate(ORDER):
        rank = F.when(F.col("kind") == name, k).otherwise(rank)
    log = events.select(*EVENTS).withColumn("at", F.struct("seq", rank.alias("rank"), "text")).filter(
        F.col("at.rank").isNotNull())
    # a null turn is before every other one: turns are compared as (not null, turn)
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    log = log.withColumn("place", place)
    later = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    again = Window.partitionBy("conv_id", "turn").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("place"))).over(later))
    log = log.filter(F.col("cut").isNull() | (F.col("place") <= F.col("cut")))
    log = log.withColumn("reset", F.max(F.col("kind").isin("edit", "regenerate")).over(again))
    # what a later reset replaces still opens the message, without text
    log = log.withColumn("said", F.when(F.coalesce("reset", F.lit(False)), F.lit("")).otherwise(
        F.coalesce("text", F.lit(""))))
    said = F.sort_array(F.collect_list(F.struct("at", "said")))
    role = F.coalesce(F.max_by(F.when(F.col("kind") == "open", F.col("role")),
                               F.when((F.col("kind") == "open") & F.col("role").isNotNull(), F.col("at"))),
                      F.min_by("role", F.when(F.col("role").isNotNull(), F.col("at"))))
    return log.groupBy("conv_id", "turn").agg(
        role.alias("role"), F.array_join(F.transform(said, lambda x: x["said"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: one row per conversation of messages (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape(role), F.lit(SEP))
    parts = messages.select("conv_id", "turn", (role == "assistant").alias("learned"), head.alias("head"),
                            escape(text).alias("body"))
    size = F.octet_length("head") + F.octet_length("body") + len(END)
    so_far = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = (F.sum(size.cast("long")).over(so_far) - len(END)).alias("end")
    parts = parts.select("conv_id", "turn", "learned", "head", "body", end)
    span = F.when(F.col("learned") & (F.length("body") > 0), F.struct(
        (F.col("end") - F.octet_length("body")).alias("start"), F.col("end").alias("end")))
    whole = F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(END)).alias("piece"))))
    return parts.groupBy("conv_id").agg(
        F.array_join(F.transform(whole, lambda x: x["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss"))


def chat_format(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss of every conversation of an event log."""
    return render(fold(events))


def turns(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: conv_id, formatted, messages (array of role, text), learned (array of the
    texts under the loss mask)."""
    pieces = F.split("formatted", r"<\|im_end\|>")
    read = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(p, r"<\|im_sep\|>", 2))
    message = F.transform(read, lambda p: F.struct(
        unescape(F.substring(F.element_at(p, 1), len(START) + 1, F.length(F.element_at(p, 1)))).alias("role"),
        unescape(F.element_at(p, 2)).alias("text")))
    # the bytes are made once, as the only element of an array, and not for every span
    cut = F.transform(F.array(F.col("formatted").cast("binary")), lambda b: F.transform(
        "loss", lambda s: unescape(F.substr(b, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
                                   .cast("string"))))
    return formatted.select("conv_id", "formatted", message.alias("messages"), F.element_at(cut, 1).alias("learned"))


def message_events(conversations: DataFrame) -> DataFrame:
    """The event log of complete messages, rows (conv_id, turn, role, text): each row opens a message and streams its
    text as one delta. Rows of one turn are messages of their own, ordered by role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"),
                                                  F.asc_nulls_first("text"))
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("m"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(kind).alias("kind"))
                                for k, kind in enumerate(("open", "delta"))])).alias("e")
    rows = rows.select("*", kinds)
    return rows.select("conv_id", (F.col("m") * 2 + F.col("e.k")).alias("seq"), F.col("m").alias("turn"),
                       F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == "open", F.col("role")).alias("role"),
                       F.when(F.col("e.kind") == "delta", F.col("text")).alias("text"))


PROBE = -7, "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations (conv_id, turn, role, text) and one whose texts are control strings: a user, an assistant."""
    spark = conversations.sparkSession
    conv, text = PROBE
    kind = {c: conversations.schema[c].dataType for c in ("conv_id", "turn", "role", "text")}
    probe = spark.range(2).select(
        F.lit(conv).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").cast(kind["role"]).alias("role"),
        F.lit(text).cast(kind["text"]).alias("text"))
    return conversations.select(*kind).unionByName(probe)


def digests(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation, from reading it back: number and digest of its turns, length and digest of the text
    under the loss mask, length of the formatted text."""
    read = turns(formatted)
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("messages").cast("long").alias("n_turns"), told.alias("told"),
                       F.array_join("learned", "").alias("learned"), F.length("formatted").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("long").alias("formatted_chars"))


def round_trip(conversations: DataFrame) -> DataFrame:
    """All conversations and the probe as an event log, folded, formatted and written; the digests of what is read
    back."""
    return digests(materialize(chat_format(message_events(with_probe(conversations))), "formatted"))


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|\|[a-z_]+\|>)', '\1\\\2\3', 'g')"
ORACLE = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS body FROM conversations
  UNION ALL SELECT {PROBE[0]}, 0, 'user', '{PROBE[1]}' UNION ALL SELECT {PROBE[0]}, 1, 'assistant', '{PROBE[1]}'),
told AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS whole,
         coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE role = 'assistant'), '') AS learned,
         sum(length('{START}{SEP}{END}') + length({_ESC.format('role')}) + length({_ESC.format('body')})) AS chars
  FROM said GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM told
"""
