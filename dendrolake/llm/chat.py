"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log row is an event (conv_id, seq, kind, msg_id, role, text): `delta` appends to its message and
opens it if unseen, `edit` replaces the text so far, `regenerate` empties the message and abandons
every message opened since, `delete` removes the message. The log is partitioned by conversation once;
windows in sequence order find each message's last reset and the abandoned branches, what is left is
concatenated, and the messages are rendered in order of their first event.

Template: `<s>[TAG]text[/TAG]</s>` for each message, TAG being SYS, INST or OUT for system, user and
assistant, and `ROLE:` with the role's UTF-8 bytes in hexadecimal for any other role. A control string
inside a text gets one more backslash after its first character, so unescaping takes one away.

Defined results: null text and null role are empty strings; a null conv_id is a conversation of its
own; a null seq comes first; ties in seq go by kind, msg_id, role, text; repeated rows are separate
events; an empty log gives no conversations. A conversation is one row of the result, so its own length
bounds what a task holds, and very long texts are part of it. Only the named columns are read, so other columns may
have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's tags and the tail of every control string.
TAGS = {"system": "SYS", "user": "INST", "assistant": "OUT"}
TAIL = r"(/?s>|/?(?:SYS|INST|OUT|ROLE:[0-9A-F]*)\])"
ESCAPE = r"([<\[])(\\*)" + TAIL
UNESCAPE = r"([<\[])\\(\\*)" + TAIL
TURN = r"(?s)<s>\[(SYS|INST|OUT|ROLE:[0-9A-F]*)\](.*?)\[/\1\]</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def tag_of(role: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, tag in TAGS.items():
        known = F.when(role == name, F.lit(tag)).otherwise(known)
    return F.coalesce(known, F.concat(F.lit("ROLE:"), F.hex(F.encode(role, "UTF-8"))))


def role_of(tag: Column) -> Column:
    known = F.decode(F.unhex(F.substring_index(tag, "ROLE:", -1)), "UTF-8")
    for name, short in TAGS.items():
        known = F.when(tag == short, F.lit(name)).otherwise(known)
    return known


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold an event log into final messages: conv_id, pos, role, text, one row per message that stays."""
    log = events.select(
        "conv_id", F.col("seq").cast("long").alias("seq"), "kind", "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).repartition("conv_id")
    in_order = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "kind", "msg_id", "role", "text"))
    of_message = Window.partitionBy("conv_id", "msg_id")
    resets = F.col("kind").isin("edit", "regenerate", "delete")
    later = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        log.withColumn("at", in_order)
        .withColumn("opened", F.min("at").over(of_message))
        .withColumn("reset", F.coalesce(F.max(F.when(resets, F.col("at"))).over(of_message), F.lit(0)))
        .withColumn("gone", F.max(F.when(F.col("kind") == "delete", F.col("at"))).over(of_message).isNotNull())
        .withColumn("cut_from", F.min(F.when(F.col("kind") == "regenerate", F.col("opened"))).over(later))
        .withColumn("abandoned", F.max((F.col("at") == F.col("opened")) & F.coalesce(F.col("cut_from") < F.col("at"), F.lit(False))).over(of_message))
        .where(~F.col("gone") & ~F.col("abandoned"))
    )
    piece = F.when((F.col("at") >= F.col("reset")) & F.col("kind").isin("delta", "edit"), F.struct("at", "text"))
    return (
        kept.groupBy("conv_id", "msg_id")
        .agg(F.first("opened").alias("pos"), F.min_by("role", "at").alias("role"), F.array_sort(F.collect_list(piece)).alias("pieces"))
        .select("conv_id", "pos", "role", F.array_join("pieces.text", "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length, in characters, of each
    assistant text under the loss mask)."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    tag, body = F.col("tag"), F.col("body")
    parts = (
        messages.withColumn("tag", tag_of(F.col("role")))
        .withColumn("body", escape(F.col("text")))
        .withColumn("turn", F.concat(F.lit("<s>["), tag, F.lit("]"), body, F.lit("[/"), tag, F.lit("]</s>")))
        .withColumn("start", F.coalesce(F.sum(F.length("turn")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length(tag) + 5)
        .withColumn("span", F.when(F.col("role") == "assistant", F.struct("start", F.length(body).alias("length"))))
    )
    return parts.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "turn"))), lambda x: x.turn), "").alias("formatted"),
        F.array_sort(F.collect_list("span")).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse rendered conversations: adds turns (role and text, unescaped) and loss_texts."""
    found = F.arrays_zip(
        F.regexp_extract_all("formatted", F.lit(TURN), 1).alias("tag"), F.regexp_extract_all("formatted", F.lit(TURN), 2).alias("body")
    )
    turns = F.transform(found, lambda x: F.struct(role_of(x.tag).alias("role"), unescape(x.body).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", masked)


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as an event log: each row is one message of a single delta."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return conversations.select("conv_id", nth.cast("long").alias("seq"), F.lit("delta").alias("kind"), nth.alias("msg_id"), "role", "text")


def digests(conversations: DataFrame) -> DataFrame:
    """The result contract, read back from the rendered output."""
    back = read_back(render(reconstruct(turn_events(conversations))))
    newline = F.lit("\n")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, newline, t.text, newline)), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:SYS|INST|OUT|ROLE:[0-9A-F]*)\])', '\1\\\2\3', 'g')) AS body,
    CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 4 WHEN 'assistant' THEN 3 ELSE 5 + 2 * strlen(role) END AS tag
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + 2 * tag + 12)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
