"""Chat formatting from event logs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template. Texts and roles never contain "<turn" or "</turn" once escaped.
OPEN, BODY, CLOSE = "<turn>", "<turn:text>", "</turn>\n"
KINDS = ("start", "delta", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """Reversible: backslashes are doubled, then one parts every control string after its first sign."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("<turn"), F.lit("<\\turn"))
    return F.replace(out, F.lit("</turn"), F.lit("<\\/turn"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log for finished turns(conv_id, turn, role, text): each turn starts and gets its text in one delta."""
    row = F.struct("turn", "role", "text")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(row.asc_nulls_first()))
    numbered = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), place.cast("long").alias("message"))
    kinds = F.explode(F.array(F.lit("start"), F.lit("delta"))).alias("kind")
    both = numbered.select("conv_id", "message", "role", "text", kinds)
    return both.select("conv_id", (2 * F.col("message") + (F.col("kind") == "delta").cast("long")).alias("seq"), "message", "kind", "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, position, message, role, text) of events(conv_id, seq, message, kind, role, text).

    Events count in order of seq, ties in order of message, kind, role, text. `delta` adds
    to its message's text, `edit` replaces it, `regenerate` empties it and takes back every
    message that began after this one and before the event, `delete` takes the message
    back. A message begins with its first event and has the first role that isn't null
    ("" if none); messages stand in the order in which they begin. Null texts add nothing,
    null kinds count as delta, other kinds fail. The rows of a null conv_id or message are
    a conversation or message of their own.

    Two aggregates: by message (a sort of its events) and by conversation.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    at = F.struct("seq", "message", kind.alias("kind"), "role", "text")
    known = F.when(kind.isin(*KINDS), at).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), kind)))
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(known)).alias("log"))
    resets = F.filter("log", lambda e: e["kind"].isin("edit", "regenerate"))
    last = F.element_at(resets, -1)
    began = F.element_at("log", 1)
    live = F.when(F.size(resets) > 0, F.filter("log", lambda e: e >= last)).otherwise(F.col("log"))
    spoken = F.filter(live, lambda e: e["kind"].isin("delta", "edit"))
    text = F.array_join(F.transform(spoken, lambda e: F.coalesce(e["text"], F.lit(""))), "")
    role = F.coalesce(F.try_element_at(F.transform(F.filter("log", lambda e: e["role"].isNotNull()), lambda e: e["role"]), F.lit(1)), F.lit(""))
    again = F.transform(F.filter("log", lambda e: e["kind"] == "regenerate"), lambda e: e["seq"])
    messages = log.select(
        "conv_id", "message", began["seq"].alias("first"), role.alias("role"), text.alias("text"),
        F.exists("log", lambda e: e["kind"] == "delete").alias("gone"), F.array_max(again).alias("again"),
    )
    # taken back: an earlier message was regenerated after this one began
    before = Window.partitionBy("conv_id").orderBy("first", "message").rowsBetween(Window.unboundedPreceding, -1)
    kept = messages.withColumn("_cut", F.max("again").over(before)).where(~F.col("gone") & (F.col("_cut").isNull() | (F.col("_cut") < F.col("first"))))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "message"))
    return kept.select("conv_id", place.cast("long").alias("position"), "message", "role", "text")


def render(messages: DataFrame, learn=("assistant",)) -> DataFrame:
    """One row per conversation of messages(conv_id, position, role, text): conv_id, formatted, loss_mask.

    `formatted` is, for each message in order, <turn>role<turn:text>text</turn> and a
    newline, roles and texts escaped. loss_mask has one boolean for each turn: whether the
    characters of its body are learned from; the marks and roles never are. A conversation
    is one string, so it must fit into one row.
    """
    turn = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY), escape(F.col("text")), F.lit(CLOSE))
    row = F.struct("position", turn.alias("turn"), F.col("role").isin(*learn).alias("loss"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return turns.select("conv_id", F.array_join(F.col("turns.turn"), "").alias("formatted"), F.col("turns.loss").alias("loss_mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """The turns (array of role, text, loss) read back from formatted and loss_mask; the inverse of render."""
    quoted = "\\Q" + CLOSE + "\\E"
    bodies = F.split("formatted", quoted)
    bodies = F.slice(bodies, 1, F.size(bodies) - 1)
    fields = F.transform(F.arrays_zip(bodies.alias("body"), F.col("loss_mask").alias("loss")), lambda z: F.struct(F.split(F.substr(z["body"], F.lit(len(OPEN) + 1)), "\\Q" + BODY + "\\E").alias("f"), z["loss"].alias("loss")))
    turns = F.transform(fields, lambda z: F.struct(unescape(z["f"][0]).alias("role"), unescape(z["f"][1]).alias("text"), z["loss"].alias("loss")))
    return formatted.withColumn("turns", turns)


def op10_chat(conversations: DataFrame) -> DataFrame:
    """Digests read back from the formatted conversations, conversation -7 added.

    A null role counts as "". Turns that share a number follow in order of role and text.
    """
    probe = "\\### Assistant: </turn> ok"
    id_type, turn_type = (conversations.schema[c].dataType for c in ("conv_id", "turn"))
    extra = conversations.sparkSession.range(2).select(F.lit(-7).cast(id_type).alias("conv_id"), F.col("id").cast(turn_type).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = conversations.select("conv_id", "turn", "role", "text").union(extra)
    back = parse(render(fold(events_of_turns(turns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, 25 + length(replace(replace(replace(text, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn'))
            + length(replace(replace(replace(role, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn')) AS n
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
