"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is dealt by conversation and sorted by sequence number; each message is folded from its last opening,
edit or regeneration and the deltas streamed after it; final messages are rendered with a loss mask and can be read
back from the rendered text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thermocline.llm.common import NO_ID, partitions, public_id

OPENERS = ("message", "edit", "regenerate")
#: Code points of a streamed delta.
DELTA = 256
_OPEN, _CLOSE = "<turn ", "</turn>"


def escape(text: Column) -> Column:
    """No `<` and no `>` is left, so no text can hold a mark of the template."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Undo `escape`: cut at doubled backslashes, left to right, so that what stays between is plain."""
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(
        F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))), "\\")


def log_of_turns(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """The event log that would have led to finished turns (conv_id, turn, role, text).

    Assistant turns are opened empty and streamed in deltas of at most `delta` code points; others come at once.
    Rows are numbered by turn, then role and text, so repeated rows stay separate messages.
    """
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), "turn",
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition(partitions(turns.sparkSession), "conv_id").withColumn(
        "message", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), 0),
                         lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("text")))

    def opening(text):
        return F.array(F.struct(F.lit("message").alias("kind"), text.alias("text")))

    events = F.when(F.col("role") == "assistant", F.concat(opening(F.lit("")), deltas)).otherwise(opening(F.col("text")))
    return (rows.select("conv_id", "message", "role", F.posexplode(events).alias("step", "event"))
            .select("conv_id", F.struct("message", "step").alias("seq"), "message", "event.kind", "role", "event.text"))


def fold(log: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, message, role, text.

    Events have conv_id, seq (any ordered type), message (orders a conversation's messages), kind, role and text.
    `message` and `edit` replace the message's text so far by theirs, `regenerate` starts it anew (from its text, if it
    has one), `delta` appends. The role is the last one given. Equal seq: by kind, then text. Null text counts as empty;
    an unknown or null kind is read as a delta.
    """
    log = log.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), "role",
                     F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("seq"), F.col("kind").isin(*OPENERS), F.col("kind"), F.col("text")]
    newest = W.partitionBy("conv_id", "message").orderBy(*[c.desc() for c in order])
    opener = F.col("kind").isin(*OPENERS).cast("int")
    later = F.coalesce(F.sum(opener).over(newest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    role = F.first("role", ignorenulls=True).over(newest.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    live = log.withColumn("later", later).withColumn("final_role", role).where("later = 0")
    pieces = F.sort_array(F.collect_list(F.struct("seq", F.col("kind").isin("delta").alias("appended"), "kind", "text")))
    return (live.groupBy("conv_id", "message", F.coalesce("final_role", F.lit("")).alias("role")).agg(pieces.alias("p"))
            .select("conv_id", "message", "role", F.array_join("p.text", "").alias("text")))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """A row for each conversation: conv_id, formatted and loss_spans (start, length; code points of the formatted text).

    Start offsets are running sums over the conversation's messages, so nothing is measured twice.
    """
    body, opening = escape(F.col("text")), F.concat(F.lit(_OPEN), escape(F.col("role")), F.lit(">"))
    turns = messages.select("conv_id", "message", "role", opening.alias("opening"), body.alias("body"))
    turns = turns.withColumn("width", (F.length("opening") + F.length("body") + len(_CLOSE)).cast("long"))
    before = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("width").over(before), F.lit(0)) + F.length("opening"))
    rows = F.sort_array(F.collect_list(F.struct("message", "start", "role", F.concat("opening", "body", F.lit(_CLOSE)).alias("turn"),
                                                F.length("body").cast("long").alias("length"))))
    return turns.groupBy("conv_id").agg(rows.alias("t")).select(
        "conv_id", F.array_join("t.turn", "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == trained_role),
                    lambda x: F.struct(x["start"], x["length"])).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) read back from a rendered conversation."""
    turns = F.filter(F.split(formatted, _CLOSE, -1), lambda x: x != "")

    def turn(x):
        end = F.instr(x, ">")
        return F.struct(unescape(F.substring(x, F.lit(len(_OPEN) + 1), end - len(_OPEN) - 1)).alias("role"),
                        unescape(F.substring(x, end + 1, F.length(x))).alias("text"))

    return F.transform(turns, turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_chats(log: DataFrame) -> DataFrame:
    """Conversations of an event log, folded and rendered: conv_id, formatted, loss_spans.

    Everything is dealt once, by conversation, and spills in sorts and windows; only the final text of a conversation is
    one value, as its result must be. Null conv_id: one conversation of its own. Empty texts are turns without text. An
    empty log gives no rows. Columns beside the named ones are ignored.
    """
    out = render(fold(log.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)))))
    return out.withColumn("conv_id", public_id("conv_id"))
