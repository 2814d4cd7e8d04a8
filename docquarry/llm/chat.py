"""Chat formatting: fold an event log of conversations into messages and render them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: The escape character. Inside texts it is followed by 0 (itself), 1 (a gap that keeps ``<``
#: and ``|`` apart) or, in roles only, 2 (a line feed).
ESC = "␛"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESC), F.lit(ESC + "0")), F.lit("<|"), F.lit(f"<{ESC}1|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESC + "1"), F.lit("")), F.lit(ESC + "0"), F.lit(ESC))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log
    (conv_id, seq, message, kind, role, text).

    ``message`` numbers the messages of a conversation. Kinds: ``delta`` appends its text to
    the message; ``edit`` replaces the message's text; ``regenerate`` restarts the message
    with its text and voids all later messages that were written before it. Any other or
    null kind counts as ``delta``. Null texts are empty; the role is that of the message's
    last surviving event with one. Events are ordered by ``seq``, ties by kind, role and
    text; null ``seq`` comes first. A message whose events are all void does not appear.
    """
    reset = F.coalesce(F.col("kind"), F.lit("delta"))
    seq = F.coalesce(F.col("seq"), F.lit(-(2**63)))
    upto = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("conv_id", "message")
    e = events.select("conv_id", "message", "role", F.coalesce("text", F.lit("")).alias("text"), reset.alias("kind"), seq.alias("seq"))
    e = e.withColumn("__dq_cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(upto))
    e = e.withColumn("__dq_edit", F.max(F.when(F.col("kind") == "edit", F.col("seq"))).over(own))
    live = e.where("seq >= coalesce(__dq_cut, seq) and seq >= coalesce(__dq_edit, seq)")
    parts = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    return (
        live.groupBy("conv_id", "message").agg(parts.alias("__dq_parts"))
        .select(
            "conv_id", "message",
            F.try_element_at(F.filter("__dq_parts.role", lambda r: r.isNotNull()), F.lit(-1)).alias("role"),
            F.array_join("__dq_parts.text", "").alias("text"),
        )
    )


def event_log(messages: DataFrame) -> DataFrame:
    """The log (conv_id, seq, message, kind, role, text) of a chat in which ``messages``
    (conv_id, message, role, text; messages numbered from 1) came about, for replays and tests:
    ``fold_events`` gives the messages back.

    Texts are streamed in three deltas. Of the assistant's messages about a third (by hash)
    were first drafted, with a reply after them, and then regenerated, which voids both; half
    of all others were first typed otherwise, and then edited. Null texts are empty, null
    roles stay null."""
    text = F.coalesce("text", F.lit(""))
    step = F.ceil(F.char_length(text) / 3).cast("int")
    part = lambda i: F.substring(text, F.lit(i) * step + 1, step)
    pick = lambda n: F.pmod(F.xxhash64("conv_id", "message"), F.lit(n)) == 0
    event = lambda i, kind, what, message=F.col("message"): F.struct(F.lit(i).alias("i"), message.alias("message"), kind.alias("kind"), F.col("role").alias("role"), what.alias("text"))
    delta, draft = F.lit("delta"), F.upper(F.concat(part(1), F.lit("draft")))
    again = (F.col("role") == "assistant") & pick(3)
    edited = ~again & pick(2)
    rest = F.array(event(3, delta, part(1)), event(4, delta, part(2)))
    events = (
        F.when(again, F.concat(F.array(event(0, delta, draft), event(1, delta, F.lit("a reply"), F.col("message") + 1), event(2, F.lit("regenerate"), part(0))), rest))
        .when(edited, F.concat(F.array(event(0, delta, draft), event(2, F.lit("edit"), part(0))), rest))
        .otherwise(F.concat(F.array(event(2, delta, part(0))), rest))
    )
    log = messages.select("conv_id", (F.col("message") * 8).alias("at"), F.explode(events).alias("e"))
    return log.select("conv_id", (F.col("at") + F.col("e.i")).alias("seq"), "e.message", "e.kind", "e.role", "e.text")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans``, an array of (start, length)
    in code points, counted from 0, that covers exactly the (escaped) assistant texts.

    Template, for each message in order: start mark, role, line feed, escaped text, end
    mark and line feed. The escape is reversible, so texts that hold control strings come
    back whole (``parse``). Null roles render as an empty role, null texts as empty. Messages
    are ordered by ``message``, those that repeat a number by their text; null comes first.
    Null conv_id: a conversation of its own. Other columns are dropped. No messages: no rows.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(ESC + "2"))
    shown = messages.select(
        "conv_id", F.col("message").alias("m"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"),
    ).withColumns({"h": F.char_length("head").cast("long"), "b": F.char_length("body").cast("long")})
    order = Window.partitionBy("conv_id").orderBy(F.col("m").asc_nulls_first(), "head", "body")
    before = F.coalesce(F.sum(F.col("h") + F.col("b") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shown.withColumn("at", before + F.col("h"))
    turns = F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("shown"), "b", "loss")))
    spans = F.transform(F.filter("t", lambda x: x.loss), lambda x: F.struct(x["at"].alias("start"), x.b.alias("length")))
    return (
        placed.groupBy("conv_id").agg(turns.alias("t"))
        .select("conv_id", F.array_join("t.shown", "").alias("formatted"), spans.alias("loss_spans"))
    )


def parse(formatted: Column) -> Column:
    """The messages of a rendered conversation, as array<struct<role, text>>."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(x: Column) -> Column:
        head = F.locate("\n", x)
        role = F.substring(x, F.lit(len(START) + 1), head - len(START) - 1)
        return F.struct(unescape(F.replace(role, F.lit(ESC + "2"), F.lit("\n"))).alias("role"), unescape(F.substring(x, head + 1, F.char_length(x))).alias("text"))

    return F.transform(turns, turn)


def chat_format(events: DataFrame) -> DataFrame:
    """``render(fold_events(events))``. Empty logs give no rows; a null conv_id is a
    conversation of its own. Columns other than those of the log are dropped."""
    return render(fold_events(events))
