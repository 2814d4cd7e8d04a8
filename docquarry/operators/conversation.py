"""Conversation history and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS_PER_MESSAGE = 200


def truncated_history(messages: DataFrame, most_tokens: int, key: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """The newest turns within the budget: a user message and the assistant's that follows it
    are one turn, any other message is its own. Costs are positive, so the running sum from
    the newest cuts exactly at the first turn that does not fit."""
    w = Window.partitionBy(key).orderBy(order)
    answers = (F.col(role) == "assistant") & (F.lag(role).over(w) == "user")
    turns = messages.withColumn("__start", (~F.coalesce(answers, F.lit(False))).cast("int"))
    turns = turns.withColumn("turn_no", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__start")
    newest = Window.partitionBy(key).orderBy(F.desc("turn_no"))  # a range frame: whole turns
    return turns.withColumn("cost", F.count("*").over(newest) * TOKENS_PER_MESSAGE).where(F.col("cost") <= most_tokens)


def next_sequence(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return messages.groupBy(key).agg((F.max(order) + 1).alias("next_sequence"))


def stale_to_failed(messages: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Messages that stream for longer than ``seconds`` become failed."""
    old = (F.col("status") == "streaming") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > seconds)
    return messages.withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def last_messages(messages: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def prompt_sources(chunks: DataFrame, key: str = "query_id", order: str = "position") -> DataFrame:
    """One text per query: its chunks in order, each under a numbered heading with title and
    page (N/A without one), joined by blank lines."""
    head = F.concat(F.lit("[ID:"), F.col(order).cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" (page "), F.coalesce(F.col("page").cast("string"), F.lit("N/A")), F.lit(")\n"))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(head, "content").alias("t"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p.t), "\n\n").alias("sources"))


def rewrite_prompts(questions: DataFrame, history: DataFrame, instruction: str) -> DataFrame:
    """(query_id, messages): what asks a model to make each question stand alone: the
    ``instruction``, the conversation's turns in order, the question. ``questions`` (query_id,
    conv_id, question), ``history`` (conv_id, turn, role, text); a conversation's turns must
    fit into a row (``truncated_history`` bounds them)."""
    said = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    turns = history.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    both = questions.join(turns, "conv_id", "left")
    past = F.coalesce(F.transform("turns", lambda t: said(t.role, t.text)), F.array().cast("array<struct<role:string,content:string>>"))
    messages = F.concat(F.array(said(F.lit("system"), F.lit(instruction))), past, F.array(said(F.lit("user"), F.col("question"))))
    return both.select("query_id", messages.alias("messages"))
