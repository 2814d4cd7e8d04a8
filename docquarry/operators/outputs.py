"""What a run of questions leaves: messages, references and query logs, written together once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..sources.segments import Conflict, Log

TABLES = ("messages", "references", "logs")
#: Fixed value: what is said when nothing was found.
NOTHING_FOUND = "没有找到相关信息。"


def run_outputs(questions: DataFrame, history: DataFrame, context: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a batch.

    ``questions`` (query_id, conv_id, owner_id, kb_id, question; of several rows of a query, one for
    each knowledge base, the one with the least ``kb_order`` is logged), ``history`` (conv_id, turn),
    ``context`` (query_id, place, chunk_id, doc_id, kb_id, content, score; title and page may be
    there), ``answers`` (query_id, answer, error_code). Each question takes two numbers of its conversation after
    the largest so far, questions of one conversation by query_id. Without context the answer
    is the fixed one and the log says ``empty``; with an error (or no answer row) the message
    failed, has no text and no references. Ids are hashes, so a repeated batch has the same."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("last"))
    first = questions.groupBy("query_id").agg(*(F.min_by(c, "kb_order").alias(c) for c in ("conv_id", "owner_id", "kb_id", "question")))
    found = context.groupBy("query_id").agg(F.count("*").alias("chunks"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("query_id")) - 1
    told = answers.select("query_id", "answer", "error_code", F.lit(True).alias("told"))
    q = first.withColumn("nth", nth).join(last, "conv_id", "left").join(found, "query_id", "left").join(told, "query_id", "left")
    sequence = F.coalesce("last", F.lit(-1)).cast("long") + 1 + 2 * F.col("nth")
    status = F.when(F.col("chunks").isNull(), "empty").when(F.col("error_code").isNotNull() | F.col("told").isNull(), "error").otherwise("success")
    error = F.when(status == "error", F.coalesce("error_code", F.lit("NO_ANSWER")))
    ident = lambda role: F.sha2(F.concat_ws("\0", F.col("conv_id").cast("string"), F.col("query_id").cast("string"), F.lit(role)), 256)
    said = F.when(status == "empty", NOTHING_FOUND).when(status == "success", F.coalesce("answer", F.lit("")))
    q = q.select("*", sequence.alias("sequence"), status.alias("status"), error.alias("error"), ident("user").alias("user_id"), ident("assistant").alias("reply_id"), said.alias("said"))
    row = lambda i, role, text, state, code, n: F.struct(i.alias("message_id"), F.lit(role).alias("role"), text.alias("content"), state.alias("status"), code.alias("error_code"), n.alias("sequence"), F.when(F.lit(role == "assistant"), F.char_length(text)).alias("tokens_used"))
    both = F.array(
        row(F.col("user_id"), "user", F.col("question"), F.lit("completed"), F.lit(None).cast("string"), F.col("sequence")),
        row(F.col("reply_id"), "assistant", F.col("said"), F.when(F.col("status") == "error", "failed").otherwise("completed"), F.col("error"), F.col("sequence") + 1),
    )
    messages = q.select("conv_id", F.inline(both))
    extra = {c: F.lit(None).cast("string") for c in ("title", "page") if c not in context.columns}
    good = q.where("status = 'success'").select("query_id", F.col("reply_id").alias("message_id"))
    references = context.withColumns(extra).join(good, "query_id").select("message_id", "place", "chunk_id", "doc_id", "title", "kb_id", snippet(F.col("content")).alias("snippet"), "score", "page")
    logs = q.select("query_id", "conv_id", "owner_id", "kb_id", F.col("user_id").alias("user_message_id"), F.col("reply_id").alias("assistant_message_id"), F.col("status").alias("result_status"), F.col("error").alias("error_code"), F.when(F.col("status") == "success", F.col("chunks")).otherwise(0).alias("chunks_count"))
    return {"messages": messages, "references": references, "logs": logs}


def write_outputs(outputs: dict[str, DataFrame], batch: int, root: str) -> bool:
    """Write a batch's tables below ``root``, then one log entry that makes all of them visible. A batch that
    was committed is left alone (False); what a failed attempt wrote is written over."""
    spark = outputs["messages"].sparkSession
    for name in TABLES:
        if _committed(spark, root, batch):
            return False
        outputs[name].write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    try:
        Log(spark, f"{root}/batches/{batch}").commit({"batch": batch}, -1)
    except Conflict:
        return False
    return True


def _committed(spark: SparkSession, root: str, batch: int) -> bool:
    return Log(spark, f"{root}/batches/{batch}").version() >= 0


def read_outputs(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table's rows of committed batches, with ``batch``; None while there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/batches")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = spark.read.json(f"{root}/batches/*/log/*.json").select(F.col("batch").cast("long").alias("batch"))
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch=*").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(done, "batch", "left_semi")


def answer_stream(questions: DataFrame, history: DataFrame, answer: Callable[[DataFrame], tuple[DataFrame, DataFrame]], root: str, checkpoint: str):
    """Answer a stream of questions: each micro-batch gets ``(context, answers)`` from ``answer`` and
    its outputs are written once, also when the batch is replayed. Messages of earlier
    batches count in the numbering."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _committed(spark, root, number):
            return
        before = read_outputs(spark, root, "messages")
        turns = history.select("conv_id", F.col("turn").cast("long").alias("turn"))
        turns = turns if before is None else turns.unionByName(before.select("conv_id", F.col("sequence").alias("turn")))
        context, answers = answer(batch)
        write_outputs(run_outputs(batch, turns, context, answers), number, root)

    return questions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
