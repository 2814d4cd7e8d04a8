"""Whole retrieval runs for a batch of questions, and topic evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, letters_and_digits, one_spaced, slices, strip, token_estimate
from ..functions.unicode import nfkc
from .blocks import best_by_cosine
from .conversation import prompt_sources, truncated_history
from .retrieval import candidates, cosine, first_per_record, hybrid_rescore, is_small


def prepared_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks`` (kb_id, doc_id, chunk_index, chunk_id, record_id, content, embedding, ...) with
    the normalised text and its bigrams, made once for all questions."""
    d = chunks.withColumn("id", F.col("chunk_id")).withColumn("plain", letters_and_digits(nfkc(F.col("content"))))
    return d.withColumn("plain_pairs", bigrams(F.col("plain"))).withColumn("embedding", F.col("embedding").cast("array<double>"))


def retrieve(prepared: DataFrame, questions: DataFrame, kbs: DataFrame, top_k: int, threshold: float = 0.2) -> DataFrame:
    """The best chunks of every question over its knowledge bases, each of which the asking
    owner must own: ``questions`` (query_id, owner_id, kb_id, kb_order, question,
    query_vector), one row per knowledge base; ``kbs`` (kb_id, owner_id, kb_name).

    Per knowledge base: candidates by cosine, the inclusive threshold, hybrid scores, one hit
    per record. Then all lists of a question are one: by score, knowledge-base order, rank."""
    owned = questions.join(kbs, ["kb_id", "owner_id"]).drop("owner_id")  # before anything is read from an index
    # Ids and scores are ranked; only the candidates meet their texts, which are prepared for them alone.
    hits = best_by_cosine(prepared.select("kb_id", "id", "embedding"), owned, candidates(top_k), ["kb_id"], threshold)
    w = Window.partitionBy("query_id", "kb_id").orderBy(F.desc("score"), "id")
    near = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= candidates(top_k))
    few = F.broadcast if is_small(questions) else lambda df: df
    texts = prepared.join(few(near.select("kb_id", "id").distinct()), ["kb_id", "id"], "left_semi")
    near = near.withColumn("query_text", letters_and_digits(nfkc(F.col("question")))).drop("question").join(texts, ["kb_id", "id"])
    scored = hybrid_rescore(near, "query_text", "plain").drop("query_text", "plain")
    record = scored.withColumn("record", F.coalesce("record_id", "chunk_id"))
    own = first_per_record(record, ["doc_id", "record"], top_k, "rank_score", ["query_id", "kb_id"]).drop("rank").withColumnRenamed("position", "rank")
    merged = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "kb_order", "rank")
    return own.withColumn("position", F.row_number().over(merged)).where(F.col("position") <= top_k)


def expand_context(found: DataFrame, prepared: DataFrame, questions: DataFrame, seeds: int = 2, most_chunks: int = 8, most_tokens: int = 2000) -> DataFrame:
    """Found chunks and the neighbours of each question's first ``seeds``, within the budgets:
    found chunks are packed first, then neighbours in window order. The result is ordered
    with the windows first, each in document order, then the other found chunks
    (``place``)."""
    core = found.select("query_id", "kb_id", "chunk_id", "doc_id", "chunk_index", "content", "score", "position", F.lit(False).alias("is_neighbor"))
    start = core.where(F.col("position") <= seeds)
    wanted = start.select("query_id", "kb_id", "doc_id", F.col("position").alias("window"), F.explode(F.sequence(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    # A question has three rows here for each seed at most, and one vector per knowledge base.
    few = F.broadcast if is_small(questions) else lambda df: df
    around = prepared.select("kb_id", "doc_id", "chunk_index", "chunk_id", "content", "embedding").join(few(wanted), ["kb_id", "doc_id", "chunk_index"])
    vectors = questions.select("query_id", "kb_id", F.col("query_vector").alias("v")).dropDuplicates(["query_id", "kb_id"])
    around = around.join(few(vectors), ["query_id", "kb_id"]).withColumn("score", cosine(F.col("embedding"), F.col("v"))).drop("embedding", "v")
    # A chunk that several windows hold stands where it comes first.
    first = around.groupBy("query_id", "kb_id", "chunk_id").agg(F.min(F.struct("window", "chunk_index")).alias("at"), *(F.first(c).alias(c) for c in ("doc_id", "content", "score")))
    both = first.join(core.select("query_id", "kb_id", "chunk_id", "position"), ["query_id", "kb_id", "chunk_id"], "full_outer")
    rest = core.select("query_id", "kb_id", "chunk_id", *(F.col(c).alias(f"core_{c}") for c in ("doc_id", "chunk_index", "content", "score")))
    all_rows = both.join(rest, ["query_id", "kb_id", "chunk_id"], "left").select(
        "query_id", "kb_id", "chunk_id", F.coalesce("core_doc_id", "doc_id").alias("doc_id"), F.coalesce("core_chunk_index", "at.chunk_index").alias("chunk_index"),
        F.coalesce("core_content", "content").alias("content"), F.coalesce("core_score", "score").alias("score"), "position", "at", F.col("position").isNull().alias("is_neighbor"),
    )
    packing = Window.partitionBy("query_id").orderBy(F.col("position").asc_nulls_last(), "at", "chunk_id")
    running = packing.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = all_rows.where(strip(F.col("content")) != "").withColumn("tokens", token_estimate(F.col("content"))).withColumn("n", F.row_number().over(packing)).withColumn("upto", F.sum("tokens").over(running))
    kept = packed.where((F.col("n") <= most_chunks) & ((F.col("upto") <= most_tokens) | (F.col("n") == 1)))
    shown = Window.partitionBy("query_id").orderBy(F.col("at").asc_nulls_last(), "position")
    return kept.withColumn("place", F.row_number().over(shown)).drop("n", "upto", "at")


def answer_prompts(messages: DataFrame, questions: DataFrame, context: DataFrame, titles: DataFrame, history_tokens: int = 2000) -> DataFrame:
    """One prompt per question: its conversation's newest turns, the numbered sources and the
    question; questions without sources have status ``empty`` and no prompt to send."""
    history = truncated_history(messages, history_tokens).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
    named = context.join(titles, "doc_id", "left").withColumnsRenamed({"place": "nth"})
    sources = prompt_sources(named.withColumn("page", F.lit(None).cast("int")), "query_id", "nth")
    one = questions.select("query_id", "conv_id", "question").dropDuplicates(["query_id"])
    return one.join(history, "conv_id", "left").join(sources, "query_id", "left").select(
        "query_id", "history", F.when(F.col("sources").isNotNull(), F.concat("sources", F.lit("\n\n用户问题: "), "question")).alias("prompt"),
        F.when(F.col("sources").isNull(), "empty").otherwise("success").alias("status"),
    )


def load_topics(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, skipped) of JSON texts (path, value): topics need a question and an answer."""
    v = F.try_parse_json("value")
    at = lambda p: strip(F.coalesce(F.try_variant_get(v, p, "string"), F.lit("")))
    items = F.try_variant_get(v, "$.comments", "array<variant>")
    comments = F.filter(F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda c: strip(F.try_variant_get(c, "$.text", "string"))), lambda c: c.isNotNull() & (c != ""))
    t = texts.select("path", F.try_variant_get(v, "$.topic_id", "string").alias("topic_id"), at("$.question.text").alias("question"), at("$.answer.text").alias("answer"), comments.alias("comments"))
    good = F.coalesce((F.col("question") != "") & (F.col("answer") != "") & F.col("topic_id").isNotNull(), F.lit(False))
    return t.where(good), t.where(~good).select("path")


def clean_sentences(c: Column) -> Column:
    """Sentences of at least ten visible characters, white space collapsed, marks stripped."""
    parts = F.filter(F.split(c, r"[\n。！？；]+"), lambda p: F.char_length(F.regexp_replace(p, r"(?U)\s+", "")) >= 10)
    return F.transform(parts, lambda p: F.btrim(one_spaced(p), F.lit(" ，。！？；:：")))


def representations(topics: DataFrame, strategy: str, size: int = 500) -> DataFrame:
    """(topic_id, entry_no, entry): the first characters of the whole topic (``atomic``), or
    every different sentence slice (``topic``)."""
    if strategy == "atomic":
        sections = F.concat(F.lit("问题：\n"), "question", F.lit("\n\n回答：\n"), "answer", F.when(F.size("comments") > 0, F.concat(F.lit("\n\n补充讨论：\n"), F.array_join("comments", "\n"))).otherwise(""))
        return topics.select("topic_id", F.lit(0).alias("entry_no"), F.substring(sections, 1, size).alias("entry"))
    sources = F.concat(F.array("question", "answer"), F.col("comments"))
    parts = F.flatten(F.transform(sources, lambda s: F.when(F.size(clean_sentences(s)) > 0, clean_sentences(s)).otherwise(F.array(s))))
    entries = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(parts, lambda p: slices(p, size))), strip), lambda e: e != ""))
    return topics.select("topic_id", F.posexplode(entries).alias("entry_no", "entry"))


def query_cases(topics: DataFrame) -> DataFrame:
    """(query_id, topic_id, kind, query): the longest sentence of question and answer, cut to
    100 characters."""
    longest = lambda c: F.substring(F.array_max(F.transform(clean_sentences(F.col(c)), lambda s: F.struct(F.char_length(s).alias("n"), s.alias("s")))).s, 1, 100)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), longest(k).alias("query")) for k in ("question", "answer")))
    rows = topics.select("topic_id", F.explode(kinds).alias("x")).select(F.concat("topic_id", F.lit(":"), F.substring("x.kind", 1, 1)).alias("query_id"), "topic_id", "x.kind", "x.query")
    return rows.where("query is not null")
