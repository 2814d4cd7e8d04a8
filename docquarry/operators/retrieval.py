"""Dense, lexical and hybrid retrieval as DataFrame plans."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, dice
from .blocks import best_by_cosine

#: BM25 parameters.
K1, B = 1.2, 0.75
SMALL = 1000  # rows up to which search terms are broadcast or inlined


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of double; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def is_small(df: DataFrame, most: int = 10_000) -> bool:
    """Whether ``df`` has at most so many rows; no more than one over is counted."""
    return df.limit(most + 1).count() <= most


def candidates(top_k: int) -> int:
    """How many candidates dense search fetches before re-scoring and deduplication."""
    return max(20 * top_k, 100)


def dense_search(vectors: DataFrame, queries: DataFrame, top_k: int, group: Sequence[str] = (), threshold: float | None = None) -> DataFrame:
    """Exact top candidates of every query (query_id, query_vector, and the ``group`` columns)
    among ``vectors`` (id, embedding array<double>, ...): adds ``score`` and ``rank``.

    Vectors and queries meet in blocks, each of which passes on only its best rows, so any
    number of queries is taken. The inclusive ``threshold`` is on the cosine alone."""
    scored = best_by_cosine(vectors, queries, candidates(top_k), group, threshold)
    best = Window.partitionBy("query_id", *group).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= candidates(top_k))


def hybrid_rescore(hits: DataFrame, query: str = "query_text", content: str = "content") -> DataFrame:
    """Adds ``lexical`` and ``rank_score`` = 0.75 cosine + 0.25 lexical, over normalised texts.
    The sets of bigrams come from columns of these names with ``_pairs``, where a caller has
    made them once per text, else from the texts here."""
    for c in (query, content):
        if f"{c}_pairs" not in hits.columns:
            hits = hits.withColumn(f"{c}_pairs", bigrams(F.col(c)))
    hits = hits.withColumn("lexical", dice(F.col(query), F.col(content), F.col(f"{query}_pairs"), F.col(f"{content}_pairs")))
    return hits.withColumn("rank_score", 0.75 * F.col("score") + 0.25 * F.col("lexical")).drop(f"{query}_pairs", f"{content}_pairs")


def first_per_record(hits: DataFrame, record: Sequence[str], top_k: int, by: str = "score", within: Sequence[str] = ("query_id",)) -> DataFrame:
    """The best hit of each record, then the best ``top_k`` per query: adds ``position``."""
    own = Window.partitionBy(*within, *record).orderBy(F.desc(by), "rank")
    kept = hits.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")
    order = Window.partitionBy(*within).orderBy(F.desc(by), "rank")
    return kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k)


def merge_collections(hits: DataFrame, top_k: int, order: str) -> DataFrame:
    """Results of several collections in one list: by score, then collection order and rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), order, "rank")
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_k)


def neighbours(seeds: DataFrame, chunks: DataFrame, doc: str, index: str, reach: int = 1) -> DataFrame:
    """Chunks within ``reach`` positions of a seed (doc, index, seed_rank) in its document.
    The band join becomes an equi-join on the exploded positions. First come the windows in
    seed order; a chunk that two windows hold stays where it first stands."""
    wanted = seeds.select(F.col(doc), F.col("seed_rank"), F.explode(F.sequence(F.col(index) - reach, F.col(index) + reach)).alias(index))
    first = wanted.groupBy(doc, index).agg(F.min("seed_rank").alias("seed_rank"))
    return chunks.join(first, [doc, index])


def pack_context(chunks: DataFrame, partition: Sequence[str], order: Sequence[str | Column], tokens: Column, most_chunks: int = 8, most_tokens: int = 2000) -> DataFrame:
    """The longest prefix of at most so many chunks and tokens; the first chunk always stays.
    Costs are positive, so the rows within the running budget are a prefix."""
    w = Window.partitionBy(*partition).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = chunks.withColumn("tokens", tokens).withColumn("position", F.row_number().over(w)).withColumn("running_tokens", F.sum("tokens").over(running))
    return packed.where(((F.col("running_tokens") <= most_tokens) | (F.col("position") == 1)) & (F.col("position") <= most_chunks))


def lexical_index(rows: DataFrame, weights: dict[str, float], also: Sequence[str] = ("collection_id", "state", "ingest_run_id"), wanted: Sequence[str] | None = None) -> DataFrame:
    """An inverted index of ``rows`` (id, one array<string> of tokens per column in ``weights``):
    (term, id, size, f, and the columns ``also`` that the rows have). Written as a table
    partitioned by a hash of ``term`` it serves all later searches; ``wanted`` keeps the terms of
    one search, before anything is exploded."""
    kept = [c for c in also if c in rows.columns]
    size = F.aggregate(F.array(*(F.size(c) for c in weights)), F.lit(0), lambda a, x: a + x)
    weighted = F.concat(*(_weighted(c, w) for c, w in weights.items()))
    if wanted is not None:
        weighted = F.filter(weighted, lambda t: t.term.isin(list(wanted)))
    each = rows.select("id", *kept, size.alias("size"), F.explode(weighted).alias("t"))
    return each.groupBy("t.term", "id", "size", *kept).agg(F.sum("t.w").alias("f"))


def index_statistics(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: number of rows and their average size, over all states and collections."""
    size = F.aggregate(F.array(*(F.size(c) for c in weights)), F.lit(0), lambda a, x: a + x)
    return rows.agg(F.count("*").alias("n_rows"), F.avg(size).alias("avg_size"))


def search_index(
    index: DataFrame, stats: DataFrame, terms: DataFrame, limit: int, collection: str | None = None, state: str | None = None, runs: Sequence[str] | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Ranked hits of weighted BM25 in a ``lexical_index``; ``terms`` (query_id, group_id, term).
    A group scores only if the row holds all of its terms. Frequencies are those of the whole
    index; collection, state, runs and ids (a DataFrame) choose which rows may be hits,
    before the limit. None does not filter; an empty list of runs or no ids give no hits.
    Result: query_id, id, lexical_score, lexical_rank (ties by id). ``terms`` are broadcast while
    they are few, which is counted."""
    few = (lambda df: F.broadcast(df)) if terms.limit(SMALL + 1).count() <= SMALL else (lambda df: df)
    tf = index.join(few(terms.select("term").distinct()), "term")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # one row per wanted term
    for column, value in (("collection_id", collection), ("state", state)):
        if value is not None:
            tf = tf.where(F.col(column) == value)
    if runs is not None:
        tf = tf.where(F.col("ingest_run_id").isin(list(runs)) if runs else F.lit(False))
    if ids is not None:
        tf = tf.join(ids.select("id").distinct(), "id", "left_semi")
    one = tf.join(few(df), "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))
    groups = terms.groupBy("query_id", "group_id").agg(F.count_distinct("term").alias("need"))
    scored = (
        one.withColumn("part", part).join(few(terms.distinct()), "term")
        .groupBy("query_id", "group_id", "id").agg(F.sum("part").alias("part"), F.count_distinct("term").alias("held"))
        .join(few(groups), ["query_id", "group_id"]).where("held = need")
        .groupBy("query_id", "id").agg(F.sum("part").alias("lexical_score"))
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), "id")
    return scored.withColumn("lexical_rank", F.row_number().over(w)).where(F.col("lexical_rank") <= limit)


def bm25(rows: DataFrame, terms: DataFrame, weights: dict[str, float], limit: int, **filters) -> DataFrame:
    """``search_index`` over an index made for these terms alone: of the rows' tokens only
    wanted ones are exploded, where the terms are few."""
    wanted = [r.term for r in terms.select("term").distinct().limit(SMALL + 1).collect()]
    index = lexical_index(rows, weights, wanted=wanted if len(wanted) <= SMALL else None)
    return search_index(index, index_statistics(rows, weights), terms, limit, **filters)


def _weighted(column: str, weight: float) -> Column:
    return F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))


def match_terms(tokens: Sequence[str], query_id: int = 0) -> list[tuple[int, int, str]]:
    """(query_id, group_id, term) rows of analyzed query tokens: tokens are alternatives; the
    parts of a hyphenated one must occur together."""
    return [(query_id, i, part) for i, token in enumerate(tokens) for part in token.split("-") if part]


def eav_filter(attributes: DataFrame, predicates: Sequence[tuple[str, str, object]], key: str = "chunk_id") -> DataFrame:
    """Ids whose attributes (key, field_name, value_type, normalized_value, numeric_value,
    datetime_value) meet every predicate (field, op, value); op is eq, in, gte or lte. One
    pass: each predicate is a conditional aggregate."""
    if not 0 < len(predicates) <= 20:
        raise ValueError("1 to 20 filters")
    checks = []
    for field, op, value in predicates:
        values = list(value) if op == "in" else [value]
        kinds = {_kind(v) for v in values}
        if len(kinds) > 1:
            raise ValueError("values of one filter must have one type")
        kind = kinds.pop()
        column = {"number": "numeric_value", "datetime": "datetime_value"}.get(kind, "normalized_value")
        own = (F.col("field_name") == field) & (F.col("value_type") == kind)
        if op in ("gte", "lte"):
            if kind not in ("number", "datetime"):
                raise ValueError("ranges are for numbers and date-times")
            own &= F.col(column) >= values[0] if op == "gte" else F.col(column) <= values[0]
        else:
            own &= F.col(column).isin([_plain(v) for v in values])
        checks.append(own)
    met = attributes.where(functools.reduce(operator.or_, checks))
    flags = {f"p{i}": F.max(c.cast("int")) for i, c in enumerate(checks)}
    return met.groupBy(key).agg(*(v.alias(k) for k, v in flags.items())).where(" and ".join(f"{k} = 1" for k in flags)).select(key)


def filter_ids(attributes: DataFrame, predicates: Sequence[tuple[str, str, object]] | None, key: str = "chunk_id") -> DataFrame | None:
    """Ids for ``search_index``: None (no filter) without predicates, else those that meet all,
    which may be none at all and then let no hit through."""
    return eav_filter(attributes, predicates, key).withColumnRenamed(key, "id") if predicates else None


def _kind(v: object) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "datetime"


def _plain(v: object) -> object:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else float(v) if isinstance(v, (int, float)) else v if isinstance(v, str) else v.isoformat(timespec="seconds")


def reciprocal_rank_fusion(lanes: Sequence[DataFrame], k: int = 60, lane_limit: int = 50, limit: int = 30) -> DataFrame:
    """Fuse ranked lanes (query_id, id, rank): sum of 1 / (k + rank); ties by best lane rank,
    then id."""
    all_hits = None
    for lane in lanes:
        part = lane.where(F.col("rank") <= lane_limit).select("query_id", "id", "rank")
        all_hits = part if all_hits is None else all_hits.unionByName(part)
    fused = all_hits.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "best_rank", "id")
    return fused.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def rerank(hits: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """Order by the reranker's score where it has one (query_id, id, rerank), else by fusion."""
    joined = hits.join(scores, ["query_id", "id"], "left").withColumn("final", F.coalesce("rerank", "rrf"))
    w = Window.partitionBy("query_id").orderBy(F.desc("final"), "position")
    return joined.withColumn("final_position", F.row_number().over(w)).where(F.col("final_position") <= limit)


def activate_run(rows: DataFrame, collection: str, run: str) -> DataFrame:
    """The collection's rows of ``run`` become active, its other active rows dormant. Runs
    that are dormant may be activated again."""
    own = F.col("collection_id") == collection
    state = F.when(own & (F.col("ingest_run_id") == run), "active").when(own & (F.col("state") == "active"), "dormant").otherwise(F.col("state"))
    return rows.withColumn("state", state)


def delete_run(rows: DataFrame, collection: str, run: str) -> DataFrame:
    """Rows without those of a run, whatever their state; again does no more."""
    return rows.where(~F.coalesce((F.col("collection_id") == collection) & (F.col("ingest_run_id") == run), F.lit(False)))


def delete_where(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows without those whose columns have these values (``doc_id=7``, ``collection_id="a"``)."""
    if not equal:
        raise ValueError("a delete needs a condition")
    met = functools.reduce(operator.and_, (F.col(k) == F.lit(v) for k, v in equal.items()))
    return rows.where(~F.coalesce(met, F.lit(False)))


def update_chunk(rows: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with the new ``columns`` of ``changes`` (chunk_id, doc_id, ...), each only where the
    chunk belongs to that document; ``updated`` tells which (their embeddings are stale)."""
    new = changes.select("chunk_id", "doc_id", *(F.col(c).alias(f"__new_{c}") for c in columns), F.lit(True).alias("__hit"))
    both = rows.join(new, ["chunk_id", "doc_id"], "left")
    hit = F.coalesce("__hit", F.lit(False))
    return both.select(*(F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns), hit.alias("updated"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], **defaults: object) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same key; columns that it lacks get the
    ``defaults``, else null."""
    for name, value in defaults.items():
        new = new.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in new.columns else F.lit(value))
    return old.join(new, list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def verify_run(found: DataFrame, expected: DataFrame, key: str = "chunk_id", digest: str = "digest") -> DataFrame:
    """One row: counts, missing and unexpected keys, changed digests, and whether all agree.
    A full outer join; no ids are collected."""
    f, e = found.select(key, F.col(digest).alias("f")), expected.select(key, F.col(digest).alias("e"))
    n = lambda c: F.count_if(c).cast("long")
    out = f.join(e, key, "full_outer").agg(
        n(F.col("f").isNotNull()).alias("found"), n(F.col("e").isNotNull()).alias("expected"), n(F.col("f").isNull()).alias("missing"),
        n(F.col("e").isNull()).alias("unexpected"), n(F.col("f") != F.col("e")).alias("changed"),
    )
    return out.withColumn("verified", F.expr("missing = 0 and unexpected = 0 and changed = 0"))


def order_free_digest(rows: DataFrame, digest: str) -> DataFrame:
    """One row: count and the sum of the first 60 bits of each hexadecimal digest. It merges
    from any partitioning in any order, so unlike a hash of sorted digests it never brings a
    run's rows together."""
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest_sum"))


def aggregate_digest(rows: DataFrame, digest: str, head: int = 4) -> DataFrame:
    """One row: count and a hash of all hexadecimal digests, in any order: the sorted digests of
    each prefix of ``head`` digits are hashed, then these hashes in order of the prefixes. No
    group holds more than its share of 16^head, and the last at most so many hashes."""
    part = rows.groupBy(F.substring(digest, 1, head).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(digest)), ""), 256).alias("d"))
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x.d), "")
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(top, 256).alias("aggregate_hash"))
