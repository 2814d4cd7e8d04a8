"""Queries over the driver's tables, one for each family of operators, with DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pairs as P
from ..functions import text as T
from ..functions import values as V
from ..operators import chunking, conversation, evaluation, jsonmap, media, relational, retrieval
from ..operators.blocks import best_by_cosine
from ..streaming import jobs
from ..session import table

#: One entry per query: what runs, and its DuckDB twin.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def six(c):
    return F.round(c, 6)


# --- dense, lexical and hybrid retrieval -------------------------------------------------

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return e, q


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.2 QUALIFY rank <= 100),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, rank) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INT AS position, id, label, round(score, 6) AS score FROM l QUALIFY position <= 5
""")
def vector_topk_threshold_dedup(spark, d):
    e, q = _vectors(spark, d)
    hits = retrieval.dense_search(e, q, 5, threshold=0.2)
    return retrieval.first_per_record(hits, ["label"], 5).select("query_id", "position", "id", "label", six(F.col("score")).alias("score"))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, rank)::INT AS position, id, label, round(score, 6) AS score FROM r QUALIFY position <= 5
""")
def vector_multi_collection_merge(spark, d):
    e, q = _vectors(spark, d)
    e = e.withColumn("collection", F.to_json(F.struct("label")))  # vectors without a label are one, too
    each = e.select("collection").distinct()
    hits = best_by_cosine(e, q.crossJoin(F.broadcast(each) if retrieval.is_small(each) else each), 3, ["collection"])
    w = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return retrieval.merge_collections(ranked, 5, "label").select("query_id", "position", "id", "label", six(F.col("score")).alias("score"))


_NORM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_BI = "list_distinct([substr({0}, i, 2) for i in range(1, length({0}))])"


@query(f"""
WITH q AS (SELECT item_id AS query_id, {_NORM.format("text")} AS q FROM benchmark),
t AS (SELECT doc_id, {_NORM.format("text")} AS t FROM documents),
b AS (SELECT *, {_BI.format("q")} AS qb FROM q), c AS (SELECT *, {_BI.format("t")} AS tb FROM t),
s AS (SELECT query_id, doc_id, CASE WHEN q = '' OR t = '' THEN 0.0 WHEN contains(t, q) THEN 1.0 WHEN length(q) = 1 OR length(t) = 1 THEN (q = t)::INT::DOUBLE
  ELSE 2.0 * len(list_intersect(qb, tb)) / (len(qb) + len(tb)) END AS lexical FROM b, c)
SELECT query_id, doc_id, round(lexical, 6) AS lexical, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10
""")
def dice_rescore(spark, d):
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), plain("text").alias("q"))
    t = table(spark, d, "documents").select("doc_id", plain("text").alias("t"))
    q, t = (df.withColumn(f"{c}b", P.pair_bits(c)).withColumn(f"{c}n", P.count_bits(F.col(f"{c}b"))) for df, c in ((q, "q"), (t, "t")))
    s = t.crossJoin(F.broadcast(q) if retrieval.is_small(q) else q).withColumn("shared", P.shared_bits(F.col("qb"), F.col("tb")))
    s = s.select("query_id", "doc_id", P.dice(F.col("q"), F.col("t"), F.col("qn"), F.col("tn"), F.col("shared")).alias("lexical"))
    w = Window.partitionBy("query_id").orderBy(F.desc("lexical"), F.asc_nulls_last("doc_id"))
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10").withColumn("lexical", six(F.col("lexical")))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {_COS} AS score, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 100),
n AS (SELECT r.*, {_NORM.format("r.text")} AS t, {_NORM.format("b.text")} AS q FROM r JOIN benchmark b ON b.item_id * 100 = r.query_id),
x AS (SELECT *, CASE WHEN q = '' OR t = '' THEN 0.0 WHEN contains(t, q) THEN 1.0 WHEN length(q) = 1 OR length(t) = 1 THEN (q = t)::INT::DOUBLE
  ELSE 2.0 * len(list_intersect({_BI.format("q")}, {_BI.format("t")})) / (len({_BI.format("q")}) + len({_BI.format("t")})) END AS lexical FROM n)
SELECT query_id, id, round(score, 6) AS score, round(lexical, 6) AS lexical, round(0.75 * score + 0.25 * lexical, 6) AS rank_score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(0.75 * score + 0.25 * lexical, 9) DESC, rank)::INT AS position FROM x QUALIFY position <= 5
""")
def hybrid_rank(spark, d):
    e, q = _vectors(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("content"))
    texts = table(spark, d, "benchmark").select((F.col("item_id") * 100).alias("query_id"), F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("query_text"))
    # Ids and scores are ranked; only the candidates meet their texts.
    asked = q.join(texts.select("query_id"), "query_id", "left_semi")  # without a text no hit of theirs is shown
    hits = retrieval.dense_search(e.join(docs.select("id"), "id").drop("label"), asked, 5)
    own = docs.join(hits.select("id").distinct(), "id", "left_semi")
    hits = hits.join(own, "id").join(texts, "query_id")
    scored = retrieval.hybrid_rescore(hits).withColumn("by", F.round("rank_score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("by"), "rank")
    top = scored.withColumn("position", F.row_number().over(w)).where("position <= 5")
    return top.select("query_id", "id", six(F.col("score")).alias("score"), six(F.col("lexical")).alias("lexical"), six(F.col("rank_score")).alias("rank_score"), "position")


BM25_TERMS = ["tion", "the", "ble", "thing", "licensed"]


@query(f"""
WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents),
s AS (SELECT count(*) AS n, avg(len(k)) AS a FROM t),
x AS (SELECT id, len(k) AS size, unnest(k) AS term FROM t),
f AS (SELECT term, id, size, count(*)::DOUBLE AS f FROM x WHERE term IN ({", ".join(f"'{t}'" for t in BM25_TERMS)}) GROUP BY ALL),
g AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f),
p AS (SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / a))) AS score FROM g, s GROUP BY id)
SELECT id, round(score, 6) AS lexical_score, row_number() OVER (ORDER BY round(score, 9) DESC, id)::INT AS lexical_rank FROM p QUALIFY lexical_rank <= 50
""")
def bm25_search(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("content"))
    terms = spark.createDataFrame(retrieval.match_terms(BM25_TERMS), "query_id int, group_id int, term string")
    hits = retrieval.bm25(rows, terms, {"content": 1.0}, 200).withColumn("by", F.round("lexical_score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("by"), "id")
    return hits.withColumn("lexical_rank", F.row_number().over(w)).where("lexical_rank <= 50").select("id", six(F.col("lexical_score")).alias("lexical_score"), "lexical_rank")


@query("""
WITH a AS (SELECT event_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id FROM a WHERE event_type IN ('click', 'error', 'purchase') AND k >= 20 AND k <= 60 AND value >= 10
""")
def eav_filter_and_in_range(spark, d):
    e = table(spark, d, "events")
    fields = F.array(
        F.struct(F.lit("event_type").alias("field_name"), F.lit("string").alias("kind"), F.col("event_type").alias("v")),
        F.struct(F.lit("k").alias("field_name"), F.lit("number").alias("kind"), F.get_json_object("props", "$.k").alias("v")),
        F.struct(F.lit("value").alias("field_name"), F.lit("number").alias("kind"), F.col("value").cast("string").alias("v")),
    )
    eav = e.select("event_id", F.explode(fields).alias("f")).select("event_id", "f.field_name", V.filter_value(F.col("f.kind"), F.col("f.v")).alias("x")).select("event_id", "field_name", "x.*")
    return retrieval.eav_filter(eav, [("event_type", "in", ["click", "error", "purchase"]), ("k", "gte", 20), ("k", "lte", 60), ("value", "gte", 10)], key="event_id")


@query("""
WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars % 1000 DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS best_rank FROM (FROM a UNION ALL FROM b) GROUP BY id)
SELECT id, round(rrf, 6) AS rrf, best_rank::INT AS best_rank, row_number() OVER (ORDER BY rrf DESC, best_rank, id)::INT AS position FROM f QUALIFY position <= 30
""")
def rrf_fuse(spark, d):
    docs = table(spark, d, "documents")
    lane = lambda by: docs.orderBy(F.desc(by), "doc_id").limit(50).select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(F.desc(by), "doc_id")).alias("rank"))
    docs = docs.withColumn("rest", F.col("n_chars") % 1000)
    fused = retrieval.reciprocal_rank_fusion([lane("n_chars"), lane("rest")])
    return fused.select("id", six(F.col("rrf")).alias("rrf"), "best_rank", "position")


@query("""
WITH s AS (SELECT conv_id, turn AS t0, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS seed_rank FROM conversations QUALIFY seed_rank <= 2),
w AS (SELECT conv_id, unnest([t0 - 1, t0, t0 + 1]) AS turn, seed_rank FROM s),
f AS (SELECT conv_id, turn, min(seed_rank)::INT AS seed_rank FROM w GROUP BY ALL)
SELECT c.conv_id, c.turn, f.seed_rank, c.role, length(c.text)::INT AS n_chars FROM conversations c JOIN f USING (conv_id, turn)
""")
def neighbor_expand(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.char_length("text")), "turn")
    seeds = c.withColumn("seed_rank", F.row_number().over(w)).where("seed_rank <= 2")
    return retrieval.neighbours(seeds, c, "conv_id", "turn").select("conv_id", "turn", "seed_rank", "role", F.char_length("text").alias("n_chars"))


@query("""
WITH t AS (SELECT conv_id, turn, (length(text) // 4 + 1)::BIGINT AS tokens FROM conversations),
r AS (SELECT *, row_number() OVER w AS position, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS running_tokens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, tokens, position::INT AS position, running_tokens FROM r WHERE (running_tokens <= 300 OR position = 1) AND position <= 8
""")
def context_pack(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return retrieval.pack_context(c, ["conv_id"], ["turn"], T.token_estimate(F.col("text")), 8, 300).drop("text").select("conv_id", "turn", "tokens", "position", "running_tokens")


@query("""
WITH a AS (SELECT conv_id, turn, role, coalesce(role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user', false) AS joined FROM conversations),
b AS (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM a)
SELECT conv_id, turn, role, turn_no, (count(*) OVER (PARTITION BY conv_id ORDER BY turn_no DESC) * 200)::BIGINT AS cost FROM b QUALIFY cost <= 600
""")
def history_truncate(spark, d):
    return conversation.truncated_history(table(spark, d, "conversations").select("conv_id", "turn", "role"), 600).select("conv_id", "turn", "role", "turn_no", "cost")


@query("""
SELECT conv_id, string_agg('[ID:' || turn || '] ' || role || ' (page N/A)' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS sources FROM conversations GROUP BY conv_id
""")
def prompt_assembly(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("role").alias("title"), F.lit(None).cast("int").alias("page"), F.col("text").alias("content"))
    return conversation.prompt_sources(c, "conv_id")


# --- text --------------------------------------------------------------------------------


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc, count(*) OVER (PARTITION BY sha256(text))::BIGINT AS copies FROM documents")
def exact_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = docs.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return docs.join(groups, "h").select("doc_id", "first_doc", "copies")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1")
def upload_dedup_per_source(spark, d):
    return relational.deduplicate_uploads(table(spark, d, "documents").select("source", "doc_id", "text"), "source", "text", "doc_id").select("source", "doc_id")


@query(r"""
SELECT page_id, sha256(trim(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), ' ' || chr(10) || chr(13) || chr(9))) AS stripped_sha256 FROM pages
""")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.without_tags(F.col("html")), 256).alias("stripped_sha256"))


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS one_spaced, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: list_position(string_split(text, chr(10)), x) = i), chr(10))) AS distinct_lines,
  ((length(text)) // 4 + 1)::BIGINT AS tokens, substr(text, 1, 500) AS snippet FROM documents
""")
def text_transforms(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(T.one_spaced(t), 256).alias("one_spaced"), F.sha2(T.distinct_lines(t), 256).alias("distinct_lines"), T.token_estimate(t).alias("tokens"), T.snippet(t).alias("snippet"))


@query("""
SELECT doc_id, i::INT AS slice_no, sha256(substr(text, i * 500 + 1, 500)) AS part FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents)
""")
def chunk_resplit_500(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(T.slices(F.col("text"), 500)).alias("slice_no", "part"))
    return docs.withColumn("part", F.sha2("part", 256))


_WIDE = "[一-鿿\u3000-〿\uff00-\uffef]"
_WIDTH = "(length({0}) - length(regexp_replace({0}, '" + _WIDE + "', '', 'g')))"
_TOKENS = f"(2 * {_WIDTH} + (length({{0}}) - {_WIDTH}) // 4 + 1)"
_HEAD = r"coalesce(substr({0}, 1, list_filter(range(1, {1} + 1), lambda k: k + length(regexp_replace(substr({0}, 1, k::INT), '[\x00-\x7F]', '', 'g')) >= {1})[1]::INT), {0})"
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


# The twin knows sentences, lines and cuts by tokens; documents hold no tables or questions with answers.
@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(regexp_extract_all({_TRIM.format("line")}, '[^。！？；!?…]*[。！？；!?…]|[^。！？；!?…]+$')) AS unit, generate_subscripts(regexp_extract_all({_TRIM.format("line")}, '[^。！？；!?…]*[。！？；!?…]|[^。！？；!?…]+$'), 1) AS m FROM l),
u AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, m) AS pos, unit, {_TOKENS.format("unit")} AS tok, {_TOKENS.format("unit")} > 256 * 1.15 AS long FROM (SELECT doc_id, n, m, {_TRIM.format("unit")} AS unit FROM s) WHERE unit <> ''),
g AS (SELECT doc_id, pos, 1 AS grp, CASE WHEN long THEN 257 ELSE tok END AS used FROM u WHERE pos = 1
  UNION ALL SELECT u.doc_id, u.pos, CASE WHEN NOT u.long AND used + tok <= 256 THEN grp ELSE grp + 1 END, CASE WHEN u.long THEN 257 WHEN used + tok <= 256 THEN used + tok ELSE tok END FROM g JOIN u ON u.doc_id = g.doc_id AND u.pos = g.pos + 1),
p AS (SELECT u.doc_id, grp, string_agg(unit, '' ORDER BY u.pos) AS content, bool_or(long) AS long, max(u.pos) AS last FROM g JOIN u USING (doc_id, pos) GROUP BY u.doc_id, grp),
c AS (SELECT p.doc_id, grp, content, p.long, coalesce(u.unit, '') AS after FROM p LEFT JOIN u ON u.doc_id = p.doc_id AND u.pos = p.last + 1),
h AS (SELECT doc_id, grp, 0 AS piece, '' AS body, content AS rest FROM c WHERE long
  UNION ALL SELECT doc_id, grp, piece + 1, {_HEAD.format("rest", 256)}, substr(rest, length({_HEAD.format("rest", 256)}) + 1) FROM h WHERE rest <> ''),
o AS (SELECT doc_id, grp, 0 AS piece, {_TRIM.format("content")} || {_HEAD.format("after", 50)} AS content FROM c WHERE NOT long
  UNION ALL SELECT doc_id, grp, piece, {_TRIM.format("(body || " + _HEAD.format("rest", 50) + ")")} FROM h WHERE piece > 0),
i AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, piece)::INT - 1 AS chunk_index, content FROM o WHERE content <> '')
SELECT doc_id, doc_id || ':' || chunk_index || ':' || substr(sha256(content), 1, 16) AS chunk_id, chunk_index, content FROM i
""")
def chunk_split(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents"))


@query(r"""
WITH p AS (SELECT doc_id, list_filter([trim(x, ' ，。！？；:：') for x in string_split_regex(text, '[\n。！？；]+')], lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, flatten([[substr(x, i * 500 + 1, 500) for i in range(0, (length(x) + 499) // 500)] for x in l]) AS f FROM p),
d AS (SELECT doc_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS e FROM s)
SELECT doc_id, (generate_subscripts(e, 1) - 1)::INT AS entry_no, unnest(e) AS entry FROM d
""")
def topic_entries(spark, d):
    return chunking.topic_entries(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "entry_no", "entry")


#: Every tenth page gets each of these hosts, so that all classes occur.
_HOSTS = ["https://mp.weixin.qq.com", "http://sph77.example.net", "https://m.bilibili.com", "https://b23.tv", "https://www.iesdouyin.com", "https://WWW.YouTube.com", "ftp://youtu.be", "HTTPS://youtu.be"]
_PATH = r"regexp_extract(url, '^[^:/?#]+://[^/?#]*(.*)$', 1)"


@query(f"""
WITH p AS (SELECT page_id, CASE page_id % 10 {" ".join(f"WHEN {i} THEN '{h}' || {_PATH}" for i, h in enumerate(_HOSTS))} WHEN 8 THEN ' ' || url ELSE url END AS url FROM pages),
h AS (SELECT page_id, url, lower(regexp_extract(trim(url), '^https?://([^/]+)', 1)) AS host FROM p)
SELECT page_id, url, CASE WHEN host = '' THEN 'local' WHEN host SIMILAR TO '.*(weixin\\.qq\\.com|finder\\.video\\.qq\\.com).*' OR starts_with(host, 'sph') THEN 'weixin'
  WHEN contains(host, 'bilibili.com') OR contains(host, 'b23.tv') THEN 'bilibili' WHEN contains(host, 'douyin.com') THEN 'douyin' WHEN contains(host, 'youtube.com') OR contains(host, 'youtu.be') THEN 'youtube' ELSE 'other' END AS source_class FROM h
""")
def source_classify(spark, d):
    rest, n = F.regexp_extract("url", r"(?s)^[^:/?#]+://[^/?#]*(.*)$", 1), F.col("page_id") % 10
    url = F.when(n == 8, F.concat(F.lit(" "), "url"))
    for i, h in enumerate(_HOSTS):
        url = url.when(n == i, F.concat(F.lit(h), rest))
    p = table(spark, d, "pages").select("page_id", url.otherwise(F.col("url")).alias("url"))
    return p.withColumn("source_class", V.source_class(F.col("url")))


@query()
def normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", V.normalized_url(F.col("url")).alias("url"), V.video_id(F.col("url")).alias("video_id"), V.is_public_url(F.col("url")).alias("public"))


@query("""
WITH p AS (SELECT p_partkey, p_retailprice / 20 AS cost FROM part),
m AS (SELECT *, CASE WHEN cost < 30 THEN 55.0 ELSE 40.0 END::DOUBLE AS m FROM p),
b AS (SELECT *, cost / (6.5::DOUBLE * (1 - 0.15::DOUBLE - m / 100)) AS buyer FROM m)
SELECT p_partkey, floor(buyer * 100 + 0.5) / 100 AS buyer_price, floor(buyer * 2 * 100 + 0.5) / 100 AS msrp FROM b
""")
def pricing(spark, d):
    cost = F.col("p_retailprice") / 20
    q = V.price_quote(cost, F.lit(6.5), F.lit(15.0), F.lit(10.0), V.default_margin(cost), F.lit(2.0))
    return table(spark, d, "part").select("p_partkey", q["buyer_price"].alias("buyer_price"), q["msrp"].alias("msrp"))


# --- JSON --------------------------------------------------------------------------------


@query("SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_props_group(spark, d):
    k = jsonmap.get(F.parse_json("props"), "k", "bigint")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT 'k' AS path, 'scalar' AS container, count(*)::BIGINT AS observed, 0::BIGINT AS nulls, count(DISTINCT json_extract_string(props, '$.k'))::BIGINT AS distinct_values FROM events
""")
def profile_paths(spark, d):
    return jsonmap.profile(table(spark, d, "events").select(F.col("props").alias("value"))).select("path", "container", "observed", "nulls", "distinct_values")


@query("""
SELECT event_id::VARCHAR AS record_id, 'event' AS record_type, trim(event_type) AS title, regexp_replace(value::VARCHAR, '\\.0$', '') AS value,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN printf('.%06d', epoch_us(ts) % 1000000) ELSE '' END || '+00:00' AS ts, false AS rejected FROM events
""")
def map_json_records(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("source_pointer"), F.parse_json(F.to_json(F.struct("event_id", "event_type", "value", F.col("ts").cast("string").alias("ts")))).alias("record"))
    m = jsonmap.Mapping("event", "$[*]", (jsonmap.Field("event_id", "id"), jsonmap.Field("event_type", "title", transforms=("trim",)), jsonmap.Field("value", "filter"), jsonmap.Field("ts", "timestamp")))
    out = jsonmap.map_records(rows, m)
    return out.select("record_id", "record_type", "title", out.filters["value"].alias("value"), out.timestamps["ts"].alias("ts"), "rejected")


# --- relational --------------------------------------------------------------------------


@query("SELECT source, count(*)::BIGINT AS docs, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents GROUP BY source")
def kb_doc_stats(spark, d):
    docs = table(spark, d, "documents")
    kb = docs.select("source").distinct()
    return relational.counts_with_default(kb, docs, "source", "source", docs=F.count("*"), chars=F.sum("n_chars"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return relational.latest_per_key(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def orphan_anti_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return relational.orphans(c, table(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_scope(spark, d):
    users = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return relational.data_scope(table(spark, d, "documents").select("doc_id", "source"), "RESTRICTED", "source", "doc_id", ["src1", "src2"], users, "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE false")
def scope_restricted_empty(spark, d):
    return relational.data_scope(table(spark, d, "documents").select("doc_id", "source"), "RESTRICTED", "source", "doc_id")


@query("""
SELECT o_orderkey, o_custkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
""")
def left_nest_collect(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    n = relational.nested(o, lines, "o_orderkey", ["l_linenumber"], "lines")
    return n.withColumn("lines", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x.l_linenumber.cast("string"), x.l_returnflag)), ","))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'removed' WHEN (d.n_chars > 1000)::INT IS NOT DISTINCT FROM l.quality THEN 'same' ELSE 'changed' END AS change
FROM documents d FULL JOIN labels l USING (doc_id)
""")
def full_outer_compare(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("v"))
    return relational.compare(docs, table(spark, d, "labels").select("doc_id", F.col("quality").alias("v")), ["doc_id"], "v").select("doc_id", "change")


@query("""
WITH h AS (SELECT sha256(text) AS h FROM documents), p AS (SELECT substr(h, 1, 4) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY p)) AS aggregate_hash FROM p
""")
def run_verify_hash(spark, d):
    return retrieval.aggregate_digest(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)::BIGINT AS recent, recent >= 2 AS limited FROM events WHERE event_type = 'error'
""")
def rate_limit_window(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return relational.rate_limited(e, "user_id", "ts", 86_400, 2).drop("ts")


@query("""
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTES, true)::INT AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS started, count(*)::BIGINT AS events FROM i GROUP BY user_id, n
""")
def session_windows(spark, d):
    e = jobs.sessions(table(spark, d, "events"), "user_id")
    return e.select("user_id", F.unix_timestamp(F.col("session_window.start").cast("timestamp")).alias("started"), "events")


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("hour"), "event_type", "n")


# --- time-coded text ---------------------------------------------------------------------

_IVALS = "WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 100 AS t FROM events), m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e WHERE t > s), i AS (SELECT *, sum(coalesce((s > p)::INT, 1)) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM m), u AS (SELECT user_id, k, min(s) AS s, max(t) AS t FROM i GROUP BY ALL)"


def _intervals(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return media.merged_intervals(table(spark, d, "events").select("user_id", at.alias("start"), (at + F.col("value") * 100).alias("end")), "user_id")


@query(f"{_IVALS} SELECT user_id, count(*)::BIGINT AS islands, round(sum(t - s), 2) AS covered FROM u GROUP BY user_id")
def interval_merge_coverage(spark, d):
    return _intervals(spark, d).groupBy("user_id").agg(F.count("*").alias("islands"), F.round(F.sum(F.col("end") - F.col("start")), 2).alias("covered"))


_LENGTH = 40_000_000.0


@query(f"""
{_IVALS}, z AS (SELECT min(epoch_us(ts)) / 1e6 AS z FROM events), o AS (SELECT user_id, s - z AS s, t - z AS t FROM u, z),
g AS (SELECT user_id, coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY s), 0) AS a, s AS b FROM o UNION ALL SELECT user_id, coalesce(max(t), 0), {_LENGTH} FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN o USING (user_id) GROUP BY user_id)
SELECT user_id, round(a, 3) AS "start", round(b, 3) AS "end" FROM g WHERE b > a
""")
def gaps(spark, d):
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    m = _intervals(spark, d).crossJoin(F.broadcast(e.agg(F.min(at).alias("z"))))  # one row
    m = m.select("user_id", (F.col("start") - F.col("z")).alias("start"), (F.col("end") - F.col("z")).alias("end"))
    return media.gaps(m, "user_id", e.select("user_id").distinct().withColumn("duration", F.lit(_LENGTH)))


@query("""
WITH p AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM (SELECT conv_id, turn, role AS text FROM conversations))
SELECT conv_id, turn, CASE WHEN text = b THEN '' WHEN b <> '' AND starts_with(text, b) THEN trim(substr(text, length(b) + 1)) ELSE text END AS delta FROM p
""")
def caption_delta(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("text"))
    return media.caption_deltas(c, "conv_id", "turn").select("conv_id", "turn", "delta")


@query("""
WITH c AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS near_id, user_id, epoch_us(ts) / 1e6 AS nt FROM events WHERE event_type = 'purchase'),
j AS (SELECT c.event_id, near_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(t - nt), nt DESC) AS r FROM c JOIN p ON c.user_id = p.user_id AND abs(t - nt) <= 86400)
SELECT c.event_id, j.near_id FROM c LEFT JOIN j ON c.event_id = j.event_id AND r = 1
""")
def nearest_asof(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "t")
    buys = e.where("event_type = 'purchase'").select(F.col("event_id").alias("near_id"), "user_id", F.col("t").alias("nt"))
    return media.nearest_within(clicks, buys, "user_id", "t", "nt", 86400.0).select("event_id", "near_id")


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT DISTINCT source, round_even(j * (n - 1) / 4.0, 0)::BIGINT AS i FROM r, range(0, 5) x(j))
SELECT r.source, doc_id FROM r LEFT JOIN k USING (source, i) WHERE n <= 5 OR k.i IS NOT NULL
""")
def even_sample(spark, d):
    return media.even_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5).select("source", "doc_id")


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT DISTINCT source, floor(j * n / 24.0)::BIGINT AS i FROM r, range(0, 24) x(j))
SELECT r.source, doc_id FROM r LEFT JOIN k USING (source, i) WHERE n <= 24 OR k.i IS NOT NULL
""")
def strided_sample(spark, d):
    return media.strided_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").select("source", "doc_id")


# --- evaluation --------------------------------------------------------------------------


@query("""
WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) % 5 AS stratum FROM documents)
SELECT doc_id, stratum::BIGINT AS stratum FROM r QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('20260813:' || doc_id)) <= 20
""")
def stratified_sample(spark, d):
    return evaluation.stratified_sample(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 5, 20).select("doc_id", F.col("stratum").cast("long").alias("stratum"))


@query("""
WITH r AS (SELECT d.source AS query_id, d.lang AS kind, d.doc_id, row_number() OVER (PARTITION BY d.source, d.lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents d),
q AS (SELECT DISTINCT query_id || '/' || kind AS query_id, kind FROM r), x AS (SELECT query_id || '/' || kind AS query_id, doc_id, rank FROM r),
w AS (SELECT x.query_id, count(*) AS wanted, count(*) FILTER (rank <= 10) AS hits, min(rank) FILTER (rank <= 10) AS first FROM x JOIN labels l USING (doc_id) WHERE quality = 1 GROUP BY 1),
m AS (SELECT kind, coalesce(hits / wanted, 0) AS recall, coalesce(hits, 0) / 10.0 AS "precision", coalesce((first = 1)::INT, 0) AS top1, coalesce(1.0 / first, 0) AS mrr FROM q LEFT JOIN w USING (query_id))
SELECT kind, count(*)::BIGINT AS cases, round(avg(recall), 6) AS recall, round(avg("precision"), 6) AS "precision", round(avg(top1), 6) AS top1, round(avg(mrr), 6) AS mrr, grouping(kind) = 1 AS overall FROM m GROUP BY ROLLUP (kind)
""")
def eval_recall_mrr(spark, d):
    docs = table(spark, d, "documents").withColumn("query_id", F.concat_ws("/", "source", "lang"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    ranked = docs.select("query_id", F.col("doc_id").alias("item"), F.row_number().over(w).alias("rank"))
    relevant = docs.join(table(spark, d, "labels").where("quality = 1"), "doc_id").select("query_id", F.col("doc_id").alias("item"))
    cases = docs.select("query_id", F.col("lang").alias("kind")).distinct()
    m = evaluation.retrieval_metrics(ranked, relevant, cases, 10)
    return m.select("kind", "cases", *(six(F.col(x)).alias(x) for x in ("recall", "precision", "top1", "mrr")), "overall")


# --- whole runs and small operators --------------------------------------------------------


@query()
def retrieve_and_expand(spark, d):
    """Questions are benchmark texts at the vectors divisible by 100, each over two knowledge
    bases, which are labels."""
    from ..operators import answering

    e = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").join(e, F.col("doc_id") == F.col("vec_id"))
    chunks = docs.select(
        F.col("label").alias("kb_id"), (F.col("doc_id") % 50).alias("doc_id"), (F.col("doc_id") / 50).cast("int").alias("chunk_index"), F.col("doc_id").cast("string").alias("chunk_id"),
        F.lit(None).cast("string").alias("record_id"), F.col("text").alias("content"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
    kbs = e.select(F.col("label").alias("kb_id"), F.lit(1).alias("owner_id")).distinct()
    asked = e.where("vec_id % 100 = 0").join(table(spark, d, "benchmark"), F.col("item_id") * 100 == F.col("vec_id"))
    both = F.posexplode(F.array("label", (F.col("label") + 1) % 10)).alias("kb_order", "kb_id")
    questions = asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("owner_id"), F.col("text").alias("question"), F.col("embedding").cast("array<double>").alias("query_vector"), both)
    prepared = answering.prepared_chunks(chunks)
    found = answering.retrieve(prepared, questions, kbs, 5)
    return answering.expand_context(found, prepared, questions).select("query_id", "place", "chunk_id", "is_neighbor", six(F.col("score")).alias("score"), "tokens")


@query(r"""
WITH m AS (SELECT *, regexp_replace(regexp_replace(text, '(\.+)(\s|$)', '\1␟\2', 'g'), '([。！？；!?;\n]+)', '\1␟', 'g') AS marked FROM documents),
p AS (SELECT *, list_filter([trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) for s in string_split(marked, '␟')], lambda s: s <> '') AS parts FROM m)
SELECT doc_id, greatest(1, len(list_filter(parts, lambda s: length(s) > 1)) + coalesce((length(parts[-1]) = 1)::INT, 0))::BIGINT AS sentences,
  greatest(1, greatest(len(regexp_extract_all(text, '[A-Za-z0-9]+')), ceil(length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) / 4)))::BIGINT AS speech_tokens FROM p
""")
def sentence_and_speech_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.sentence_count(t).cast("long").alias("sentences"), T.speech_token_estimate(t).alias("speech_tokens"))


@query("""
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock
FROM (SELECT event_id, floor(value * 50)::BIGINT AS s FROM events)
""")
def clock_format(spark, d):
    return table(spark, d, "events").select("event_id", V.clock(F.col("value") * 50).alias("clock"))


@query("SELECT conv_id, (max(turn) + 1)::BIGINT AS next_sequence FROM conversations GROUP BY conv_id")
def next_sequence(spark, d):
    return conversation.next_sequence(table(spark, d, "conversations"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def last_messages(spark, d):
    return conversation.last_messages(table(spark, d, "conversations").select("conv_id", "turn", "role"), 2)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_of_orders(spark, d):
    return relational.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3, 50)


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'pending' END AS shown FROM events
""")
def shown_states(spark, d):
    return table(spark, d, "events").select("event_id", V.shown_state(F.col("event_type")).alias("shown"))


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'new' ELSE event_type END AS event_type FROM events
""")
def event_merge_last_wins(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return relational.merge_events(e, e.where("event_type in ('click', 'view')").withColumn("event_type", F.lit("new")), ["event_id"])


@query("""
SELECT n_name, count(DISTINCT c_custkey)::BIGINT AS customers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY n_name
""")
def tpch_returns_by_nation(spark, d):
    t = lambda n: table(spark, d, n)
    j = (
        t("lineitem").where("l_returnflag = 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return j.groupBy("n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def tpch_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@query("SELECT count(*)::BIGINT AS n, sum(('0x' || substr(sha256(text), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest_sum FROM documents")
def run_verify_order_free(spark, d):
    return retrieval.order_free_digest(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


from . import catalog_more, catalog_outputs, catalog_records, catalog_stored  # noqa: E402, F401  more entries of the same catalogue
