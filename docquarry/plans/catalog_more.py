"""More of the query catalogue: search with filters, catalogue joins, deletes and updates,
media and evaluation."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.unicode import nfkc
from ..operators import answering, conversation, evaluation, jsonmap, media, relational, retrieval
from ..session import table
from ..sources import embedding
from .catalog import query, six

# --- lexical search with filters -----------------------------------------------------------

_WANTED = ("tion", "the", "licensed")


def _searched(where: str) -> str:
    return f"""
WITH t AS (SELECT doc_id AS id, lang, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents),
s AS (SELECT count(*) AS n, avg(len(k)) AS a FROM t),
x AS (SELECT id, lang, source, len(k) AS size, unnest(k) AS term FROM t),
f AS (SELECT term, id, lang, source, size, count(*)::DOUBLE AS f FROM x WHERE term IN {_WANTED} GROUP BY ALL),
g AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f),
p AS (SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / a))) AS score FROM g, s WHERE {where} GROUP BY id)
SELECT id, round(score, 6) AS lexical_score FROM p
"""


def _search(spark, d, **filters):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("collection_id"), F.when(F.col("n_chars") > 1000, "active").otherwise("dormant").alias("state"), F.col("source").alias("ingest_run_id"),
        F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("content"),
    )
    terms = spark.createDataFrame(retrieval.match_terms(_WANTED), "query_id int, group_id int, term string")
    hits = retrieval.bm25(rows, terms, {"content": 1.0}, 1 << 30, **filters)
    return hits.select("id", six(F.col("lexical_score")).alias("lexical_score"))


@query(_searched("lang = 'en' AND id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)"))
def lexical_in_active_collection(spark, d):
    return _search(spark, d, collection="en", state="active")


@query(_searched("source IN ('src1', 'src2') AND id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def lexical_in_runs_and_ids(spark, d):
    ids = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return _search(spark, d, runs=["src1", "src2"], ids=ids)


@query("""
WITH v AS (SELECT part.*, CASE WHEN p_partkey % 3 = 0 THEN 'ＡＢ' || p_brand ELSE p_brand END AS s, p_retailprice AS n, strftime(TIMESTAMP '2024-01-01 08:00:00' + INTERVAL (p_partkey % 48) HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS t FROM part),
u AS (SELECT p_partkey, 's' AS field, replace(s, 'ＡＢ', 'AB') AS value FROM v UNION ALL SELECT p_partkey, 't', strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (p_partkey % 48) HOUR, '%Y-%m-%dT%H:%M:%S') || '+00:00' FROM v
  UNION ALL SELECT p_partkey, 'b', (p_size > 25)::VARCHAR FROM v UNION ALL SELECT p_partkey, 'n', regexp_replace(regexp_replace(printf('%.2f', n), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') FROM v)
SELECT p_partkey, field, value FROM u
""")
def typed_filter_values(spark, d):
    p = table(spark, d, "part")
    at = F.timestamp_seconds(F.lit(1704096000) + F.col("p_partkey") % 48 * 3600)
    one = lambda name, kind, c: F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), c.cast("string").alias("v"))
    fields = F.array(
        one("s", "string", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ＡＢ"), "p_brand")).otherwise(F.col("p_brand"))), one("t", "datetime", F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))),
        one("b", "boolean", F.col("p_size") > 25), one("n", "number", F.round("p_retailprice", 2)),
    )
    rows = p.select("p_partkey", F.explode(fields).alias("f")).select("p_partkey", "f.*")
    return rows.select("p_partkey", "field", V.filter_value(F.col("kind"), F.col("v"), nfkc(F.col("v"))).normalized_value.alias("value"))


# --- deletes, updates and checks of a collection -------------------------------------------


@query("SELECT doc_id FROM documents WHERE NOT (source = 'src3' AND lang = 'en')")
def delete_by_predicate(spark, d):
    return retrieval.delete_where(table(spark, d, "documents"), source="src3", lang="en").select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND source = 'src1')")
def delete_run(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("collection_id"), F.col("source").alias("ingest_run_id"))
    return retrieval.delete_run(rows, "en", "src1").select("doc_id")


@query("""
SELECT l_orderkey AS chunk_id, l_linenumber AS doc_id, CASE WHEN o_orderstatus = 'F' AND l_linenumber = 1 THEN 'new' ELSE l_returnflag END AS content, coalesce(o_orderstatus = 'F' AND l_linenumber = 1, false) AS updated
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def update_points(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").cast("long").alias("doc_id"), F.col("l_returnflag").alias("content"))
    new = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id"), F.lit(1).cast("long").alias("doc_id"), F.lit("new").alias("content"))
    return retrieval.update_chunk(rows, new, ["content"])


@query("""
WITH f AS (SELECT doc_id, sha256(text) AS h FROM documents), e AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents JOIN labels USING (doc_id)),
j AS (SELECT f.h AS f, e.h AS e FROM f FULL JOIN e USING (doc_id))
SELECT count(f)::BIGINT AS found, count(e)::BIGINT AS expected, count(*) FILTER (f IS NULL)::BIGINT AS missing, count(*) FILTER (e IS NULL)::BIGINT AS unexpected, count(*) FILTER (f <> e)::BIGINT AS changed, false AS verified FROM j
""")
def verify_run(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("digest"))
    known = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    expected = docs.join(known, "chunk_id").select("chunk_id", F.when(F.col("quality") == 0, "x").otherwise(F.col("digest")).alias("digest"))
    return retrieval.verify_run(docs, expected)


@query("SELECT p_partkey, sha256(p_name || chr(0) || p_brand || chr(0) || p_type) AS hash FROM part")
def content_hashes(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", V.content_hash(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("hash"))


# --- catalogue joins -----------------------------------------------------------------------


@query("SELECT o_orderkey AS document_id, n_name AS kb_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def owned_documents(spark, d):
    kbs = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("kb_id"), F.col("n_name").alias("kb_name"), F.col("n_regionkey").alias("owner_id"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("kb_id"))
    return relational.owned_documents(docs, kbs, 1).select("document_id", "kb_name")


@query("SELECT l_orderkey AS template_id, l_linenumber AS version, o_orderpriority AS name, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS latest FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def template_versions(spark, d):
    versions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("template_id"), F.col("l_linenumber").alias("version"))
    return relational.template_versions(versions, table(spark, d, "orders").select(F.col("o_orderkey").alias("template_id"), F.col("o_orderpriority").alias("name")))


@query("SELECT o_orderkey AS document_id, c_mktsegment AS mapping FROM orders JOIN customer ON o_custkey = c_custkey")
def bound_versions(spark, d):
    bindings = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("version_id"))
    versions = table(spark, d, "customer").select(F.col("c_custkey").alias("version_id"), F.col("c_mktsegment").alias("mapping"))
    return relational.bound_versions(bindings, versions).select("document_id", "mapping")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)")
def without_references(spark, d):
    gone = table(spark, d, "orders").join(table(spark, d, "customer").where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"))
    return relational.without_references(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("""
WITH m AS (SELECT l_orderkey AS link, l_linenumber AS n, CASE WHEN l_returnflag = 'N' THEN l_suppkey::BIGINT END AS kb FROM lineitem), v AS (SELECT c_custkey AS source, c_nationkey::BIGINT AS value FROM customer WHERE c_acctbal > 0),
k AS (SELECT o_orderkey AS link, value FROM orders JOIN v ON v.source = o_custkey)
SELECT link, n, coalesce(kb, k.value, (SELECT max(value) FROM v)) AS kb FROM m LEFT JOIN k USING (link)
""")
def backfilled_messages(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("link"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "N", F.col("l_suppkey").cast("long")).alias("kb"))
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), F.col("o_custkey").alias("source"))
    sources = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").cast("long").alias("value"))
    return relational.backfilled(rows, links, sources, "link", "source", "kb")


@query("SELECT c_nationkey AS owner, count(*)::BIGINT AS total, count(*) FILTER (c_acctbal > 0)::BIGINT AS enabled, count(*) < 60 AS may_add FROM customer GROUP BY 1")
def owner_counts(spark, d):
    return relational.owner_counts(table(spark, d, "customer").withColumn("owner", F.col("c_nationkey")), "owner", F.col("c_acctbal") > 0, 60)


@query("SELECT l_orderkey AS template_id, sum((o_orderkey IS NOT NULL)::INT)::BIGINT AS uses, count(*)::BIGINT AS versions FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_linenumber = 1 GROUP BY 1")
def usage_counts(spark, d):
    versions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("template_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("version_id"))
    return relational.usage_counts(versions, table(spark, d, "orders").select(F.concat_ws("/", "o_orderkey", F.lit("1")).alias("version_id")))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders)::BIGINT AS \"of\" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def preview_with_count(spark, d):
    return relational.preview(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 80)


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 50) WHERE contains(lower(o_orderpriority), 'urgent')")
def keyword_on_page(spark, d):
    return relational.keyword_on_page(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 2, 50, "o_orderpriority", "URGENT")


@query("SELECT c_custkey, updated FROM (SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS updated FROM customer) ORDER BY updated DESC NULLS FIRST, lower(c_name), c_name LIMIT 50")
def recent_first(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("updated"))
    return relational.recent_first(rows, "updated", "c_name").select("c_custkey", "updated")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) < count(*) AS repeats FROM lineitem GROUP BY l_orderkey")
def repeated_ids(spark, d):
    ids = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("ids"))
    return ids.select("l_orderkey", relational.has_repeats(F.col("ids")).alias("repeats"))


# --- media ---------------------------------------------------------------------------------


@query(r"""
WITH u AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations), m AS (SELECT *, regexp_replace(regexp_replace(t, '(\.+)(\s|$)', '\1␟\2', 'g'), '([。！？；!?;\n]+)', '\1␟', 'g') AS x FROM u WHERE t <> ''),
p AS (SELECT *, list_filter([trim(s, ' ' || chr(9) || chr(10) || chr(13)) for s in string_split(x, '␟')], lambda s: length(s) > 1) AS parts FROM m),
e AS (SELECT conv_id, t, turn, len(parts) AS n, unnest(CASE WHEN len(parts) > 1 THEN parts ELSE [t] END) AS part FROM p)
SELECT conv_id, round(turn * 10.0 + CASE WHEN n > 1 THEN length(part) / length(t) * 4.0 ELSE 0 END, 3) AS seconds, part AS text FROM e
""")
def utterance_entries(spark, d):
    u = table(spark, d, "conversations").select("conv_id", F.lit(0.0).alias("chunk_start"), (F.col("turn") * 10_000).alias("start_ms"), (F.col("turn") * 10_000 + 4000).alias("end_ms"), "text")
    return media.utterance_entries(u, "conv_id")


@query("""
WITH e AS (SELECT conv_id, turn * 10.0 AS s, role AS t FROM conversations UNION ALL SELECT conv_id, turn * 10.0 + 5, substr(text, 1, 30) FROM conversations),
c AS (SELECT conv_id, s, t, s::BIGINT AS f FROM e WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT conv_id, string_agg('[' || CASE WHEN f >= 3600 THEN printf('%02d:%02d:%02d', f // 3600, (f // 60) % 60, f % 60) ELSE printf('%02d:%02d', f // 60, f % 60) END || '] ' || t, chr(10) || chr(10) ORDER BY s, t) AS transcript FROM c GROUP BY conv_id
""")
def captions_and_speech(spark, d):
    c = table(spark, d, "conversations")
    cues = c.select("conv_id", (F.col("turn") * 10.0).alias("start"), F.col("role").alias("text"))
    return media.captions_and_speech(cues, c.select("conv_id", (F.col("turn") * 10.0 + 5).alias("seconds"), F.substring("text", 1, 30).alias("text")), "conv_id")


@query("SELECT user_id, round(sum(value), 3) AS seconds, sum(event_id % 3)::BIGINT AS calls FROM events GROUP BY user_id")
def speech_usage(spark, d):
    return media.speech_usage(table(spark, d, "events").select("user_id", F.col("value").alias("seconds"), (F.col("event_id") % 3).alias("attempts")), "user_id")


@query("""
WITH o AS (SELECT o_orderkey AS m, 1 AS i, o_orderstatus AS t, CASE WHEN o_orderstatus = 'O' THEN 'late' END AS e, o_totalprice AS s, 1 AS a FROM orders),
n AS (SELECT l_orderkey AS m, l_linenumber AS i, l_returnflag AS t, CASE WHEN l_returnflag = 'R' THEN 'bad' END AS e, l_quantity AS s, 2 AS a FROM lineitem),
j AS (SELECT coalesce(o.m, n.m) AS m, coalesce(o.i, n.i) AS i, o.t AS ot, n.t AS nt, o.e AS oe, n.e AS ne, o.s AS os, n.s AS ns, o.a AS oa, n.a AS na, n.m IS NOT NULL AND (o.m IS NULL OR o.e IS NOT NULL OR n.e IS NULL) AS take FROM o FULL JOIN n ON o.m = n.m AND o.i = n.i)
SELECT m AS media_id, i AS "index", CASE WHEN take THEN nt ELSE ot END AS text, CASE WHEN take THEN ne ELSE oe END AS error, round(CASE WHEN take THEN coalesce(os, 0) + coalesce(ns, 0) ELSE os END, 3) AS seconds, CASE WHEN take THEN coalesce(oa, 0) + coalesce(na, 0) ELSE oa END AS attempts FROM j
""")
def merge_resumed(spark, d):
    saved = table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.lit(1).alias("index"), F.col("o_orderstatus").alias("text"), F.when(F.col("o_orderstatus") == "O", "late").alias("error"), F.col("o_totalprice").cast("double").alias("seconds"), F.lit(1).alias("attempts"))
    new = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").cast("int").alias("index"), F.col("l_returnflag").alias("text"), F.when(F.col("l_returnflag") == "R", "bad").alias("error"), F.col("l_quantity").cast("double").alias("seconds"), F.lit(2).alias("attempts"))
    return media.merge_resumed(saved, new)


@query("""
WITH c AS (SELECT source, n_chars % 10 AS ratio, (lang = 'en')::INT AS language_bonus, length(text) AS n FROM documents)
SELECT source, ratio, language_bonus, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY ratio DESC, language_bonus DESC, n DESC) = 1
""")
def best_caption(spark, d):
    c = table(spark, d, "documents").select("source", (F.col("n_chars") % 10).alias("ratio"), (F.col("lang") == "en").cast("int").alias("language_bonus"), F.col("text").alias("transcript"))
    return media.best_caption(c, "source").select("source", "ratio", "language_bonus", F.char_length("transcript").alias("n"))


@query("SELECT c.m AS media_id, c.i AS \"index\" FROM (SELECT l_orderkey AS m, l_linenumber AS i FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey, 9 FROM orders) c")
def failed_chunks(spark, d):
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").cast("int").alias("index"), F.when(F.col("l_returnflag") == "R", "bad").alias("error"))
    planned = results.select("media_id", "index").unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.lit(9).alias("index")))
    return media.failed_chunks(results, planned)


# --- records, prompts, evaluation ----------------------------------------------------------


@query("""
WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'floor ' || (event_id % 4) END AS target, 'floor ' || (event_id % 3) AS source FROM events),
n AS (SELECT *, last_value(CASE WHEN target IS NOT NULL THEN {'t': target, 'i': event_id} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM c)
SELECT event_id, CASE WHEN near.t = source THEN 'e' || near.i ELSE 'u' || user_id END AS parent_id FROM n
""")
def related_parents(spark, d):
    e = table(spark, d, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    c = e.select(
        "event_id", F.concat(F.lit("u"), "user_id").alias("parent_record_id"), place.alias("child_index"), F.concat(F.lit("e"), "event_id").alias("record_id"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("floor "), F.col("event_id") % 4)).alias("target"), F.concat(F.lit("floor "), F.col("event_id") % 3).alias("source"),
    )
    return jsonmap.related_parents(c, "source", "target").select("event_id", "parent_id")


@query("""
WITH e AS (SELECT event_id::VARCHAR AS v, 'event_id' AS path FROM events UNION ALL SELECT event_type, 'kind' FROM events UNION ALL SELECT CASE WHEN value < 50 THEN NULL ELSE event_type END, 'maybe' FROM events)
SELECT path, count(*)::BIGINT AS observed, count(*) FILTER (v IS NULL)::BIGINT AS nulls, count(v)::BIGINT AS elements, count(DISTINCT v)::BIGINT AS distinct_values, min(length(v)) FILTER (path <> 'event_id')::INT AS min_length,
  max(length(v)) FILTER (path <> 'event_id')::INT AS max_length, round(count(*) FILTER (v IS NULL) / count(*), 6) AS null_rate, round(count(DISTINCT v) / count(v), 6) AS uniqueness FROM e GROUP BY path
""")
def profile_statistics(spark, d):
    kind = F.col("event_type")
    rows = table(spark, d, "events").select(F.to_json(F.struct("event_id", kind.alias("kind"), F.when(F.col("value") >= 50, kind).alias("maybe")), {"ignoreNullFields": "false"}).alias("value"))
    p = jsonmap.profile(rows)
    return p.select("path", "observed", "nulls", "elements", "distinct_values", "min_length", "max_length", six(F.col("null_rate")).alias("null_rate"), six(F.col("uniqueness")).alias("uniqueness"))


@query("""
WITH k AS (SELECT 'few' AS shape, unnest(json_keys(json_object('event_id', event_id, 'value', value))) AS name FROM events UNION SELECT 'more', unnest(json_keys(json_object('event_id', event_id, 'value', value, 'kind', event_type))) FROM events
  UNION SELECT 'less', unnest(json_keys(json_object('event_id', event_id))) FROM events),
d AS (SELECT b.shape, 'added:' || name AS what FROM k b WHERE shape <> 'few' AND name NOT IN (SELECT name FROM k WHERE shape = 'few')
  UNION ALL SELECT s.shape, 'removed:' || name FROM k, (SELECT DISTINCT shape FROM k WHERE shape <> 'few') s WHERE k.shape = 'few' AND name NOT IN (SELECT name FROM k x WHERE x.shape = s.shape))
SELECT CASE WHEN bool_or(starts_with(what, 'removed')) THEN 'breaking' ELSE 'compatible' END AS col0, string_agg(what, ',' ORDER BY what) AS col1 FROM d GROUP BY shape
""")
def profile_compatibility(spark, d):
    e = table(spark, d, "events")
    shape = lambda *c: jsonmap.profile(e.select(F.to_json(F.struct(*c)).alias("value")))
    few, more = shape("event_id", "value"), shape("event_id", "value", F.col("event_type").alias("kind"))
    both = jsonmap.compatibility(few, more).unionByName(jsonmap.compatibility(few, shape("event_id")))
    return both.select(F.col("kind").alias("col0"), F.array_join("differences", ",").alias("col1"))


@query("""
WITH e AS (SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, event_type AS kind, 'http://a/b' AS url FROM events),
s AS (SELECT count(DISTINCT id) = count(*) AS own, avg((try_cast(stamp AS TIMESTAMP) IS NOT NULL)::INT) >= 0.9 AS dates, max(length(kind)) <= 40 AND count(DISTINCT kind) < count(*) AS short, bool_and(regexp_matches(url, '^https?://')) AS links FROM e)
SELECT unnest(['id', 'at', 'title', 'avatar_url', 'kind']) AS col0, unnest([CASE WHEN own THEN 'id' END, CASE WHEN dates THEN 'timestamp' END, CASE WHEN short THEN 'title' END, CASE WHEN links THEN 'display' END, CASE WHEN short THEN 'keyword' END]) AS col1,
  unnest([CASE WHEN own THEN 'unique_identifier' END, CASE WHEN dates THEN 'datetime_parse_rate' END, CASE WHEN short THEN 'short_title' END, CASE WHEN links THEN 'resource_reference' END, CASE WHEN short THEN 'short_repeated' END]) AS col2 FROM s
""")
def suggested_roles(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("event_type").alias("title"), F.lit("http://a/b").alias("avatar_url"), F.col("event_type").alias("kind"))).alias("value"))
    s = jsonmap.suggest_roles(jsonmap.profile(rows))
    return s.select(F.col("path").alias("col0"), F.col("role").alias("col1"), F.col("rule").alias("col2"))


@query("""
SELECT conv_id AS query_id, [{'role': 'system', 'content': 'Say it alone.'}] || list({'role': role, 'content': text} ORDER BY turn, role, text) || [{'role': 'user', 'content': 'q' || conv_id}] AS m FROM conversations GROUP BY conv_id
""".replace("AS m FROM", "AS m0 FROM").join(("SELECT query_id, len(m0)::INT AS n, sha256(array_to_string([x.role || chr(10) || x.content for x in m0], chr(10))) AS digest FROM (", ")")))
def rewrite_prompts(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    asked = c.select("conv_id").distinct().select(F.col("conv_id").alias("query_id"), "conv_id", F.concat(F.lit("q"), "conv_id").alias("question"))
    p = conversation.rewrite_prompts(asked, c, "Say it alone.")
    said = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit("\n"), m.content)), "\n")
    return p.select("query_id", F.size("messages").alias("n"), F.sha2(said, 256).alias("digest"))


@query("""
WITH m AS (SELECT lang, quality, avg(n_chars) AS chars, avg(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT a.lang, round(b.chars - a.chars, 6) AS chars, round(b.toxic - a.toxic, 6) AS toxic FROM m a JOIN m b ON a.lang = b.lang AND a.quality = 0 AND b.quality = 1
""")
def metric_deltas(spark, d):
    m = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.avg("n_chars").alias("chars"), F.avg("toxic").alias("toxic"))
    deltas = evaluation.metric_deltas(m.where("quality = 0"), m.where("quality = 1"), "lang", ["chars", "toxic"])
    return deltas.select("lang", six(F.col("chars")).alias("chars"), six(F.col("toxic")).alias("toxic"))


@query("""
WITH f AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position, 1.0 / (60 + row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)) AS rrf FROM documents),
r AS (SELECT f.*, coalesce(quality::DOUBLE, rrf) AS final FROM f LEFT JOIN labels l ON l.doc_id = f.id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, position)::INT AS final_position FROM r QUALIFY final_position <= 10
""")
def reranked(spark, d):
    docs = table(spark, d, "documents")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    hits = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.row_number().over(w).alias("position")).withColumn("rrf", 1.0 / (60 + F.col("position")))
    scores = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("rerank"))
    return retrieval.rerank(hits, scores, 10).select("query_id", "id", "final_position")


@query(r"""
WITH p AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[\n。！？；]+'), lambda s: length(regexp_replace(s, '\s+', '', 'g')) >= 10)) AS p FROM documents)
SELECT doc_id, count(*)::BIGINT AS sentences, sha256(string_agg(x, chr(10) ORDER BY x)) AS digest FROM (SELECT doc_id, trim(trim(regexp_replace(p, '\s+', ' ', 'g')), ' ，。！？；:：') AS x FROM p) GROUP BY doc_id
""")
def clean_sentences(spark, d):
    each = table(spark, d, "documents").select("doc_id", answering.clean_sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return each.select("doc_id", F.size("s").cast("long").alias("sentences"), F.sha2(F.array_join(F.sort_array("s"), "\n"), 256).alias("digest"))


@query("SELECT p_partkey, length(p_name)::DOUBLE AS a, length(replace(p_name, 'a', ''))::DOUBLE AS b FROM part")
def embedded_texts(spark, d):
    """Any function of texts can be the embedder; here one that counts characters."""

    def embedder(texts):
        return [(len(t), len(t.replace("a", ""))) for t in texts]

    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"))
    done = embedding.check_dimension(embedding.embed(parts, embedder, dimension=embedding.probe_dimension(embedder)), 2)
    return done.select("p_partkey", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


@query("""
WITH s AS (SELECT event_id, CASE WHEN value <= 0 THEN 1 WHEN value <= 30 THEN greatest(12, round_even(value, 0)) WHEN value <= 60 THEN 40 WHEN value <= 180 THEN 60 WHEN value <= 600 THEN 80 ELSE 100 END AS t, value FROM events)
SELECT event_id, least(100, t)::INT AS frames, round(value * 0.00022, 4) AS cost FROM s
""")
def media_plan(spark, d):
    return table(spark, d, "events").select("event_id", V.frame_target(F.col("value")).alias("frames"), V.media_cost(F.col("value"), F.lit(0)).alias("cost"))


@query("SELECT page_id, (length(html) - length(replace(html, '<', '')))::INT AS tags, CASE WHEN length(html) <= 20 THEN html ELSE substr(html, 1, 20) || '…' END AS title FROM pages")
def page_titles(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", T.count_matches(h, "<").alias("tags"), T.short_title(h).alias("title"))
