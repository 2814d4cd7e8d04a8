"""Queries over what runs leave: stored uploads, cited sources, messages and their logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.citations import citation_numbers
from ..operators import jsonmap, outputs, relational
from ..session import shared_dir, table
from ..sources import uploads
from .catalog import query

_MOST = 20_000


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""
WITH p AS (SELECT page_id, html, octet_length(encode(html)) AS n FROM pages)
SELECT 'page-' || page_id || '.html' AS name, n::BIGINT AS bytes, CASE WHEN n <= {_MOST} THEN sha256(html) END AS sha256,
  CASE WHEN n <= {_MOST} THEN substr(sha256(html), 1, 2) || '/' || substr(sha256(html), 3, 2) || '/' || sha256(html) || '.html' END AS stored, CASE WHEN n IS NULL THEN 'FILE_MISSING' WHEN n > {_MOST} THEN 'FILE_TOO_LARGE' END AS error,
  CASE WHEN n <= {_MOST} THEN n::BIGINT END AS stored_bytes FROM p
""")
def uploaded_pages(spark, d):
    """All pages as uploads in one commit, and what lies in the store afterwards."""
    root = _fresh(spark, "uploads")
    uploads.write_uploads(table(spark, d, "pages").select(F.format_string("page-%d.html", "page_id").alias("name"), F.col("html").cast("binary").alias("content")), root, _MOST)
    kept = uploads.stored_contents(spark, root).select("stored", F.octet_length("content").cast("long").alias("stored_bytes"))
    return uploads.committed_uploads(spark, root).drop("job").join(kept, "stored", "left")


_ANSWER = "w || ' [1]【2】 <i>[3]</i> [' || doc_id % 12 || '] <b>[4] `[5]` [see [6]](http://a/[7]) [1##' || doc_id % 5 || '#] http://b/[8] <br> 【9】<!-- [2] --> [03] ' || w || ' 【2##3#'"


@query(f"""
WITH a AS (SELECT doc_id, doc_id % 12 AS x, doc_id % 5 AS y, doc_id % 10 AS n, w, [w] AS ws FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g') AS w FROM documents)),
c AS (SELECT doc_id, w, n, list_filter([[1], [2], [x], [4], [1, y], [9], [3], [2, 3]], lambda g: list_min(g) >= 1 AND list_max(g) <= n) AS g FROM a)
SELECT doc_id, length(w)::INT AS n_chars, array_to_string(flatten(g), ',') AS cited FROM c
""")
def answer_citations(spark, d):
    """Whole texts as answers with marks in and outside of protected spans."""
    w = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", "")
    a = table(spark, d, "documents").select("doc_id", w.alias("w")).withColumn("answer", F.expr(_ANSWER))
    return a.select("doc_id", F.char_length("w").alias("n_chars"), F.array_join(citation_numbers(F.col("answer"), F.col("doc_id") % 10), ",").alias("cited"))


@query("""
WITH t AS (SELECT conv_id, role, CASE WHEN text IS NOT NULL THEN string_split(text, ' ') END AS words FROM conversations), c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
SELECT 'id' AS path, 'scalar' AS container, NULL AS child_of, count(*)::BIGINT AS observed, 0::BIGINT AS nulls, count(*)::BIGINT AS elements, count(*)::BIGINT AS distinct_values, 0::BIGINT AS child_arrays FROM c
UNION ALL SELECT 'turns', 'array', NULL, count(*), 0, sum(n)::BIGINT, 0, count(*) FROM c
UNION ALL SELECT 'turns.role', 'scalar', 'turns', count(*), count(*) FILTER (role IS NULL), count(role), count(DISTINCT role), 0 FROM t
UNION ALL SELECT 'turns.words', CASE WHEN count(*) > count(words) THEN 'scalar' ELSE 'array' END, 'turns', count(*), count(*) FILTER (words IS NULL), coalesce(sum(len(words)), 0)::BIGINT, (SELECT count(DISTINCT w) FROM (SELECT unnest(words) AS w FROM t)), 0 FROM t
""")
def profile_nested(spark, d):
    """Profile of conversations as nested JSON: an array of records with an array of words each."""
    turn = F.struct("role", F.split("text", " ").alias("words"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    rows = c.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "turns"), {"ignoreNullFields": "false"}).alias("value"))
    return jsonmap.profile(rows).select("path", "container", "child_of", "observed", "nulls", "elements", "distinct_values", "child_arrays")


@query(f"""
WITH c AS (SELECT conv_id, max(turn)::BIGINT AS last, 'about ' || conv_id AS question FROM conversations GROUP BY conv_id),
s AS (SELECT item_id AS conv_id, text FROM benchmark), n AS (SELECT conv_id, count(*) AS chunks, string_agg(substr(coalesce(text, ''), 1, 500), chr(10) ORDER BY substr(coalesce(text, ''), 1, 500)) AS snippets FROM s GROUP BY conv_id),
q AS (SELECT c.*, chunks, snippets, CASE WHEN chunks IS NULL THEN 'empty' WHEN c.conv_id % 7 = 3 THEN 'error' ELSE 'success' END AS status FROM c LEFT JOIN n USING (conv_id)),
m AS (SELECT conv_id, 'user' AS role, question AS content, 'completed' AS status, last + 1 AS sequence, NULL AS error_code, NULL AS snippets, status AS result_status FROM q
  UNION ALL SELECT conv_id, 'assistant', CASE status WHEN 'empty' THEN '{outputs.NOTHING_FOUND}' WHEN 'success' THEN 'said ' || conv_id END, CASE status WHEN 'error' THEN 'failed' ELSE 'completed' END, last + 2, CASE status WHEN 'error' THEN 'TIMEOUT' END, CASE status WHEN 'success' THEN snippets END, status FROM q)
SELECT conv_id, role, content, status, sequence, error_code, CASE WHEN snippets IS NOT NULL THEN sha256(snippets) END AS snippets_sha256, result_status FROM m WHERE conv_id IS NOT NULL
""")
def run_output_tables(spark, d):
    """Each conversation asks once, benchmark items are its sources; a second write of the batch changes nothing."""
    talks = table(spark, d, "conversations").select("conv_id", "turn").where("conv_id is not null")
    asked = talks.select("conv_id").distinct().select(F.col("conv_id").alias("query_id"), "conv_id", F.lit(1).alias("owner_id"), F.lit(1).alias("kb_id"), F.lit(0).alias("kb_order"), F.concat(F.lit("about "), F.col("conv_id").cast("string")).alias("question"))
    b = table(spark, d, "benchmark")
    context = b.join(asked.select("query_id"), F.col("item_id") == F.col("query_id"), "left_semi").select(F.col("item_id").alias("query_id"), F.lit(1).alias("place"), F.col("item_id").alias("chunk_id"), F.col("item_id").alias("doc_id"), F.lit(1).alias("kb_id"), F.coalesce("text", F.lit("")).alias("content"), F.lit(0.5).alias("score"))
    answers = asked.select("query_id", F.concat(F.lit("said "), F.col("conv_id").cast("string")).alias("answer"), F.when(F.col("conv_id") % 7 == 3, "TIMEOUT").alias("error_code"))
    root = _fresh(spark, "outputs")
    for _ in range(2):
        outputs.write_outputs(outputs.run_outputs(asked, talks, context, answers), 0, root)
    messages, references, logs = (outputs.read_outputs(spark, root, t) for t in outputs.TABLES)
    shown = references.groupBy("message_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("snippet")), "\n"), 256).alias("snippets_sha256"))
    state = logs.select(F.explode(F.array("user_message_id", "assistant_message_id")).alias("message_id"), "result_status")
    return messages.join(shown, "message_id", "left").join(state, "message_id").select("conv_id", "role", "content", "status", "sequence", "error_code", "snippets_sha256", "result_status")


@query("""
SELECT p_partkey AS conv_id, coalesce(ids, '') AS kb_ids, coalesce(names, '') AS kb_names, kb_id FROM part LEFT JOIN (
  SELECT l_partkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS ids, string_agg(coalesce(s_name, '-'), ',' ORDER BY l_suppkey) AS names, min(l_suppkey) AS kb_id
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey GROUP BY l_partkey) ON l_partkey = p_partkey
""")
def linked_suppliers(spark, d):
    """Parts as conversations, their suppliers as knowledge bases; only those with a balance are enabled."""
    kbs = relational.enabled_kbs(table(spark, d, "supplier").select(F.col("s_suppkey").alias("kb_id"), F.col("s_name").alias("kb_name"), (F.col("s_acctbal") > 0).alias("enabled")))
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("conv_id"), F.col("l_suppkey").alias("kb_id"))
    found = relational.linked_kbs(table(spark, d, "part").select(F.col("p_partkey").alias("conv_id")), links, kbs)
    return found.select("conv_id", F.concat_ws(",", F.col("kb_ids").cast("array<string>")).alias("kb_ids"), F.concat_ws(",", F.transform("kb_names", lambda n: F.coalesce(n, F.lit("-")))).alias("kb_names"), "kb_id")


@query("""
SELECT c_custkey AS version_id, count(o_orderkey)::BIGINT AS n_uses, count(o_orderkey) > 0 AS immutable FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_custkey = c_custkey GROUP BY c_custkey
UNION ALL SELECT -1, count(*), count(*) = 0 FROM customer
""")
def usage_guards(spark, d):
    """Versions (customers) with their uses (orders that are not being deleted), and the guard of the first account."""
    customers = table(spark, d, "customer")
    docs = relational.present_documents(table(spark, d, "orders").select(F.col("o_custkey").alias("version_id"), F.when(F.col("o_orderstatus") == "P", "deleting").otherwise("done").alias("status")))
    guarded = relational.guarded_versions(customers.select(F.col("c_custkey").alias("version_id")), docs)
    first = relational.may_create_first_admin(customers).select(F.lit(-1).alias("version_id"), F.col("n_users").alias("n_uses"), F.col("allowed").alias("immutable"))
    return guarded.unionByName(first)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET (SELECT greatest(0, (count(*) - 1) // 25 * 25) FROM orders WHERE o_orderstatus = 'F')")
def last_page_of_completed(spark, d):
    """A page far behind the end of the completed orders is their last page."""
    rows = relational.completed_messages(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("streaming").alias("status")))
    return relational.clamped_page(rows, [F.desc("o_orderdate"), "o_orderkey"], 1_000_000_000, 25).select("o_orderkey", "o_custkey")


@query("""
WITH v AS (SELECT o_custkey AS k, o_orderpriority AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
l AS (SELECT k, max(n) AS n, arg_max(f, n) AS f FROM v GROUP BY k),
i AS (SELECT c_custkey AS template_id, CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-HIGH' ELSE '5-LOW' END AS fingerprint FROM customer)
SELECT template_id, fingerprint, (coalesce(n, 0) + CASE WHEN f = fingerprint THEN 0 ELSE 1 END)::BIGINT AS version, coalesce(f <> fingerprint, true) AS created FROM i LEFT JOIN l ON k = template_id
""")
def saved_template_versions(spark, d):
    """Customers save a definition each; their orders are the versions so far."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    versions = table(spark, d, "orders").select(F.col("o_custkey").alias("template_id"), n.alias("version"), F.col("o_orderpriority").alias("fingerprint"))
    wanted = F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").when(F.col("c_mktsegment") == "MACHINERY", "2-HIGH").otherwise("5-LOW")
    incoming = table(spark, d, "customer").select(F.col("c_custkey").alias("template_id"), wanted.alias("fingerprint"))
    return relational.saved_versions(versions, incoming).select("template_id", "fingerprint", "version", "created")
