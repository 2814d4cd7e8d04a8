"""Queries over mapped records with children, and over states of jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import jsonmap, maptree
from ..session import table
from ..streaming import tasks
from .catalog import query


@query("""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
k AS (SELECT *, lag(role) OVER w AS near, lag(i) OVER w AS prev FROM t WHERE NOT (conv_id % 5 = 0 AND i = 1) WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
e AS (SELECT conv_id, list(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS said FROM k GROUP BY conv_id),
b AS (SELECT conv_id, 'head' || chr(10) || string_agg(text, chr(10) ORDER BY i) || chr(10) || 'tail' AS body FROM t GROUP BY conv_id),
p AS (SELECT conv_id, array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT list_contains(said, trim(x, ' ' || chr(10) || chr(9) || chr(13)))), chr(10)) AS content FROM b JOIN e USING (conv_id) WHERE conv_id % 7 <> 0)
SELECT conv_id, 0::INT AS child_index, 'talk' AS record_type, 'c' || conv_id AS record_id, NULL AS parent_id, sha256(content) AS content_sha256 FROM p
UNION ALL SELECT conv_id, i::INT, 'turn', conv_id || '-' || i, CASE WHEN near = CASE WHEN i % 3 = 2 THEN 'user' ELSE 'nobody' END THEN conv_id || '-' || prev ELSE 'c' || conv_id END, sha256(text)
FROM k WHERE conv_id % 7 <> 0
""")
def mapped_tree(spark, d):
    """Two-level JSON of conversations: echoes of turns leave the body, some parents and children are rejected."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    t = turns.withColumn("i", i)
    cid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("i").cast("string"))
    said = F.when(~((F.col("conv_id") % 5 == 0) & (F.col("i") == 1)), F.col("text"))
    comment = F.struct("i", cid.alias("cid"), F.col("role").alias("author"), said.alias("content"), F.when(F.col("i") % 3 == 2, "user").otherwise("nobody").alias("referTo"), F.col("text").alias("whole"))
    both = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(comment)).alias("comments"))
    title = F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("t"), "conv_id"))
    body = F.concat_ws("\n", F.lit("head"), F.transform("comments", lambda c: c.whole), F.lit("tail"))
    packed = F.transform("comments", lambda c: F.struct(c.cid.alias("cid"), c.author.alias("author"), c.content.alias("content"), c.referTo.alias("referTo")))
    record = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("id"), title.alias("title"), body.alias("body"), packed.alias("comments")))
    rows = jsonmap.records(both.select("conv_id", record.alias("value")), "$")
    f = jsonmap.Field
    child = jsonmap.Mapping("turn", "comments[*]", (f("cid", "id"), f("author", "filter"), f("content", "content", conditions=(("required", None),))), relation=("referTo", "author"))
    mapping = jsonmap.Mapping("talk", "$", (f("id", "id"), f("title", "title", conditions=(("required", None),)), f("body", "content", transforms=("remove_child_echo",))), (child,))
    out = maptree.map_tree(rows, mapping, ["conv_id"])
    return out.select("conv_id", "child_index", "record_type", "record_id", "parent_id", F.sha2("content", 256).alias("content_sha256"))


_STATES = {"view": "pending", "click": "parsing", "signup": "embedding", "purchase": "done", "error": "failed"}


@query(f"""
WITH u AS (SELECT (user_id * 100 + day(ts))::VARCHAR AS job_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items())} END AS state, epoch_us(ts) // 1000 AS ms FROM events),
r AS (SELECT *, CASE state WHEN 'pending' THEN 0 WHEN 'parsing' THEN 2 WHEN 'embedding' THEN 4 ELSE 6 END AS rank FROM u),
t AS (SELECT *, coalesce(max(rank) OVER w, -1) AS top FROM r WINDOW w AS (PARTITION BY job_id ORDER BY ms, rank, state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN rank > top THEN ms END) OVER w AS last FROM t WINDOW w AS (PARTITION BY job_id ORDER BY ms, rank, state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, min(CASE WHEN top BETWEEN 0 AND 5 AND ms > last + 21600000 THEN last + 21600000 END) OVER (PARTITION BY job_id) AS cut FROM l),
e AS (SELECT job_id, coalesce(min(cut), CASE WHEN max(rank) < 6 THEN max(CASE WHEN rank > top THEN ms END) + 21600000 END) AS lapsed FROM c GROUP BY job_id)
SELECT job_id, ms, state, rank > top AND NOT coalesce(ms > cut, false) AS accepted, CASE WHEN ms > cut THEN 'ended' WHEN rank <= top THEN CASE WHEN top = 6 THEN 'ended' ELSE 'not forward' END END AS reason FROM c
UNION ALL SELECT job_id, lapsed, 'failed', true, 'timeout' FROM e WHERE lapsed IS NOT NULL
""")
def job_state_changes(spark, d):
    """Daily jobs of users: stages go forward only, six hours of silence fail a job."""
    states = F.create_map(*(F.lit(x) for pair in _STATES.items() for x in pair))
    e = table(spark, d, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("job_id"), F.element_at(states, F.col("event_type")).alias("state"), F.col("ts").cast("timestamp").alias("at"))
    out = tasks.job_states_of(e, 21_600_000, F.lit("2100-01-01"))
    return out.select("job_id", F.unix_millis("at").alias("ms"), "state", "accepted", "reason")
