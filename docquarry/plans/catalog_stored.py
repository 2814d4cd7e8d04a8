"""Queries over indexes that are written once and searched, changed and searched again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.lexical_index import LexicalIndex
from ..operators.vector_index import VectorIndex
from ..session import shared_dir, table
from .catalog import _COS, _vectors, query, six

_TERMS = ("tion", "the", "licensed")


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _chunks(spark, d):
    # Cut at what is no letter or digit: cheaper than finding each run.
    tokens = F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+", -1), "")
    return table(spark, d, "documents").where("text is not null and lang is not null").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("collection_id"), F.lit("first").alias("ingest_run_id"), tokens.alias("content"))


@query(f"""
WITH t AS (SELECT doc_id AS id, lang, lang = 'en' AND doc_id % 3 = 0 AS again, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
c AS (SELECT id, lang, again, CASE WHEN again THEN k || ['licensed'] ELSE k END AS k FROM t),
a AS (SELECT 'activated' AS step, id, lang = 'en' AS hit, k FROM t UNION ALL SELECT unnest(['staged', 'second run']), id, again, k FROM c
  UNION ALL SELECT unnest(['deleted', 'merged']), id, again, k FROM c WHERE again OR lang <> 'en'),
s AS (SELECT step, count(*) AS n, avg(len(k)) AS a FROM a GROUP BY step),
x AS (SELECT step, id, hit, len(k) AS size, unnest(k) AS term FROM a),
f AS (SELECT step, term, id, hit, size, count(*)::DOUBLE AS f FROM x WHERE term IN {_TERMS} GROUP BY ALL),
g AS (SELECT *, count(*) OVER (PARTITION BY step, term) AS df FROM f),
p AS (SELECT step, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / a))) AS score FROM g JOIN s USING (step) WHERE hit GROUP BY step, id)
SELECT step, id, round(score, 6) AS lexical_score, row_number() OVER (PARTITION BY step ORDER BY round(score, 9) DESC, id)::INT AS place FROM p QUALIFY place <= 30
""")
def stored_index_lifecycle(spark, d):
    """Hits after each step of an index's life; the corpus is read when it is staged only."""
    index = LexicalIndex(spark, _fresh(spark, "lexical"), {"content": 1.0}, buckets=8, id_type="long")
    terms = spark.createDataFrame(retrieval.match_terms(_TERMS), "query_id int, group_id int, term string")
    first = _chunks(spark, d)
    again = first.where("collection_id = 'en' and chunk_id % 3 = 0").withColumns({"ingest_run_id": F.lit("second"), "content": F.concat("content", F.array(F.lit("licensed")))})
    seen = []

    def look(step, state="active"):
        seen.append(index.search(terms, 1_000_000, "en", state).select(F.lit(step).alias("step"), "id", "lexical_score"))

    index.stage(first)
    index.activate("en", "first")
    look("activated")
    index.stage(again)
    look("staged", "staged")
    index.activate("en", "second")
    look("second run")
    index.delete_run("en", "first")
    look("deleted")
    index.merge()
    look("merged")
    hits = seen[0]
    for more in seen[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("step").orderBy(F.desc(F.round("lexical_score", 9)), "id")
    return hits.withColumn("place", F.row_number().over(order)).where("place <= 30").withColumn("lexical_score", six(F.col("lexical_score")))


@query("""
WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{8,}'))) AS term FROM benchmark WHERE item_id % 10 = 0),
s AS (SELECT count(*) AS n, avg(len(k)) AS a FROM t), x AS (SELECT id, len(k) AS size, unnest(k) AS term FROM t),
f AS (SELECT term, id, size, count(*)::DOUBLE AS f FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f),
p AS (SELECT query_id, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / a))) AS score FROM g JOIN q USING (term), s GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS lexical_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS place FROM p QUALIFY place <= 10
""")
def stored_index_queries(spark, d):
    """Many searches from one read of the stored postings."""
    index = LexicalIndex(spark, _fresh(spark, "lexical"), {"content": 1.0}, buckets=8, id_type="long")
    index.stage(_chunks(spark, d))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{8,}"), F.lit(0)))
    asked = table(spark, d, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), F.posexplode(words).alias("group_id", "term"))
    hits = index.search(asked, 1_000_000, state=None)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("lexical_score", 9)), "id")
    return hits.withColumn("place", F.row_number().over(order)).where("place <= 10").select("query_id", "id", six(F.col("lexical_score")).alias("lexical_score"), "place")


_EXACT = f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10
"""


def _vector_index(spark, d) -> tuple[VectorIndex, object]:
    e, q = _vectors(spark, d)
    index = VectorIndex(spark, _fresh(spark, "vectors"))
    index.fit(e.select("id", "embedding"))
    return index, q


@query(_EXACT)
def vector_index_exact(spark, d):
    """Dense search through the stored cells, proved by their angles: equal to a full scan."""
    index, q = _vector_index(spark, d)
    return index.search(q, 10, probes=4, exact=True).withColumn("score", six(F.col("score")))


@query()
def vector_index_probed(spark, d):
    """The same search in as many cells as reach a recall of 0.9 on a sample of the index, which
    the result tells beside each hit."""
    index, q = _vector_index(spark, d)
    probes, recall = index.tune(0.9)
    return index.search(q, 10).withColumns({"score": six(F.col("score")), "probes": F.lit(probes), "sample_recall": F.lit(float(recall))})
