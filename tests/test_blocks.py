"""Dense search in blocks against the cosine of every pair."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.operators import blocks, retrieval
from docquarry.plans.catalog import QUERIES

V = "id long, embedding array<double>, kb int"


def odd_vectors(seed=3):
    rng = random.Random(seed)
    vector = lambda n=6: [rng.gauss(0, 1) for _ in range(n)]
    rows = [vector() for _ in range(300)] + [None, [], [0.0] * 6, [1.0, None] + [0.5] * 4, [math.nan] + [1.0] * 5, [math.inf] + [1.0] * 5, [1e-200] * 6, [1e200] * 6, [-0.0] * 6, *(vector(4) for _ in range(5))]
    copied = vector()
    rows += [copied] * 40 + [[x * 3 for x in copied]] * 5
    rng.shuffle(rows)
    return [(i, v, rng.choice([1, 2, 3])) for i, v in enumerate(rows)]


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(blocks, "MATRIX", 1000)
    monkeypatch.setattr(blocks, "PAIRS", 50)


@pytest.mark.parametrize(("group", "threshold"), [((), None), ((), 0.2), (("kb",), None), (("kb",), 0.3)])
def test_equals_the_cosine_of_every_pair(spark, tiny, group, threshold):
    v = spark.createDataFrame(odd_vectors(), V)
    q = v.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"), *group)
    v = v if group else v.drop("kb")
    w = Window.partitionBy("query_id", *group).orderBy(F.desc("score"), "id")
    rank = lambda df: {(r.query_id, r.rank): (r.id, str(r.score)) for r in df.withColumn("rank", F.row_number().over(w)).where("rank <= 12").collect()}
    every = (v.join(q, list(group)) if group else v.crossJoin(q)).withColumn("score", retrieval.cosine(F.col("embedding"), F.col("query_vector")))
    want = rank(every if threshold is None else every.where(F.col("score") >= threshold))
    got = rank(blocks.best_by_cosine(v, q, 12, group, threshold))
    assert {k: (i, s.replace("-0.0", "0.0")) for k, (i, s) in got.items()} == {k: (i, s.replace("-0.0", "0.0")) for k, (i, s) in want.items()}


def test_wanted_parts(spark, tiny):
    v = spark.createDataFrame(odd_vectors(4), V)
    q = v.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    wanted = q.select("query_id", F.explode(F.when(F.col("query_id") % 2 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(2)))).alias("kb"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rank = lambda df: {(r.query_id, r.rank): (r.id, r.kb) for r in df.withColumn("rank", F.row_number().over(w)).where("rank <= 9").collect()}
    every = v.join(wanted, "kb").join(q, "query_id").withColumn("score", retrieval.cosine(F.col("embedding"), F.col("query_vector")))
    assert rank(blocks.best_by_cosine(v, q, 9, ["kb"], wanted=wanted)) == rank(every)


def test_more_queries_than_a_broadcast_takes(spark):
    """10,001 queries were refused before; each block passes on its best rows only."""
    v = spark.range(2000).select("id", F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    q = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.sin("id"), F.cos("id")).alias("query_vector"))
    hits = retrieval.dense_search(v, q, 1)
    assert hits.where("rank = 1").count() == 10_001
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "aggregate(zip_with" not in plan


def test_collections_merge_without_scoring_rows_one_by_one(spark):
    plan = QUERIES["vector_multi_collection_merge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "aggregate(zip_with" not in plan


@pytest.mark.parametrize("name", ["vector_index_exact", "vector_index_probed"])
def test_cells_meet_queries_in_blocks(spark, name):
    assert "FlatMapCoGroupsInArrow" in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_only_candidates_meet_their_texts(spark):
    """Texts were carried through the ranking of all pairs before."""
    plan = QUERIES["retrieve_and_expand"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "LeftSemi" in plan


def test_hybrid_rank_asks_only_what_has_a_text(spark):
    plan = QUERIES["hybrid_rank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "LeftSemi" in plan
