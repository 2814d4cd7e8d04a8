"""The stored lexical and vector indexes."""

import random
import sqlite3
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import retrieval
from docquarry.operators.lexical_index import LexicalIndex
from docquarry.operators.vector_index import VectorIndex
from docquarry.sources.segments import Conflict, Log

WORDS = ["sku", "ab12", "tax", "free", "policy", "note", "zz"]
CHUNKS = "chunk_id string, collection_id string, ingest_run_id string, title array<string>, content array<string>"


class Plain:
    """The same index in SQLite's full-text search."""

    def __init__(self):
        self.rows = {}

    def search(self, match, collection, state="active"):
        con = sqlite3.connect(":memory:")
        con.execute("create virtual table f using fts5(i unindexed, title, content)")
        con.executemany("insert into f values (?, ?, ?)", [(i, " ".join(r[3]), " ".join(r[4])) for i, r in self.rows.items()])
        found = con.execute("select i, bm25(f, 0, 5, 1) from f where f match ?", (match,)).fetchall()
        return {i: -s for i, s in found if self.rows[i][0] == collection and self.rows[i][2] == state}


@pytest.fixture
def index(spark, tmp_path):
    return LexicalIndex(spark, f"file://{tmp_path}/index", {"title": 5.0, "content": 1.0}, buckets=4)


def test_index_follows_sqlite_through_its_life(spark, index):
    rng, plain = random.Random(4), Plain()
    terms = spark.createDataFrame(retrieval.match_terms(["sku-ab12", "tax", "policy"]), "query_id int, group_id int, term string")

    def stage(ids, collection, run):
        rows = [(i, collection, run, [rng.choice(WORDS) for _ in range(rng.randint(0, 3))], [rng.choice(WORDS) for _ in range(rng.randint(0, 9))]) for i in ids]
        index.stage(spark.createDataFrame(rows, CHUNKS))
        for r in rows:
            state = next((s for c, x, s in index.runs() if (c, x) == (collection, run)), "staged")
            plain.rows[r[0]] = (collection, run, state, r[3], r[4])

    def set_states(collection):
        for i, r in plain.rows.items():
            plain.rows[i] = (*r[:2], next(s for c, x, s in index.runs() if (c, x) == r[:2]), *r[3:])

    def agree(collection="a", state="active"):
        want = plain.search("(sku ab12) OR tax OR policy", collection, state)
        got = {r.id: r.lexical_score for r in index.search(terms, 100, collection, state).collect()}
        assert got == pytest.approx(want)
        return len(got)

    stage([f"x{i}" for i in range(30)], "a", "r1")
    assert agree() == 0 and agree(state="staged") > 5
    index.activate("a", "r1")
    set_states("a")
    assert agree() > 5
    stage([f"x{i}" for i in range(20, 45)], "a", "r2")  # ten chunks move to the new run
    stage([f"y{i}" for i in range(10)], "b", "r1")
    set_states("a")
    assert agree() > 5 and agree(state="staged") > 5 and agree("b", "staged") > 0
    index.activate("a", "r2")
    set_states("a")
    assert index.runs() == [("a", "r1", "dormant"), ("a", "r2", "active"), ("b", "r1", "staged")]
    assert agree() > 5 and agree(state="dormant") > 5
    index.delete_run("a", "r1")
    plain.rows = {i: r for i, r in plain.rows.items() if r[:2] != ("a", "r1")}
    before = agree()
    index.delete_run("a", "r1")
    assert agree() == before
    index.delete_chunks(spark.createDataFrame([("x30",), ("none",)], "chunk_id string"))
    del plain.rows["x30"]
    agree()
    index.merge()
    agree()
    again = LexicalIndex(spark, index.store.path)  # opened anew: settings come from the log
    assert again.weights == {"title": 5.0, "content": 1.0} and again.store.state()[1]["gone_rows"] == 0
    expected = again.run_rows("a", "r2")
    assert retrieval.verify_run(again.run_rows("a", "r2"), expected).first().verified
    both = [(q, g, t) for q, found in ((1, ["tax"]), (2, ["policy", "note"])) for _, g, t in retrieval.match_terms(found)]
    hits = again.search(spark.createDataFrame(both, "query_id int, group_id int, term string"), 5, "a")
    assert {r.query_id for r in hits.collect()} == {1, 2}


def test_search_opens_only_its_buckets(spark, index):
    index.stage(spark.createDataFrame([("1", "a", "r", ["tax"], WORDS), (None, "a", "r", [], ["tax"])], CHUNKS))
    index.activate("a", "r")
    hits = index.search(spark.createDataFrame([(0, 0, "tax")], "query_id int, group_id int, term string"), 5, "a")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0] and "EqualTo(term,tax)" in plan.replace("In(term, [tax])", "EqualTo(term,tax)")
    assert [r.id for r in hits.collect()] == ["1"]


def test_postings_are_stored_in_blocks(spark, index, monkeypatch):
    from docquarry.operators import postings

    monkeypatch.setattr(postings, "GATHERED", 300)  # several gatherings, one row larger than that
    monkeypatch.setattr(postings, "BLOCK", 7)
    rng = random.Random(5)
    some = lambda n: [rng.choice([*WORDS, None]) for _ in range(n)]
    rows = [(f"x{i}", rng.choice("ab"), rng.choice(["r", None]), some(rng.randint(0, 3)), some(rng.choice([0, 9, 90])) + ["tax"]) for i in range(120)]
    chunks = spark.createDataFrame([*rows, ("none", "a", "r", None, ["tax"]), ("empty", "a", "r", [], []), ("long", "a", "r", [], ["zz"] * 400)], CHUNKS)
    want = retrieval.lexical_index(chunks.withColumnRenamed("chunk_id", "id"), index.weights, ("collection_id", "ingest_run_id")).where("term is not null and size is not null")
    want = sorted(map(tuple, want.select("term", "id", "size", "collection_id", "ingest_run_id", "f").collect()), key=str)
    index.stage(chunks)
    for _ in range(2):
        stored = index.store.read(index.store.state()[1], "postings", index.postings_schema)
        got = postings.opened(stored).where("size is not null").select("term", "chunk_id", "size", "collection_id", "ingest_run_id", "f").collect()
        assert sorted(map(tuple, got), key=str) == want
        assert stored.count() < len(want) * 0.7 and stored.selectExpr("max(size(postings))").first()[0] == 7
        assert sorted(r.chunk_id for r in index._rows(index.store.state()[1]).collect()) == sorted([*(r[0] for r in rows), "none", "empty", "long"])
        index.merge()


def test_empty_index_and_conflicts(spark, index, tmp_path):
    terms = spark.createDataFrame([(0, 0, "tax")], "query_id int, group_id int, term string")
    assert index.search(terms, 5).collect() == []
    index.activate("a", "r")
    log = Log(spark, f"file://{tmp_path}/log-only")
    log.commit({"a": 1}, -1)
    with pytest.raises(Conflict):
        log.commit({"a": 2}, -1)
    assert log.read() == {"a": 1} and log.version() == 0


# --- dense vectors


def clustered(n, dims, seed=1, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    return (centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dims))).tolist()


def best_plain(vectors, query, k):
    length = lambda v: float(np.sqrt(np.dot(v, v)))
    score = {i: float(np.dot(v, query)) / (length(v) * length(query)) if length(v) * length(query) else 0.0 for i, v in vectors.items()}
    return sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]


def test_vector_index(spark, tmp_path):
    vectors = dict(enumerate(clustered(1500, 16)))
    vectors[5000] = [0.0] * 16
    frame = lambda v: spark.createDataFrame(list(v.items()), "id long, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/vectors")
    index.fit(frame(vectors), cells=24, most_sample=500)
    asked = {i: vectors[i] for i in range(0, 1500, 50)}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query_vector array<double>")

    def found(**how):
        out = defaultdict(list)
        for r in index.search(queries, 10, **how).orderBy("query_id", "rank").collect():
            out[r.query_id].append(r.id)
        return out

    want = {q: best_plain(vectors, v, 10) for q, v in asked.items()}
    assert found(exact=True, probes=1) == want
    probes, recall = index.tune(0.95)
    assert 1 <= probes < 24 and recall >= 0.95
    some = found()
    assert sum(len(set(some[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)
    # Added, replaced, deleted and merged vectors.
    more = dict(enumerate(clustered(100, 16, seed=3), start=1450))
    index.add(frame(more))
    index.delete(spark.createDataFrame([(i,) for i in range(100)], "id long"))
    vectors = {i: v for i, v in (vectors | more).items() if i >= 100}
    want = {q: best_plain(vectors, v, 10) for q, v in asked.items()}
    assert found(exact=True) == want
    index.merge()
    assert found(exact=True) == want and index.store.state()[1]["gone_rows"] == 0
    plan = index.search(queries.limit(1), 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "BroadcastHashJoin" in plan
    with pytest.raises(ValueError):
        index.fit(frame(more))


def test_vector_index_needs_vectors(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorIndex(spark, f"file://{tmp_path}/none").fit(spark.createDataFrame([(1, [0.0, 0.0])], "id long, embedding array<double>"))
