"""Whole retrieval runs, topic evaluation and the remaining small operators."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docquarry.functions import values as V
from docquarry.operators import answering, media, relational


def unit(rng):
    return [rng.gauss(0, 1) for _ in range(8)]


def cos(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def lexical(q, t):
    q, t = ("".join(c for c in x.lower() if c.isalnum()) for x in (q, t))
    pairs = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    return 1.0 if q in t else 2 * len(pairs(q) & pairs(t)) / (len(pairs(q)) + len(pairs(t)))


@pytest.fixture(scope="module")
def run(spark):
    rng = random.Random(5)
    chunks = [(kb, doc, i, f"{kb}{doc}:{i}:x", f"r{i // 2}" if doc % 2 else None, f"content {kb} {doc} {i} " + rng.choice(["tax", "free", "policy"]) * rng.randint(1, 30), unit(rng)) for kb in (1, 2, 3) for doc in range(6) for i in range(7)]
    questions = [(q, 9 if q else 8, kb, kb, ["tax free", "policy 3"][q % 2], v) for q in range(3) for v in [unit(rng)] for kb in (1, 2)]
    kbs = [(1, 9, "one"), (2, 9, "two"), (3, 9, "three"), (1, 7, "other")]
    c = spark.createDataFrame(chunks, "kb_id int, doc_id int, chunk_index int, chunk_id string, record_id string, content string, embedding array<double>")
    q = spark.createDataFrame(questions, "query_id int, owner_id int, kb_id int, kb_order int, question string, query_vector array<double>")
    return chunks, questions, answering.prepared_chunks(c), q, spark.createDataFrame(kbs, "kb_id int, owner_id int, kb_name string")


def test_retrieve(run):
    chunks, questions, prepared, q, kbs = run
    got = {}
    for r in answering.retrieve(prepared, q, kbs, 4).orderBy("position").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    want = {}
    for qid in (1, 2):  # question 0 asks for what another owner has
        every = []
        for _, _, kb, order, text, v in [x for x in questions if x[0] == qid]:
            near = sorted(((cos(c[6], v), c) for c in chunks if c[0] == kb), key=lambda x: (-x[0], x[1][3]))[:100]
            ranked = sorted(((0.75 * s + 0.25 * lexical(text, c[5]), n, c) for n, (s, c) in enumerate(near) if s >= 0.2), key=lambda x: (-x[0], x[1]))
            seen, mine = set(), []
            for s, _, c in ranked:
                if (c[1], c[4] or c[3]) not in seen:
                    seen.add((c[1], c[4] or c[3]))
                    mine.append((-s, order, len(mine), c[3]))
            every += mine[:4]
        want[qid] = [x[3] for x in sorted(every)[:4]]
    assert got == want


def test_expand_and_answer(spark, run):
    _, _, prepared, q, kbs = run
    found = answering.retrieve(prepared, q, kbs, 3)
    out = answering.expand_context(found, prepared, q, seeds=1, most_chunks=5)
    core = {(r.query_id, r.chunk_id): r.position for r in found.collect()}
    by = {}
    for r in out.orderBy("place").collect():
        by.setdefault(r.query_id, []).append(r)
    for qid, rows in by.items():
        assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 5
        assert {(qid, r.chunk_id) for r in rows} >= {k for k in core if k[0] == qid}  # found chunks go first
        seed = next(r for r in rows if core.get((qid, r.chunk_id)) == 1)
        window = [r.chunk_index for r in rows if r.doc_id == seed.doc_id and r.kb_id == seed.kb_id and abs(r.chunk_index - seed.chunk_index) <= 1]
        assert window == sorted(window) and rows[0].chunk_index == window[0]
        assert all(r.is_neighbor == ((qid, r.chunk_id) not in core) for r in rows)
    tight = answering.expand_context(found, prepared, q, most_tokens=1)
    assert tight.groupBy("query_id").count().where("count <> 1").count() == 0
    asked = q.select("query_id", F.lit(1).alias("conv_id"), "question").distinct()
    messages = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id int, turn int, role string, text string")
    titles = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id int, title string")
    got = {r.query_id: r for r in answering.answer_prompts(messages, asked, out, titles).collect()}
    assert got[0].status == "empty" and got[0].prompt is None and len(got[1].history) == 2
    assert got[1].prompt.startswith("[ID:1] t") and got[1].prompt.endswith("用户问题: policy 3")


def test_topics(spark):
    good = {"topic_id": "t1", "question": {"text": " 这个问题是关于退税政策的吗？短。"}, "answer": {"text": "是的，退税政策可以在网上办理完成。" + "长" * 600}, "comments": [{"text": "补充"}, {"text": " "}, {}]}
    texts = spark.createDataFrame([("a", json.dumps(good)), ("b", json.dumps({"topic_id": "t2", "question": {"text": "x"}})), ("c", "no json")], "path string, value string")
    topics, skipped = answering.load_topics(texts)
    t = topics.first()
    assert (t.topic_id, t.comments) == ("t1", ["补充"]) and sorted(r.path for r in skipped.collect()) == ["b", "c"]
    atomic = answering.representations(topics, "atomic").collect()
    assert len(atomic) == 1 and atomic[0].entry.startswith("问题：\n这个问题") and len(atomic[0].entry) == 500
    entries = [r.entry for r in answering.representations(topics, "topic").orderBy("entry_no").collect()]
    assert entries == ["这个问题是关于退税政策的吗", "是的，退税政策可以在网上办理完成", "长" * 500, "长" * 100, "补充"]
    cases = {r.query_id: r.query for r in answering.query_cases(topics).collect()}
    assert cases == {"t1:q": "这个问题是关于退税政策的吗", "t1:a": "长" * 100}


def test_small_values(spark):
    r = spark.range(1).select(
        V.joined(F.array(F.lit("a"), F.lit(None))).alias("j"), V.is_safe_name(F.lit("a-b.mp4")).alias("s1"), V.is_safe_name(F.lit("../x")).alias("s2"),
        V.starts_with_array(F.lit(" \n[1]")).alias("a"), V.may(F.lit("user"), F.lit("chat:use")).alias("m1"), V.may(F.lit("user"), F.lit("kb:delete")).alias("m2"), V.may(F.lit("account_admin"), F.lit("kb:delete")).alias("m3"),
        V.allowed_transforms(F.lit("number"), F.array(F.lit("to_string"))).alias("t"), V.inferred_type(F.lit("array,scalar"), F.lit("array"), F.lit(0), F.lit(1)).alias("i"),
        V.trimmed_items(F.array(F.lit(" a "), F.lit(" "))).alias("ti"), V.captions_by_clock(F.create_map(F.lit("0:06"), F.lit(" x "), F.lit("9"), F.lit(" "))).alias("c"),
        V.labelled_sections(("A", F.lit("one")), ("B", F.lit(" ")), ("C", V.bullets(F.array(F.lit("x"), F.lit("y"))))).alias("l"), F.length(V.source_fingerprint(F.lit("https://youtu.be/abc"))).alias("f"),
    ).first()
    assert (r.j, r.s1, r.s2, r.a, r.m1, r.m2, r.m3, r.t, r.i, r.ti, r.c, r.f) == ("a, None", True, False, True, True, False, True, ["to_boolean"], "mixed", ["a"], {"00:06": "x"}, 24)
    assert r.l == "【A】\none\n\n【C】\n- x\n- y"


def test_failed_chunks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(media, "PART_ROWS", 3)
    keys = "media_id int, index int"
    res = spark.createDataFrame([(1, 0, None), (1, 1, "e"), (1, 1, None), (2, 0, "e"), (3, 0, None), (None, 0, None), (4, None, "e"), (None, 5, None)], keys + ", error string")
    plan = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 2), (None, 0), (None, 0), (5, None)], keys)
    failed = media.failed_chunks(res, plan)
    assert sorted(map(tuple, failed.collect()), key=str) == sorted([(1, 1), (2, 0), (1, 2), (None, 0), (4, None), (5, None)], key=str)
    assert "Join" not in failed._jdf.queryExecution().optimizedPlan().toString() and failed.rdd.getNumPartitions() == 5


def test_small_tables(spark):
    seg = media.transcript_segments(spark.createDataFrame([(1, "lost\n[00:05] a\n b \n\n[1:00:00] c")], "media_id int, transcript string")).orderBy("n").collect()
    assert [(r.seconds, r.text) for r in seg] == [(-1.0, "lost"), (5.0, "a b"), (3600.0, "c")]
    res = spark.createDataFrame([(1, 0, None), (1, 1, "e")], "media_id int, index int, error string")
    plan = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "media_id int, index int")
    assert sorted(r["index"] for r in media.failed_chunks(res, plan).collect()) == [1, 2]
    lib = media.library(spark.createDataFrame([("x", "v", None, "s"), ("y", "v", "t", "z")], "root string, name string, title string, summary string"), spark.createDataFrame([("x", 0), ("y", 1)], "root string, priority int"))
    assert tuple(lib.first()) == ("v", "t", "s")
    ev = relational.merge_events(spark.createDataFrame([(1, "a"), (2, "b")], "seq int, m string"), spark.createDataFrame([(2, "c")], "seq int, m string"), ["seq"])
    assert sorted(map(tuple, ev.collect())) == [(1, "a"), (2, "c")]
    uses = relational.usage_counts(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "version_id int, template_id int"), spark.createDataFrame([(1,), (1,), (2,)], "version_id int"))
    assert sorted(map(tuple, uses.collect())) == [(1, 3, 2), (2, 0, 1)]
    jobs = spark.createDataFrame([(1, "done", 0), (2, "pending", 3), (3, "pending", 0), (4, "pending", 0)], "id int, status string, attempts int")
    assert [r.id for r in relational.claimable_job(jobs).collect()] == [3]
    docs = spark.createDataFrame([(1, "done", 10, datetime(2026, 1, 1), 0, "Tax"), (2, "done", 2**21, datetime(2026, 1, 9), 3, "tax law")], "id int, status string, bytes long, created_at timestamp, chunk_count int, title string")
    now = F.lit(datetime(2026, 1, 10))
    pick = lambda **k: [r.id for r in relational.filtered_documents(docs, now, **k).orderBy("id").collect()]
    assert pick() == [1, 2] and pick(size="large") == [2] and pick(age_days=7) == [2] and pick(has_chunks=False) == [1] and pick(title="TAX", status="done") == [1, 2]
