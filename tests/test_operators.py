"""JSON mapping, retrieval parts, conversations, media, files and streams."""

import io
import json
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions import values as V
from docquarry.functions.unicode import nfkc
from docquarry.operators import chunking, conversation, evaluation, jsonmap, media, relational, retrieval
from docquarry.sources import embedding, files
from docquarry.streaming import jobs

from . import plain_splitter

# --- JSON


@pytest.mark.parametrize(("p", "spark_path", "many"), [("$", "$", False), ("$[*]", "$", True), ("$.a[0].问题[*]", '$["a"][0]["问题"]', True)])
def test_paths(p, spark_path, many):
    assert jsonmap.compile_path(p) == jsonmap.Path(spark_path, many)


@pytest.mark.parametrize("p", ["a", "$..a", "$.a[-1]", "$.a[0][1]", "$.a[*].b", "$.a[?(@.x)]", "$.a()", "$x"])
def test_bad_paths(p):
    with pytest.raises(ValueError):
        jsonmap.compile_path(p)


POSTS = [
    {"id": f"p{i}", "title": "Title", "body": "long text " * 10, "tags": ["x", "y"], "date": "2026-01-0%d" % (i + 1), "n": i + 0.5, "gone": None, "comments": [{"author": "ann", "content": "hi"}, 7, {"author": "bob", "content": "yo", "referTo": "ann"}, {"author": "cy", "referTo": "ann"}]}
    for i in range(4)
]


def test_profile_and_roles(spark):
    rows = spark.createDataFrame([(json.dumps(p),) for p in POSTS], "value string")
    p = {r.path: r for r in jsonmap.profile(rows).collect()}
    assert (p["id"].observed, p["id"].distinct_values, p["id"].uniqueness) == (4, 4, 1.0)
    assert (p["tags"].container, p["tags"].elements, p["tags"].observed) == ("array", 8, 4)
    assert (p["gone"].nulls, p["gone"].null_rate) == (4, 1.0)
    assert p["comments"].child_arrays == 4 and p["comments.author"].child_of == "comments"
    assert p["date"].datetime_rate == 1.0
    roles = {r.path: r.role for r in jsonmap.suggest_roles(jsonmap.profile(rows)).collect()}
    assert roles == {"id": "id", "title": "title", "body": "content", "tags": "keyword", "date": "timestamp", "n": "keyword", "gone": "keyword"}


def test_compatibility(spark):
    prof = lambda *v: jsonmap.profile(spark.createDataFrame([(json.dumps(x),) for x in v], "value string"))
    old = prof({"a": 1, "b": "x"})
    kind = lambda new: jsonmap.compatibility(old, new).first()
    assert kind(prof({"a": 2, "b": "y"})).kind == "identical"
    assert tuple(kind(prof({"a": 2, "b": "y", "c": 1}))) == ("compatible", ["added:c"])
    assert tuple(kind(prof({"a": [2], "c": 1}))) == ("breaking", ["added:c", "changed:a", "removed:b"])
    assert jsonmap.fingerprint(old).first() == jsonmap.fingerprint(prof({"a": 9, "b": "z"})).first()


def test_mapping(spark):
    f = jsonmap.Field
    child = jsonmap.Mapping("comment", "comments[*]", (f("author", "title"), f("content", "content"), f("referTo", "display")), relation=("referTo", "author"))
    m = jsonmap.Mapping("post", "$[*]", (f("id", "id"), f("title", "title", conditions=(("required", None),)), f("body", "content", transforms=("trim",)), f("date", "timestamp"), f("n", "filter"), f("gone", "display", transforms=("sparkle",))), (child,))
    docs = spark.createDataFrame([(json.dumps([*POSTS, {"title": " ", "date": "soon"}]),)], "value string")
    rows = jsonmap.records(docs, m.record_path)
    out = jsonmap.map_records(rows, m, "src").collect()
    good = [r for r in out if not r.rejected]
    assert len(out) == 5 and [r.record_id for r in good] == ["p0", "p1", "p2", "p3"]
    assert good[0].timestamps == {"date": "2026-01-01T00:00:00+00:00"} and good[1].filters == {"n": "1.5"} and good[0].source_pointer == "/0"
    bad = next(r for r in out if r.rejected)
    assert bad.display == {"date": "soon"} and {i.code for i in bad.issues} == {"FIELD_REQUIRED", "TIMESTAMP_UNPARSED", "UNKNOWN_TRANSFORM"} and len(bad.record_id) == 64
    kids = jsonmap.map_records(jsonmap.child_rows(jsonmap.map_records(rows, m), child), child)
    kids = kids.withColumns({"author": F.col("title"), "refer": F.element_at("display", "referTo")})
    linked = jsonmap.related_parents(kids, "refer", "author").where("parent_record_id = 'p0'").orderBy("child_index").collect()
    assert [r.child_index for r in linked] == [0, 2, 3]
    # The nearest earlier author of the last child is bob, not ann: it stays with the post.
    assert [r.parent_id for r in linked] == ["p0", linked[0].record_id, "p0"]
    with pytest.raises(ValueError):
        jsonmap.Mapping("x", "$", (f("a", "id"),)).validate()


# --- retrieval and catalog


def test_runs_and_upserts(spark):
    rows = spark.createDataFrame([("a", "c", "r1", "active"), ("b", "c", "r2", "staged"), ("x", "d", "r1", "active")], "chunk_id string, collection_id string, ingest_run_id string, state string")
    got = {r.chunk_id: r.state for r in retrieval.activate_run(rows, "c", "r2").collect()}
    assert got == {"a": "dormant", "b": "active", "x": "active"}
    again = {r.chunk_id: r.state for r in retrieval.activate_run(retrieval.activate_run(rows, "c", "r2"), "c", "r1").collect()}
    assert again == {"a": "active", "b": "dormant", "x": "active"}
    new = spark.createDataFrame([("a", "c", "r9", "staged")], rows.schema)
    assert {r.chunk_id: r.ingest_run_id for r in retrieval.upsert(rows, new, ["chunk_id"]).collect()} == {"a": "r9", "b": "r2", "x": "r1"}


def test_verify_run(spark):
    e = spark.createDataFrame([("a", "1"), ("b", "2")], "chunk_id string, digest string")
    f = spark.createDataFrame([("a", "1"), ("c", "2")], "chunk_id string, digest string")
    assert retrieval.verify_run(e, e).first().verified
    r = retrieval.verify_run(f, e).first()
    assert (r.missing, r.unexpected, r.changed, r.verified) == (1, 1, 0, False)


def test_eav_filters_refuse_and_separate_types(spark):
    rows = [("a", "n", "number", "1", 1.0, None), ("a", "b", "boolean", "true", None, None), ("b", "n", "number", "5", 5.0, None), ("c", "n", "string", "1", None, None)]
    eav = spark.createDataFrame(rows, "chunk_id string, field_name string, value_type string, normalized_value string, numeric_value double, datetime_value string")
    ids = lambda *p: sorted(r.chunk_id for r in retrieval.eav_filter(eav, p).collect())
    assert ids(("n", "in", [1, 5])) == ["a", "b"] and ids(("n", "eq", "1")) == ["c"]
    assert ids(("n", "gte", 1), ("b", "eq", True)) == ["a"] and ids(("b", "eq", 1)) == []
    for bad in ([("n", "gte", "x")], [("n", "in", [1, "a"])], [("n", "eq", 1)] * 21):
        with pytest.raises(ValueError):
            retrieval.eav_filter(eav, bad)


def test_fusion_and_rerank(spark):
    lane = lambda rows: spark.createDataFrame(rows, "query_id int, id string, rank int")
    fused = retrieval.reciprocal_rank_fusion([lane([(0, "a", 1), (0, "b", 2)]), lane([(0, "b", 1), (0, "c", 2)])])
    assert [r.id for r in fused.orderBy("position").collect()] == ["b", "a", "c"]
    scores = spark.createDataFrame([(0, "c", 0.9)], "query_id int, id string, rerank double")
    assert [r.id for r in retrieval.rerank(fused, scores, 2).orderBy("final_position").collect()] == ["c", "b"]


def test_tenants(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "000000"), (4, "t")], "i int, tenant string")
    ids = lambda t: [r.i for r in rows.where(relational.tenant_scope(F.col("tenant"), t)).collect()]
    assert ids(None) == [1, 2, 3] and ids("t") == [4]


def test_history_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"])) for c in range(60) for t in range(rng.randint(1, 9))]
    got = {(r.conv_id, r.turn) for r in conversation.truncated_history(spark.createDataFrame(rows, "conv_id int, turn int, role string"), 800).collect()}
    want = set()
    for c in range(60):
        mine, i, turns = [r for r in rows if r[0] == c], 0, []
        while i < len(mine):
            n = 2 if mine[i][2] == "user" and i + 1 < len(mine) and mine[i + 1][2] == "assistant" else 1
            turns.append(mine[i : i + n])
            i += n
        left = 800
        for t in reversed(turns):
            left -= 200 * len(t)
            if left < 0:
                break
            want |= {(c, x[1]) for x in t}
    assert got == want


# --- media


def test_captions(spark):
    vtt = "WEBVTT\n\n1\n00:01.000 --> 00:02.500\n<b>Hello</b>\n\n00:02.500 --> 00:04.000\nHello world\n\n01:00:04.000 --> 01:00:05.000\nHello world\n\nnote"
    got = [tuple(r) for r in media.caption_cues(spark.createDataFrame([(1, vtt)], "media_id int, vtt string")).orderBy("start").collect()]
    assert got == [(1, 1.0, 2.5, "Hello"), (1, 2.5, 4.0, "world")]


def test_coverage_and_ranges(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 20.0), (1, 40.0, 95.0), (2, 0.0, 5.0)], "m int, start double, end double")
    long = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 50.0)], "m int, duration double")
    merged = media.merged_intervals(rows, "m")
    ratios = media.coverage(merged, "m", long)
    assert {r.m: r.ratio for r in ratios.collect()} == {1: 0.75, 2: 0.05, 3: 0.0}
    open_gaps = media.gaps(merged, "m", long)
    assert sorted(map(tuple, open_gaps.collect())) == [(1, 20.0, 40.0), (1, 95.0, 100.0), (2, 5.0, 100.0), (3, 0.0, 50.0)]
    assert sorted(map(tuple, media.speech_ranges(open_gaps, ratios, "m", long, 0.7).collect())) == [(1, 20.0, 40.0), (2, 0.0, 100.0), (3, 0.0, 50.0)]


def test_speech_chunks(spark):
    rows = spark.createDataFrame([(1, 400.0, [130.0, 149.0, 290.0]), (2, 100.0, None), (3, 0.0, [1.0])], "media_id long, duration double, silences array<double>")
    got = [tuple(r) for r in media.speech_chunks(rows).orderBy("media_id", "index").collect()]
    assert got == [(1, 0, 0.0, 150.5), (1, 1, 147.5, 291.5), (1, 2, 288.5, 400.0), (2, 0, 0.0, 100.0)]


def test_frames_and_samples(spark):
    frames = spark.createDataFrame([(1, i, bytes([v] * 4)) for i, v in enumerate([0, 1, 2, 3, 5, 5])], "media_id long, n long, thumb binary")
    assert [r.n for r in media.distinct_frames(frames).orderBy("n").collect()] == [0, 3]
    for count in (1, 4, 5, 6, 13, 50):
        rows = spark.range(count).withColumn("k", F.lit(0))
        even = [r.id for r in media.even_sample(rows, "k", "id", 5).orderBy("id").collect()]
        assert even == (list(range(count)) if count <= 5 else [round(i * (count - 1) / 4) for i in range(5)])
        strided = [r.id for r in media.strided_sample(rows, "k", "id", 4).orderBy("id").collect()]
        assert strided == (list(range(count)) if count <= 4 else [int(i * count / 4) for i in range(4)])


def test_transcripts(spark):
    times = spark.range(1).select(F.explode(media.sentence_times(F.array(F.lit("ab"), F.lit("cdefgh")), F.lit(10.0), F.lit(100.0))).alias("x")).select("x.*").collect()
    assert [(r.seconds, r.text) for r in times] == [(27.5, "ab"), (77.5, "cdefgh")]
    e = spark.createDataFrame([(1, 65.0, "b"), (1, 2.0, "a")], "m int, seconds double, text string")
    assert media.merge_transcript(e, "m").first().transcript == "[00:02] a\n\n[01:05] b"
    schema = "media_id int, index int, text string, error string, seconds double, attempts int"
    old = spark.createDataFrame([(1, 0, "ok", None, 1.0, 1), (1, 1, None, "e", 1.0, 1)], schema)
    new = spark.createDataFrame([(1, 0, None, "e", 2.0, 1), (1, 1, "fixed", None, 2.0, 1), (1, 2, "new", None, 2.0, 1)], schema)
    got = sorted((r["index"], r.text, r.seconds, r.attempts) for r in media.merge_resumed(old, new).collect())
    assert got == [(0, "ok", 1.0, 1), (1, "fixed", 3.0, 2), (2, "new", 2.0, 1)]


# --- evaluation


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, item string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "z"), (2, "x")], "query_id int, item string")
    cases = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, kind string")
    got = {r.kind: (r.recall, r.precision, r.top1, r.mrr) for r in evaluation.retrieval_metrics(ranked, relevant, cases, 2).collect()}
    assert got == {"q": (0.5, 0.5, 0.0, 0.5), "r": (0.0, 0.0, 0.0, 0.0), None: (0.25, 0.25, 0.0, 0.25)}


# --- files and streams


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb\r".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    got = {r.path[-5:]: (r.text, r.error) for r in files.read_text(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a.txt": ("é\nb\n", None), "b.txt": (None, "TXT_INVALID_ENCODING")}
    data = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>t</w:t><w:t>wo</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    docx = files.read_docx(spark, str(tmp_path / "*.docx")).orderBy("path", "section").collect()
    assert [r.text for r in docx] == ["one", "two", None] and docx[2].error == "DOCX_INVALID: BadZipFile"
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [(r.line, r.value) for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()] == [(1, '{"a": 1}'), (2, '{"a": 2}')]
    (tmp_path / "a.json").write_text('{"posts": [{"x": 1}, {"x": 2}]}')
    assert [r.source_pointer for r in jsonmap.records(files.read_json(spark, str(tmp_path / "a.json")), "$.posts[*]").collect()] == ["/posts/0", "/posts/1"]
    (tmp_path / "c.json").write_text('[{"x": 1}')
    with pytest.raises(Exception, match="malformed|MALFORMED"):
        jsonmap.records(files.read_json(spark, str(tmp_path / "c.json")), "$[*]").collect()
    with pytest.raises(ValueError):
        files.reader_for("x.pdf")
    assert files.reader_for("X.MD") == "text"


def test_artifacts_and_cache(spark, tmp_path):
    good, bad = spark.range(5), spark.range(2)
    m = files.write_artifacts(good, bad, str(tmp_path / "out")).first()
    assert (m.n_records, m.n_mapping_errors) == (5, 2)
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    cache = files.missing_embeddings(texts.where("text = 'a'"), spark.createDataFrame([], "key string"), "m")
    assert [r.text for r in files.missing_embeddings(texts, cache, "m").collect()] == ["b"]


def test_streams(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    sink = lambda df, n: seen.extend(sorted(r.text for r in df.collect()))
    for name in ("a", "b"):
        (source / name).write_text(f"{name}\r\n")
        jobs.ingest(spark, str(source), str(tmp_path / "check"), sink).awaitTermination(60)
    assert seen == ["a\n", "b\n"]
    at = datetime(2026, 1, 1)
    rows = [(at + timedelta(seconds=s), "u", f"n{s % 4}") for s in range(8)]
    spark.createDataFrame(rows, "ts timestamp, user string, nonce string").write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema("ts timestamp, user string, nonce string").parquet(str(tmp_path / "events"))
    for name, df, mode in (("once", jobs.without_replays(events, ["nonce"]), "append"), ("fails", jobs.failures_per_minute(events, "user"), "complete"), ("sess", jobs.sessions(events, "user"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(90)
    assert spark.table("once").count() == 4
    assert spark.table("fails").agg(F.max("failures")).first()[0] == 8
    assert [r.events for r in spark.table("sess").collect()] == [8]


def test_mapping_of_lists_and_containers(spark):
    rows = [
        ("$/0", '{"id": 7, "tags": ["a", " ", "b", "a"], "many": [1, 2, 2], "box": {"x": 1}, "deep": [{"y": 1}], "on": true, "body": "one\\nchild\\ntwo", "n": ["1"]}', ["child", " "]),
        ("$/1", '{"id": "8", "tags": "single", "many": 5, "box": null, "deep": [], "on": false, "body": " ", "n": "1"}', []),
    ]
    df = spark.createDataFrame(rows, "source_pointer string, value string, echo array<string>").withColumn("record", F.parse_json("value"))
    fields = (
        jsonmap.Field("id", "id"), jsonmap.Field("tags", "keyword"), jsonmap.Field("tags", "display", name="line", transforms=("deduplicate", "join")), jsonmap.Field("many", "filter"), jsonmap.Field("box", "filter"),
        jsonmap.Field("deep", "filter"), jsonmap.Field("box", "display", name="shown"), jsonmap.Field("on", "display", name="word", transforms=("to_string",)), jsonmap.Field("body", "content", transforms=("remove_child_echo",)),
    )
    mapping = jsonmap.Mapping("post", "$[*]", fields)
    got = {r.record_id: r for r in jsonmap.map_records(df, mapping, echoes="echo").collect()}
    assert got["7"].keywords == ["a", "b", "a"] and got["8"].keywords == ["single"]
    assert got["7"].filters == {"many": '["1","2","2"]'} and got["8"].filters == {"many": "5", "deep": "[]"}
    assert [(i.code, i.field) for i in got["7"].issues] == [("FILTER_TYPE_MISMATCH", "box"), ("FILTER_TYPE_MISMATCH", "deep")] and not got["8"].issues
    assert got["7"].display == {"line": "a,  , b", "shown": '{"x":1}', "word": "True"} and got["8"].display["word"] == "False"
    assert got["7"].content == "one\ntwo" and got["8"].content == ""
    strict = jsonmap.Mapping("post", "$[*]", (jsonmap.Field("body", "content"), jsonmap.Field("n", "filter", transforms=("to_number",))))
    assert {r.source_pointer: r.rejected for r in jsonmap.map_records(df, strict).collect()} == {"$/0": True, "$/1": False}


def test_scalar_records_are_wrapped(spark):
    df = spark.createDataFrame([('["a", 2, {"k": 1}]',)], "value string")
    got = [str(r.record) for r in jsonmap.records(df, "$[*]").select(F.to_json("record").alias("record")).collect()]
    assert got == ['{"value":"a"}', '{"value":2}', '{"k":1}']


def test_json_with_a_second_value_fails(spark, tmp_path):
    (tmp_path / "good.json").write_text(' {"a": [1, 2]} \n')
    assert [r.value.strip() for r in files.read_json(spark, f"{tmp_path}/good.json").collect()] == ['{"a": [1, 2]}']
    for bad in ('{"a":1}{"b":2}', '{"a":1},{"b":2}', "1 2", "[1] x"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="(?i)malformed"):
            files.read_json(spark, f"{tmp_path}/bad.json").collect()


def test_jsonl_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f'{{"n": {i}}}' + ("\n" if i % 7 == 0 else "") for i in range(3000)]  # some blank lines
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.read_jsonl(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line, r.value) for r in got) == [(i + 1, f'{{"n": {i}}}') for i in range(3000)]


def test_filter_values_are_folded_and_in_utc(spark):
    rows = [("string", "Ａb①", "Ab1"), ("datetime", "2024-01-01T08:00:00+08:00", "2024-01-01T00:00:00+00:00"), ("datetime", "2024-01-01 08:00:00", "2024-01-01T08:00:00+00:00"), ("number", "1.500", "1.5"), ("boolean", "True", "true"), ("null", None, "")]
    df = spark.createDataFrame(rows, "kind string, v string, want string")
    got = df.select("want", V.filter_value(F.col("kind"), F.col("v"), nfkc(F.col("v"))).normalized_value.alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_embedding_in_batches_with_retries(spark, tmp_path):
    flag = tmp_path / "failed"

    def embedder(texts):
        assert len(texts) <= 64
        if not flag.exists():
            flag.write_text("once")
            raise embedding.Retryable
        return [(float(t), 1.0) for t in texts]

    texts = spark.range(150).select(F.col("id").cast("string").alias("text")).coalesce(1)
    embedding.WAIT, wait = 0.01, embedding.WAIT
    try:
        got = embedding.embed(texts, embedder, dimension=2).collect()
    finally:
        embedding.WAIT = wait
    assert all(r.embedding == [float(r.text), 1.0] for r in got) and len(got) == 150
    with pytest.raises(Exception, match="does not have 3 numbers"):
        embedding.embed(texts, embedder, dimension=3).collect()


def test_sentences_and_units_follow_their_marks(spark):
    cases = {"One. Two!\nthree 3.5 four? 五。六": ["One.", "Two!", "three 3.5 four?", "五。", "六"], "! a. b": ["! a.", "b"], "...": ["..."], "": [""], "a.b.c": ["a.b.c"], "x; y；z": ["x;", "y；", "z"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.s for r in df.select("t", T.sentences(F.col("t")).alias("s")).collect()}
    assert got == cases
    assert list(plain_splitter.units("alpha; beta gamma; delta")) == ["alpha; beta gamma; delta"]


def test_search_filters_come_before_the_limit(spark):
    rows = [(i, ["tax"] * (5 - i % 5), "a" if i % 2 else "b", "active" if i < 8 else "dormant", f"r{i % 3}") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, content array<string>, collection_id string, state string, ingest_run_id string")
    terms = spark.createDataFrame([(0, 0, "tax")], "query_id int, group_id int, term string")
    ids = lambda **k: {r.id for r in retrieval.bm25(df, terms, {"content": 1.0}, 2, **k).collect()}
    assert len(ids()) == 2
    assert ids(collection="a", state="active") <= {1, 3, 5, 7} and len(ids(collection="a", state="active")) == 2
    assert ids(runs=["r1"], collection="b") == {4} and ids(runs=[]) == set()
    few = spark.createDataFrame([(2,), (9,)], "id long")
    assert ids(ids=few) == {2, 9} and ids(ids=few.limit(0)) == set() and ids(ids=few, state="active") == {2}


def test_long_tables_keep_every_row():
    rows = ["| a | b |", "| 1 | short |", "| 2 | " + "x" * 400 + " |", "| 3 | c |", "| 4 | d |"]
    out = plain_splitter.long_table("\n".join(rows), 40)
    assert all(any(r in part for part in out) for r in rows) and all(part.startswith(rows[0]) for part in out)
    ruled = [rows[0], "|---|---|", *(f"| {i} | {'y' * 30} |" for i in range(20))]
    parts = plain_splitter.long_table("\n".join(ruled), 60)
    assert [x for p in parts for x in p.split("\n")[2:]] == ruled[2:] and all(sum(map(plain_splitter.tokens, p.split("\n"))) <= 60 for p in parts)


def test_speech_chunks_of_ranges(spark):
    m = spark.createDataFrame([(1, 1000.0, [100.0, 430.0, 585.0, 700.0])], "media_id long, duration double, silences array<double>")
    r = spark.createDataFrame([(1, 300.0, 650.0), (1, 0.0, 90.0), (1, 700.0, 700.0)], "media_id long, start double, end double")
    got = sorted((c["index"], c.start, c.end) for c in media.speech_chunks_of(r, m).collect())
    assert got == [(0, 0.0, 90.0), (1, 300.0, 431.5), (2, 428.5, 586.5), (3, 583.5, 650.0)]
