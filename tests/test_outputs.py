"""Citations, upload sink, library scan and the tables that a run leaves."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from docquarry.functions.citations import citation_numbers
from docquarry.functions import values as V
from docquarry.operators import outputs, relational, retrieval
from docquarry.sources import library, uploads

CITED = [
    ("a [2]【1】 [9] [2]", [2, 1, 2]), ("[1##2#] 【3##1#】 [1##9#] [2#", [1, 2, 3, 1, 2]), ("<b>[1]</b>[2]", [2]), ("<b>[1] [2]", [1, 2]), ("<b a='>[1]'>[2]</b>", []),
    ("<i><i>[1]</i>[2]</i>[3]", [3]), ("<br>[1]<img/>[2]</p>[3]", [1, 2, 3]), ("<i><b>[1]</i>[2]</b>", [2]), ("<!-- [1] --> [2] <!-- [3]", [2]), ("`[1]` ```\n[2]\n``` [3]", [3]),
    ("[x [1]](http://a/[2]) [3]", [3]), ("http://a/[1] [2]", [2]), ("1 < 2 [1] <2 [3]>", [1, 3]), ("<a [1", []), ("[0] [4] [] [x]", []), ("[99999999999]", []), ("", []), (None, None), ("<div/ >[1]", [1]),
]


def test_citations_outside_of_protected_spans(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CITED)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", citation_numbers(F.col("t"), F.lit(3)).alias("c")).collect()}
    assert [(CITED[i][0], got[i]) for i in got] == [(t, w) for t, w in CITED]
    long = spark.createDataFrame([("<p>x [1] y " * 20000 + "[2]",)], "t string").select(F.size(citation_numbers(F.col("t"), F.lit(3))).alias("n")).first()
    assert long.n == 20001


def test_uploads(spark, tmp_path):
    root = str(tmp_path / "store")
    assert uploads.committed_uploads(spark, root).count() == 0
    rows = [("a.md", b"one"), ("b.MD", b"two"), ("copy.md", b"one"), ("noext", b""), ("../../evil.t/x", b"x" * 10), ("big.txt", b"y" * 3_000_000), ("huge.txt", b"z" * 5_000_000), ("gone.txt", None), ("a.md", b"one")]
    uploads.write_uploads(spark.createDataFrame(rows, "name string, content binary").repartition(3), root, most_bytes=4_000_000)
    got = uploads.committed_uploads(spark, root).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.error is None:
            data = (tmp_path / "store/blobs" / r.stored).read_bytes()
            assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.bytes and r.stored.startswith(f"{r.sha256[:2]}/{r.sha256[2:4]}/{r.sha256}.")
    assert {(r.name, r.error) for r in got if r.error} == {("huge.txt", "FILE_TOO_LARGE"), ("gone.txt", "FILE_MISSING")}
    assert len({r.stored for r in got if r.sha256 == hashlib.sha256(b"one").hexdigest()}) == 1
    assert sorted(bytes(r.content)[:3] for r in uploads.stored_contents(spark, root).collect()) == [b"", b"one", b"two", b"xxx", b"yyy"]


def test_a_failed_upload_shows_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    uploads.write_uploads(spark.createDataFrame([("a.md", b"one")], "name string, content binary"), root)
    bad = spark.range(40, numPartitions=4).select(F.format_string("%d.md", "id").alias("name"), F.when(F.col("id") < 35, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("broken")).cast("string")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        uploads.write_uploads(bad, root)
    assert [r.name for r in uploads.committed_uploads(spark, root).collect()] == ["a.md"]
    assert [bytes(r.content) for r in uploads.stored_contents(spark, root).collect()] == [b"one"]
    assert not [f for f in (tmp_path / "store/manifests").rglob(".*")]
    assert uploads.unreferenced(spark, root).count() <= 35


def test_library_scan(spark, tmp_path):
    def item(root, name, **files):
        at = tmp_path / root / name
        (at / "frames").mkdir(parents=True)
        for f, text in files.items():
            (at / f.replace("__", ".")).write_text(text if isinstance(text, str) else json.dumps(text))

    item("one", "v1", manifest__json={"source": "https://youtu.be/x", "created_at": "2026-01-02", "report": {"title": "T", "duration_seconds": 5, "keyframes": [{"path": "k.jpg"}]}, "transcript": "said"}, summary__json={"summary": "S", "keypoints": ["a"], "title_override": "O"})
    item("one", "v2", report__html="x", transcript__txt="from file")
    item("one", "empty")
    item("one", ".hidden", report__html="x")
    item("one", "broken", manifest__json="{nope", summary__json="[1]")
    (tmp_path / "one/broken/frames/b.jpg").write_text("")
    (tmp_path / "one/latest").symlink_to(tmp_path / "nowhere")
    (tmp_path / "one/link").symlink_to(tmp_path / "one/v1")
    item("two", "v1", manifest__json={"source": "other"})
    item("two", "empty", report__html="x")
    item("two", "v3", manifest__json={"report": {"title": "M"}})
    (tmp_path / "states").mkdir()
    (tmp_path / "states/v3.json").write_text(json.dumps({"source": "/a/b.mp4", "created_at": "2026-03-03", "transcript": "st", "report": {"duration_seconds": 9}, "summary": {"summary": "ss", "keypoints": ["k"]}}))
    (tmp_path / "states/v1.json").write_text(json.dumps({"source": "not used", "summary": {"title_override": "no"}}))
    got = {r.name: r for r in library.items(library.scan(spark, [str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "none")], str(tmp_path / "states"), size=2)).collect()}
    assert sorted(got) == ["broken", "v1", "v2", "v3"]
    r = got["v1"]
    assert (r.title, r.source, r.source_kind, r.created_at, r.duration_seconds, r.summary, r.keypoints, r.transcript, r.frames, r.root) == ("O", "https://youtu.be/x", "youtube", "2026-01-02", 5.0, "S", ["a"], "said", ["k.jpg"], str(tmp_path / "one"))
    assert (got["v2"].title, got["v2"].transcript, got["v2"].has_report, got["v2"].source_kind) == ("v2", "from file", True, "local")
    r = got["v3"]
    assert (r.title, r.source, r.created_at, r.duration_seconds, r.summary, r.keypoints, r.transcript) == ("M", "/a/b.mp4", "2026-03-03", 9.0, "ss", ["k"], "st")
    assert got["broken"].title == "broken" and [os.path.basename(f) for f in got["broken"].frames] == ["b.jpg"]
    assert library.scan(spark, [str(tmp_path / "none")]).count() == 0


ASK = "query_id int, conv_id int, owner_id int, kb_id int, kb_order int, question string"


def test_run_outputs_are_written_once(spark, tmp_path):
    root, inbox = str(tmp_path / "out"), tmp_path / "in"
    history = spark.createDataFrame([(1, 0), (1, 1)], "conv_id int, turn int")

    def answer(batch):
        q = batch.select("query_id").distinct()
        context = q.where("query_id <> 12").select("query_id", F.lit(1).alias("place"), F.lit("c").alias("chunk_id"), F.lit(3).alias("doc_id"), F.lit(5).alias("kb_id"), F.lit("x" * 600).alias("content"), F.lit(0.5).alias("score"))
        return context, q.where("query_id <> 13").select("query_id", F.lit("yes").alias("answer"), F.when(F.col("query_id") == 11, "BUSY").alias("error_code"))

    def ask(*rows):
        spark.createDataFrame(rows, ASK).coalesce(1).write.mode("append").json(str(inbox))
        outputs.answer_stream(spark.readStream.schema(ASK).json(str(inbox)), history, answer, root, str(tmp_path / "cp")).awaitTermination()

    ask((10, 1, 7, 5, 1, "q10"), (10, 1, 7, 4, 0, "q10"), (11, 1, 7, 5, 0, "q11"))
    ask((12, 1, 7, 5, 0, "q12"), (13, 2, 7, 5, 0, "q13"))
    m = read(spark, root, "messages")
    assert sorted((r.conv_id, r.sequence, r.role, r.content, r.status, r.error_code, r.tokens_used) for r in m) == sorted([
        (1, 2, "user", "q10", "completed", None, None), (1, 3, "assistant", "yes", "completed", None, 3), (1, 4, "user", "q11", "completed", None, None), (1, 5, "assistant", None, "failed", "BUSY", None),
        (1, 6, "user", "q12", "completed", None, None), (1, 7, "assistant", outputs.NOTHING_FOUND, "completed", None, len(outputs.NOTHING_FOUND)),
        (2, 0, "user", "q13", "completed", None, None), (2, 1, "assistant", None, "failed", "NO_ANSWER", None),
    ], key=lambda t: t[:2])
    assert [(len(r.snippet), r.doc_id) for r in read(spark, root, "references")] == [(500, 3)]
    logs = {r.query_id: r for r in read(spark, root, "logs")}
    assert [(i, logs[i].result_status, logs[i].chunks_count, logs[i].kb_id) for i in sorted(logs)] == [(10, "success", 1, 4), (11, "error", 0, 5), (12, "empty", 0, 5), (13, "error", 0, 5)]
    # The batches are replayed from a lost checkpoint, then a table of a failed batch lies there without its entry.
    outputs.answer_stream(spark.readStream.schema(ASK).json(str(inbox)), history, answer, root, str(tmp_path / "cp2")).awaitTermination()
    spark.createDataFrame([r.asDict() for r in m], "conv_id int, message_id string, role string, content string, status string, error_code string, sequence long, tokens_used int").write.parquet(f"{root}/messages/batch=77")
    assert sorted(r.message_id for r in read(spark, root, "messages")) == sorted(r.message_id for r in m) and len(read(spark, root, "logs")) == 4


def read(spark, root, name):
    return outputs.read_outputs(spark, root, name).collect()


def test_outputs_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], ASK)
    context = spark.createDataFrame([], "query_id int, place int, chunk_id string, doc_id int, kb_id int, content string, score double")
    out = outputs.run_outputs(none, spark.createDataFrame([], "conv_id int, turn int"), context, spark.createDataFrame([], "query_id int, answer string, error_code string"))
    assert outputs.read_outputs(spark, str(tmp_path), "logs") is None
    assert outputs.write_outputs(out, 0, str(tmp_path)) and not outputs.write_outputs(out, 0, str(tmp_path))
    assert [outputs.read_outputs(spark, str(tmp_path), t).count() for t in outputs.TABLES] == [0, 0, 0]


def test_pages_guards_and_links(spark):
    rows = spark.range(7)
    ids = lambda n: [r.id for r in relational.clamped_page(rows, ["id"], n, 3).collect()]
    assert (ids(1), ids(3), ids(9), ids(0)) == ([0, 1, 2], [6], [6], [0, 1, 2]) and relational.clamped_page(rows.where("id < 0"), ["id"], 5, 3).count() == 0
    docs = spark.createDataFrame([(1, "done"), (2, "deleting"), (3, None)], "id int, status string")
    assert [r.id for r in relational.present_documents(docs).orderBy("id").collect()] == [1, 3] and relational.completed_messages(docs).count() == 0
    assert [r.kb_id for r in relational.enabled_kbs(spark.createDataFrame([(1, True), (2, False), (3, None)], "kb_id int, enabled boolean")).collect()] == [1]
    assert relational.may_create_first_admin(docs.where("false")).first().allowed and not relational.may_create_first_admin(docs).first().allowed
    versions = relational.guarded_versions(spark.createDataFrame([(1,), (2,)], "version_id int"), spark.createDataFrame([(1,), (1,), (None,)], "version_id int"))
    assert sorted(map(tuple, versions.collect())) == [(1, 2, True), (2, 0, False)]
    linked = relational.linked_kbs(spark.createDataFrame([(1,), (2,)], "conv_id int"), spark.createDataFrame([(1, 9), (1, 4), (1, 9)], "conv_id int, kb_id int"), spark.createDataFrame([(9, "nine")], "kb_id int, kb_name string"))
    assert sorted((r.conv_id, r.kb_ids, r.kb_names, r.kb_id) for r in linked.collect()) == [(1, [4, 9], [None, "nine"], 4), (2, [], [], None)]


def test_three_states_of_a_filter(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("b", ["x"])], "id string, content array<string>").selectExpr("*", "'c' as collection_id", "'active' as state", "'r' as ingest_run_id")
    eav = spark.createDataFrame([("a", "lang", "string", "en", None, None)], "chunk_id string, field_name string, value_type string, normalized_value string, numeric_value double, datetime_value string")
    terms = spark.createDataFrame(retrieval.match_terms(["x"]), "query_id int, group_id int, term string")
    hits = lambda p: sorted(r.id for r in retrieval.bm25(rows, terms, {"content": 1.0}, 9, ids=retrieval.filter_ids(eav, p)).collect())
    assert (hits(None), hits([]), hits([("lang", "eq", "en")]), hits([("lang", "eq", "xx")])) == (["a", "b"], ["a", "b"], ["a"], [])


def test_canonical_numbers_keep_all_digits(spark):
    cases = {"1.50": "1.5", "0.123456789012345678901234567890": "0.12345678901234567890123456789", "1e3": "1000", "-0.0": "0", "007": "7", "+.50": "0.5", "-.5": "-0.5", "100": "100", "5.": "5", "1.5e-3": "0.0015", "9" * 50: "9" * 50, "x": None, "0": "0", "-12.340": "-12.34"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", V.canonical_number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_versions_are_used_again_by_fingerprint(spark):
    versions = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "template_id int, version int, fingerprint string")
    incoming = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, None)], "template_id int, fingerprint string")
    got = sorted((r.template_id, r.version, r.created) for r in relational.saved_versions(versions, incoming).collect())
    assert got == [(1, 3, True), (2, 1, False), (3, 1, True), (4, 1, True)]
