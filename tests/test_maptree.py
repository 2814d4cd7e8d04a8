"""Composed mappings against a plain version."""

import json

from docquarry.operators import jsonmap, maptree

F = jsonmap.Field
COMMENT = jsonmap.Mapping("comment", "comments[*]", (F("author", "filter"), F("content", "content", conditions=(("required", None),))), relation=("referTo", "author"))
LINK = jsonmap.Mapping("link", "meta.links[*]", (F("url", "content"),), chunk_policy="atomic")
POST = jsonmap.Mapping("post", "$[*]", (F("id", "id"), F("title", "title", conditions=(("required", None),)), F("body", "content", transforms=("remove_child_echo",))), (COMMENT, LINK))

POSTS = [
    {"id": "p0", "title": "a", "body": "first\n thanks \nlast\nnot me", "meta": {"links": [{"url": "u1"}, 7, {"url": "u2"}]},
     "comments": [{"author": "ann", "content": "thanks"}, "no object", {"author": "bob", "content": "I agree", "referTo": "ann"}, {"author": None, "content": "no author", "referTo": "bob"}, {"author": "cy", "content": " ", "referTo": "bob"}, {"author": "dan", "content": "last", "referTo": "bob"}]},
    {"id": "p1", "title": " ", "body": "thanks", "comments": [{"author": "ann", "content": "lost with its parent"}]},
    {"id": "p2", "title": "b", "body": "thanks\nlast"},
    {"title": "c", "body": "no id", "comments": [], "meta": {"links": {"url": "no list"}}},
]


def rows(spark, posts):
    return jsonmap.records(spark.createDataFrame([(1, json.dumps(posts)), (2, json.dumps(posts[:1]))], "source long, value string"), POST.record_path)


def test_parents_before_children_and_echoes(spark):
    out = maptree.map_tree(rows(spark, POSTS), POST, ["source"], "h").where("source = 1").orderBy("source_pointer", "batch", "child_index").collect()
    by = {(r.record_type, r.source_pointer): r for r in out}
    assert [(r.record_type, r.child_index) for r in out if r.source_pointer.startswith("/0")] == [("post", 0), ("comment", 0), ("comment", 2), ("comment", 3), ("comment", 5), ("link", 0), ("link", 2)]
    # Lines that a comment repeats are gone, but not those of a rejected one.
    assert by["post", "/0"].content == "first\nnot me" and by["post", "/2"].content == "thanks\nlast"
    assert not any(p.startswith("/1") for _, p in by)
    kids = {i: by["comment", f"/0/comments/{i}"] for i in (0, 2, 3, 5)}
    assert [kids[i].parent_id for i in (0, 2, 3, 5)] == ["p0", kids[0].record_id, kids[2].record_id, kids[2].record_id]
    assert by["link", "/0/meta.links/2"].parent_id == "p0" and by["link", "/0/meta.links/0"].chunk_policy == "atomic"
    assert len(by["post", "/3"].record_id) == 64 and by["post", "/3"].parent_id is None


def test_rejected_rows_of_a_preview(spark):
    out = maptree.preview(rows(spark, POSTS), POST, 2, ["source"]).collect()
    assert {r.source_pointer.split("/")[1] for r in out} == {"0", "1"} and {r.source for r in out} == {1}
    bad = {(r.record_type, r.source_pointer): [i.code for i in r.issues] for r in out if r.rejected}
    assert bad == {("post", "/1"): ["FIELD_REQUIRED"], ("comment", "/0/comments/4"): ["FIELD_REQUIRED"]}
    assert next(r for r in out if r.source_pointer == "/1/comments/0").parent_id is None


def test_without_children(spark):
    alone = jsonmap.Mapping("post", "$[*]", POST.fields)
    assert maptree.map_tree(rows(spark, POSTS), alone, ["source"]).where("source = 1").count() == 3
    assert maptree.map_tree(rows(spark, POSTS).limit(0), POST, ["source"]).collect() == []
