"""Text, value and URL expressions, the analyzer, and chunking."""

import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions import unicode as U
from docquarry.functions import values as V
from docquarry.operators import chunking, retrieval

from . import plain_splitter


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (T.strip, " \t a b \n", "a b"),
        (T.one_spaced, " a \n b ", "a b"),
        (T.unix_lines, "a\r\nb\rc\n", "a\nb\nc\n"),
        (T.without_tags, " <p>a &amp;lt; b</p> ", "a < b"),
        (T.distinct_lines, "b\na\nb\n\na", "b\na\n"),
        (T.only_emoji, "😀 ☀", True),
        (T.only_emoji, "😀a", False),
        (T.token_estimate, "免税abcdefgh", 7),
        (T.speech_token_estimate, "", 1),
        (T.speech_token_estimate, "免税 hello world", 5),
        (T.sentences, "你好。 真的？ok; tail", ["你好。", "真的？", "ok;", "tail"]),
        (T.topic_slices, "甲乙。甲乙。\n，丙：", ["甲乙", "丙"]),
        (lambda c: T.slices(c, 2), "abcde", ["ab", "cd", "e"]),
        (lambda c: T.slices(c, 2), "", []),
        (T.short_title, "x" * 21, "x" * 20 + "…"),
        (T.redacted, "Authorization: Bearer abc.d X-Nonce: q1 app_session=zz; y", "Authorization: Bearer [REDACTED] X-Nonce: [REDACTED] app_session=[REDACTED]; y"),
        (T.json_object, 'say {"a": {"b": 1}} end', '{"a": {"b": 1}}'),
        (lambda c: T.citations(c, F.lit(3)), "a [2] 【1】 [9] [2]", [2, 1]),
        (T.bigrams, "abab😀", ["ab", "ba", "b😀"]),
        (V.to_boolean, " 是 ", True),
        (V.to_boolean, "maybe", None),
        (V.to_number, " 1_000.5 ", 1000.5),
        (lambda c: V.canonical_number(c.cast("decimal(20,5)")), "1.50", "1.5"),
        (lambda c: V.canonical_number(c.cast("decimal(20,5)")), "100", "100"),
        (lambda c: V.clock(c.cast("double")), "3725.9", "01:02:05"),
        (lambda c: V.clock(c.cast("double")), "65", "01:05"),
        (V.clock_seconds, "01:02:03,500", 3723.5),
        (V.normalized_url, "HTTPS://www.A.com/p/?b=2&a=1#f", "https://a.com/p?a=1&b=2"),
        (V.normalized_url, "http://a.com/", "http://a.com/"),
        (V.source_class, "https://www.youtube.com/watch?v=1", "youtube"),
        (V.source_class, "/tmp/x.mp4", "local"),
        (V.video_id, "https://www.bilibili.com/video/BV1xx411c7mD?p=1", "BV1xx411c7mD"),
        (V.is_public_url, "http://192.168.1.1/x", False),
        (V.is_public_url, "https://example.com", True),
        (V.shown_state, "Indexing_Dense", "running"),
        (V.shown_state, None, "pending"),
        (V.chunk_index, "7:3:abcd#500", 3),
        (V.chunk_offset, "7:3:abcd#500", 500),
        (U.parsed_datetime, "2026-01-02 03:04:05", "2026-01-02T03:04:05+00:00"),
        (U.parsed_datetime, "2026-01-02T03:04:05+08:00", "2026-01-02T03:04:05+08:00"),
        (U.parsed_datetime, "soon", None),
    ],
)
def test_expression(spark, f, x, y):
    assert one(spark, x, f) == y


@pytest.mark.parametrize(
    ("x", "y"),
    [("免税政策", ["免", "免税", "税", "税政", "政", "政策", "策"]), ("SKU-AB12 ｓｋｕ a- -b", ["sku-ab12", "sku", "a", "b"]), ("12元a", ["12", "元", "a"]), ("", [])],
)
def test_terms(x, y):
    assert U.terms(x) == y


def test_dice(spark):
    rows = [("abc", "xxabcxx", 1.0), ("a", "b", 0.0), ("", "a", 0.0), ("abcd", "abxcd", 2 * 2 / 7)]
    df = spark.createDataFrame(rows, "q string, t string, want double")
    score = T.dice(F.col("q"), F.col("t"), T.bigrams(F.col("q")), T.bigrams(F.col("t")))
    for r in df.withColumn("got", score).collect():
        assert r.got == pytest.approx(r.want)


def test_price_and_errors(spark):
    q = V.price_quote(F.lit(65.0), F.lit(6.5), F.lit(15.0), F.lit(20.0), F.lit(40.0), F.lit(2.0))
    r = spark.range(1).select(*(v.alias(k) for k, v in q.items()), V.http_error(F.lit(503)).alias("e")).first()
    assert (r.buyer_price, r.platform_price, r.msrp, r.e.retryable) == (22.22, 27.78, 44.44, True)
    assert r.margin == pytest.approx(40.0)


def test_bm25_equals_sqlite(spark):
    rng = random.Random(1)
    words = ["sku", "ab12", "tax", "free", "policy", "note", "zz"]
    rows = [(i, *([rng.choice(words) for _ in range(rng.randint(0, n))] for n in (3, 3, 12))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(i unindexed, title, keywords, content)")
    con.executemany("insert into f values (?, ?, ?, ?)", [(i, *map(" ".join, r)) for i, *r in rows])
    want = {int(i): -s for i, s in con.execute("select i, bm25(f, 0, 5, 3, 1) from f where f match '(sku ab12) OR tax OR free'")}
    df = spark.createDataFrame(rows, "id long, title array<string>, keywords array<string>, content array<string>")
    terms = spark.createDataFrame(retrieval.match_terms(["sku-ab12", "tax", "free"]), "query_id int, group_id int, term string")
    got = {r.id: r.lexical_score for r in retrieval.bm25(df, terms, {"title": 5, "keywords": 3, "content": 1}, 1000).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_chunks_pack_units_and_overlap():
    assert plain_splitter.split_text("") == [] and plain_splitter.split_text(" \n\n ") == []
    assert plain_splitter.split_text("第一句。第二句。", 100, 0) == ["第一句。第二句。"]
    parts = plain_splitter.split_text("。".join(["一二三四五六七八"] * 12) + "。", 40, 4)
    assert len(parts) > 3 and all(p.endswith("一二") for p in parts[:-1]) and not parts[-1].endswith("一二")
    long = plain_splitter.split_text("x" * 1000, 100, 10)
    assert long[0] == "x" * 110 and "".join(p[:100] for p in long) == "x" * 1000


def test_chunks_keep_tables_and_headings():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | {'v' * 30} |" for i in range(12))
    assert plain_splitter.split_text("intro。\n\n" + "| a |\n|---|\n| 1 |" + "\n\nend。", 200, 10) == ["intro。", "| a |\n|---|\n| 1 |", "end。"]
    pieces = plain_splitter.split_text(table, 60, 10)
    assert len(pieces) > 2 and all(p.startswith("| a | b |\n|---|---|\n") for p in pieces)
    assert Counter(x for p in pieces for x in p.split("\n")[2:]) == Counter(table.split("\n")[2:])


def test_faq_items():
    text = "前言。\n\nFAQ\n1、如何退款？答：联系客服。\n2、多久到账？答：三天。\n\n# 下一节\n正文。"
    parts = plain_splitter.split_text(text, 200, 0)
    assert "1、如何退款？答：联系客服。" in parts and "2、多久到账？答：三天。" in parts
    assert all("正文" not in p for p in parts if "答：" in p)
    assert not any(p.startswith("1、如何退款") for p in plain_splitter.split_text(text.replace("FAQ\n", ""), 8, 0)[:1])
    answer = "。".join(["这是一个很长的回答" * 3] * 40) + "。"
    pieces = plain_splitter.split_text("FAQ\n1、如何退款？答：" + answer, 200, 0)
    assert len(pieces) > 2 and all(p.startswith("1、如何退款？答：") and len(p) <= 500 for p in pieces)


def test_chunk_tables(spark):
    docs = spark.createDataFrame([(1, "一句。" * 300), (2, None)], "doc_id long, text string")
    chunks = chunking.chunk_documents(docs, 64, 8)
    rows = chunks.orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and rows[0].chunk_id.startswith("1:0:")
    wide = spark.createDataFrame([("1:0:a", "x" * 1200, False), ("1:1:b", "y" * 1200, True)], "chunk_id string, content string, preserve boolean")
    got = {r.chunk_id: (len(r.content), len(r.embedding_text)) for r in chunking.embedding_slices(wide).collect()}
    assert got == {"1:0:a#0": (500, 500), "1:0:a#500": (500, 500), "1:0:a#1000": (200, 200), "1:1:b": (1200, 500)}
    records = spark.createDataFrame([(1, "t", "甲。乙。甲。", p) for p in ("topic", "atomic", "semantic", "ignore", "parent-only")], "doc_id long, title string, content string, chunk_policy string")
    assert Counter(r.preserve for r in chunking.by_policy(records).collect()) == {True: 4, False: 1}


def test_public_addresses_equal_the_standard_library(spark):
    import ipaddress

    hosts = ["8.8.8.8", "10.1.2.3", "100.64.0.1", "172.31.0.1", "172.32.0.1", "192.0.0.9", "192.0.0.8", "198.19.0.1", "203.0.113.9", "224.0.0.1", "240.0.0.1", "255.255.255.255", "0.1.2.3", "169.254.9.9"]
    hosts += ["::", "::1", "2001:4860:4860::8888", "fe80::1", "fc00::1", "fdff::", "fe00::1", "2001:db8::1", "2001:1::1", "2001:1::3", "2001:3::9", "2001:20::1", "2002:101::", "3fff::1", "64:ff9b:1::2", "64:ff9b::8.8.8.8", "100::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "1:2:3:4:5:6:7:8", "FF02::1"]
    urls = {f"http://{f'[{h}]' if ':' in h else h}/x": ipaddress.ip_address(h).is_global for h in hosts}
    bad = ["http://[1::2::3]/", "http://[12345::]/", "http://[1:2:3]/", "http://[]/", "http://1.2.3/", "http://08.8.8.8/", "http://256.1.1.1/", "ftp://8.8.8.8/", "http:///x", "http://localhost:80/", "http://a.localhost/", ""]
    urls |= dict.fromkeys(bad, False) | {"https://user:pw@example.com:8443/x": True, "http://u@127.0.0.1/": False, "HTTP://[2001:4860:4860::8888]:80": True}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", V.is_public_url(F.col("u")).alias("ok"))
    assert {r.u: r.ok for r in got.collect()} == urls


def test_source_classes(spark):
    want = {"https://mp.weixin.qq.com/x": "weixin", " http://sphx.y/1": "weixin", "https://b23.tv/": "bilibili", "http://v.douyin.com:80/a": "douyin", "https://youtu.be": "youtube", "ftp://youtube.com/": "local", "HTTPS://youtube.com/": "local", "/a/b": "local", None: "local", "http://asph.y/": "other"}
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", V.source_class(F.col("u")).alias("k"))
    assert {r.u: r.k for r in got.collect()} == want


def test_live_scores_fold_compatible_characters(spark):
    from docquarry.operators import answering

    chunks = spark.createDataFrame([(1, 1, 0, "a", None, "ＳＫＵ－１２ 政策", [1.0, 0.0]), (1, 2, 0, "b", None, "other text", [1.0, 0.0])], "kb_id long, doc_id long, chunk_index int, chunk_id string, record_id string, content string, embedding array<double>")
    asked = spark.createDataFrame([(7, 5, 1, 0, "sku12政策", [1.0, 0.0])], "query_id long, owner_id long, kb_id long, kb_order int, question string, query_vector array<double>")
    kbs = spark.createDataFrame([(1, 5, "kb")], "kb_id long, owner_id long, kb_name string")
    found = answering.retrieve(answering.prepared_chunks(chunks), asked, kbs, 2).orderBy("position").collect()
    assert [(r.chunk_id, r.lexical) for r in found] == [("a", 1.0), ("b", 0.0)]


@pytest.mark.parametrize(("x", "y"), [("0.000000000001", "0.000000000001"), ("12345678901234567890123.5", "12345678901234567890123.5"), ("-2.50", "-2.5"), ("0", "0")])
def test_canonical_numbers(spark, x, y):
    assert one(spark, x, V.canonical_number) == y
