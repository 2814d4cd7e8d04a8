"""Sentence pieces, citations' tokens and bigrams against the plainer forms that they had."""

import random

from pyspark.sql import functions as F

from docquarry.functions import citations as C
from docquarry.functions import text as T


def texts(spark, letters, n=400, seed=8):
    rng = random.Random(seed)
    rows = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))),) for _ in range(n)] + [(None,), ("",), (" ",)]
    return spark.createDataFrame(rows, "t string")


def test_sentence_pieces_and_counts(spark):
    plain = F.regexp_extract_all("t", F.lit(f"(?U)(?s).+?(?:[{T.SENTENCE_END}\n]+|\\.+(?=\\s|\\z)|\\z)"), F.lit(0))
    got = texts(spark, "ab.. \n!;。　 😀").select("t", T._sentence_parts(F.col("t")).alias("x"), plain.alias("y"), T.sentence_count(F.col("t")).alias("n"), F.size(T.sentences(F.col("t"))).alias("m")).collect()
    assert [r.x for r in got] == [r.y for r in got]
    assert [r.n for r in got] == [r.m for r in got]


def test_tokens_begin_with_one_class(spark):
    plain = f"{C._CODE}|{C._SPECIAL}|{C._TAG}|{C._LINK}|{C.CITATION}"
    df = texts(spark, ["[1]", "【2】", "[3##1#]", "`", "```", "<b>", "</b>", "<!--", "-->", "<br>", "](", ")", "http://a", " ", "h", "x", "!"])
    got = df.select(F.regexp_extract_all("t", F.lit(C._TOKEN), F.lit(0)).alias("x"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got]
    assert C._TOKEN.startswith("(?=[")


def test_bigrams_cut_the_text_once(spark):
    df = texts(spark, "ab\n😀é").select("t", T.bigrams(F.col("t")).alias("b"))
    for r in df.collect():
        assert r.b == (None if r.t is None else list(dict.fromkeys(r.t[i : i + 2] for i in range(len(r.t) - 1))))
    assert "(?=(.))" not in df._jdf.queryExecution().analyzed().toString()
