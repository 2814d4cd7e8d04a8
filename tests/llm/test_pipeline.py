"""The pipeline against plain Python, stage by stage, and the queries against DuckDB."""

import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from docquarry.llm import oracles, quality
from docquarry.llm import queries as Q

from .helpers import jaccard, linked, shingles, words
from .test_native import features, limits_plain, line_dedup_plain, matches_plain

SF = "/root/testdata/sf0.001"


def quality_plain(rows):
    """doc_ids that stay."""

    def values(text):
        n, chars, symbols, dup, again = features(text)
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
        per = lambda a, b, by=1000: a * by // max(b, 1)
        return {"symbols": per(symbols, chars), "dup_lines": per(dup, len(lines)), "repeats": per(again, n), "stutter": per(stutter, n), "long_words": per(chars, n, 10)}

    def bucket(v):
        width = 2 ** max(v.bit_length() - quality.SUB.bit_length(), 0)
        return v // width * width

    each = [(r, values(r[1])) for r in rows]
    fence = {k: limits_plain([(r[2], r[3], bucket(v[k])) for r, v in each], quality.PRIOR, slack) for k, (_, slack) in quality.FEATURES.items()}
    kept = []
    for r, v in each:
        n, _, _, _, again = features(r[1])
        if n >= 20 and 100 * again <= 30 * n and all(v[k] <= fence[k][r[2], r[3]] for k in v):
            kept.append(r)
    return kept


def corpus():
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    notice = "This notice stands at the end of many documents."
    items = [(i, say(40)) for i in range(10)]
    rows = [[i, "\n".join(say(60) for _ in range(3)), ["en", "de"][i % 2], f"s{i % 2}"] for i in range(260)]
    for r in rows[::5]:
        r[1] += "\n" + notice
    for i in range(20):  # near copies, exact copies, passages, junk
        w = rows[i][1].split(" ")
        w[10] = "changed"
        rows.append([1000 + i, " ".join(w), "en", "s0"])
        rows.append([1100 + i, rows[20 + i][1], "en", "s0"])
        rows.append([1200 + i, say(80) + " " + items[i % 10][1] + " " + say(50), "de", "s1"])
        rows.append([1300 + i, " ".join(w + "#$%" for w in say(100).split()), "en", "s0"])
        rows.append([1400 + i, (say(12) + " ") * 20, "en", "s0"])
    return [tuple(r) for r in rows] + [(2000, None, None, None), (2001, "", "en", "s0"), (2002, "too short", "en", "s0")], items


def test_pipeline_against_plain_python(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "benchmark decontamination", "packing"]

    kept = quality_plain(rows)
    docs = stages["quality rules"](spark, docs, str(tmp_path))
    assert docs.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in kept}
    assert {r[0] for r in kept} & set(range(260)) == set(range(260)) and not {r[0] for r in kept} & set(range(1300, 1420))

    plain = line_dedup_plain([r[:2] for r in kept])
    texts = {i: plain[i, t][2] for i, t, *_ in kept}
    docs = stages["line dedup"](spark, docs, str(tmp_path))
    assert docs.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    sets = {i: set(shingles(t, 5)) for i, t in texts.items()}
    groups = linked(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    docs = stages["near dedup"](spark, docs, str(tmp_path))
    assert docs.columns == corpus_pipeline.COLUMNS
    left = {i for i, g in groups.items() if i == g}
    assert {r.doc_id for r in docs.collect()} == left and len(left) < len(groups) - 15

    bad = {d for d, _ in matches_plain([(i, texts[i]) for i in left], items)}
    docs = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert docs.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in docs.collect()} == left - bad and len(bad) == 20

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in out} == left - bad
    total = Counter()
    for p in out:
        total[p.doc_id, p.doc_tokens] += p.length
    assert all(n == tokens for (_, tokens), n in total.items())


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(oracles.SQL[name])
    columns = [c[0] for c in cursor.description]
    got = getattr(Q, name)(spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(cursor.fetchall())


@pytest.mark.parametrize("name", ["op1_lm_score", "op2_simhash", "op6_token_counts", "op9_decontamination", "op10_packing"])
def test_query_runs(spark, name):
    rows = getattr(Q, name)(spark, SF).collect()
    assert rows
    if name == "op2_simhash":
        assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in rows)


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __dq_text string, kept int"
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, say(1), None, None, None, "h", 1), (1, say(1), None, None, None, "h", 1), (None, say(2), "en", "s", 1, "h", 1), (3, None, "en", None, 0, "h", 1), (4, "", "en", "s", 0, "h", 1), (5, " ".join(f"u{i}" for i in range(20_000)), "en", "s", 9, "h", 1)]
    items = spark.createDataFrame([(7, None), (8, "")], "item_id long, text string")
    for name, found in (("empty", []), ("odd", rows)):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(found, schema).write.parquet(f"{path}/documents.parquet")
        items.write.parquet(f"{path}/benchmark.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)  # each on the odd table itself, too
            assert out.columns == corpus_pipeline.COLUMNS
            assert {r.doc_id for r in out.collect()} <= {1, 3, 4, 5, None}
        out = corpus_pipeline.run(spark, path).collect()
        assert Counter(p.doc_id for p in out if p.start == 0) == (Counter({1: 2, None: 1, 5: 1}) if found else Counter())
