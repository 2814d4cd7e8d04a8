"""Tables whose rows were not counted are never broadcast, however small Spark takes them to be."""

import random
from contextlib import contextmanager

import pytest

from docquarry.llm import common, components, line_dedup, quality, simhash, url_filter


@contextmanager
def plans_with_broad_limits(spark, monkeypatch, *modules):
    """The plans of all tables that ``modules`` write, where Spark may broadcast up to 1 GB."""
    names, found = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), []
    before = spark.conf.get(names[0])
    for n in names:
        spark.conf.set(n, "1g")
    for m in modules:

        def write(df, name, own=m.materialize):
            found.append((name, plan(df)))
            return own(df, name)

        monkeypatch.setattr(m, "materialize", write)
    try:
        yield found
    finally:
        spark.conf.set(names[0], before)
        spark.conf.unset(names[1])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def alike_texts(n=60, seed=5):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(40)) for _ in range(80)) for _ in range(n // 3)]
    return [(i, base[i // 3] if i % 3 == 0 else base[i // 3] + " " + "xyz"[i % 3]) for i in range(n)] + [(None, "a b"), (n, None)]


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash_groups_broadcasts_nothing_by_estimate(spark, monkeypatch, crowd):
    docs = spark.createDataFrame(alike_texts(), "doc_id long, text string")
    want = sorted(map(str, simhash.simhash_groups(docs).collect()))
    monkeypatch.setattr(common, "MOST_BROADCAST", -1)
    with plans_with_broad_limits(spark, monkeypatch, simhash, components) as found:
        out = simhash.simhash_groups(docs, crowd=crowd)
        found.append(("result", plan(out)))
        assert [name for name, p in found if "BroadcastExchange" in p] == []
        assert sum("SortMergeJoin" in p for _, p in found) >= 3
        assert sorted(map(str, out.collect())) == want


@pytest.mark.parametrize(("rows", "size"), [(1, 1 << 24), (1000, 10)])
def test_url_filter_broadcasts_nothing_by_estimate(spark, monkeypatch, rows, size):
    urls = [f"http://{'abc'[i % 3]}.example.{('net', 'com')[i % 2]}/de/{i % 37}" for i in range(200)] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.com", "/de/1", "block"), ("a.example.com", "/de/", "allow")], "host string, path string, verdict string")
    want = sorted(map(str, url_filter.url_filter(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "MOST_BYTES", size)
    with plans_with_broad_limits(spark, monkeypatch, url_filter) as found:
        out = url_filter.url_filter(pages, rules, most_broadcast=rows)
        assert [p.count("BroadcastHashJoin") for _, p in found] + [plan(out).count("BroadcastHashJoin")] == [0, 0]
        assert sorted(map(str, out.collect())) == want


def test_near_dedup_broadcasts_nothing_by_estimate(spark, monkeypatch):
    docs = spark.createDataFrame(alike_texts(), "doc_id long, text string")
    want = sorted(map(str, simhash.near_dedup(docs).collect()))
    assert len(want) < 62
    monkeypatch.setattr(common, "MOST_BROADCAST", -1)
    with plans_with_broad_limits(spark, monkeypatch, simhash, components) as found:
        out = simhash.near_dedup(docs, crowd=2, most_broadcast=-1)
        found.append(("result", plan(out)))
        assert [name for name, p in found if "BroadcastExchange" in p] == []
        assert sorted(map(str, out.collect())) == want


def test_rules_over_the_bound_are_not_broadcast(spark, monkeypatch):
    rows = [(i, f"a line that recurs in all of them\nand words of its own {i} " + "w x y z " * 8, "e", "s") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with plans_with_broad_limits(spark, monkeypatch):
        out = line_dedup.line_dedup(docs, most_broadcast=0)
        assert "SortMergeJoin" in plan(out) and sum(r.n_dropped for r in out.collect()) == 7
        out = quality.quality_rules(docs, most_broadcast=0)
        assert "SortMergeJoin" in plan(out) and "BroadcastExchange" not in plan(out)
