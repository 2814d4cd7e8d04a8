"""The leaf walk over variants against a plain walk of the parsed texts."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from docquarry.functions import unicode as U
from docquarry.functions import values as V
from docquarry.operators import jsonmap


def plain_leaves(value, path="", inside=None):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from plain_leaves(v, f"{path}.{k}" if path else k, inside)
    elif isinstance(value, list):
        nests = any(isinstance(x, (dict, list)) for x in value)
        if nests:
            yield path, "array", inside, 1, 1, len(value), None
            for x in value:
                yield from plain_leaves(x, path, path.rsplit(".", 1)[-1])
        elif not value:
            yield path, "array", inside, 1, 0, 0, "<empty-array>"
        for i, x in enumerate(() if nests else value):
            yield path, "array", inside, int(i == 0), 0, 1, shown(x)
    elif value == {}:
        yield path, "object", inside, 1, 0, 0, "<empty-object>"
    else:
        yield path, "scalar", inside, 1, 0, int(value is not None), shown(value)


def shown(x):
    return None if x is None or (isinstance(x, str) and not x.strip()) else json.dumps(x) if not isinstance(x, str) else x[:200]


def made(rng, deep):
    kind = rng.random()
    if deep and kind < 0.35:
        return {rng.choice(["a", "b", "c d", "é", "[x", '"q']): made(rng, deep - 1) for _ in range(rng.randrange(4))}
    if deep and kind < 0.7:
        return [made(rng, deep - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, 17, -3, "", " ", "x", "]}{[", 'quo"te\\', "2026-01-02", "long " * 60])


def test_leaves_equal_a_plain_walk(spark):
    rng = random.Random(5)
    values = [made(rng, rng.randrange(7)) for _ in range(400)]
    rows = spark.createDataFrame([(json.dumps(v, ensure_ascii=rng.random() < 0.5),) for v in values] + [(None,)], "value string")
    found = jsonmap.leaves(rows)
    got = Counter((r.path, r.container, r.child_of, r.seen, r.nested, r["items"], r.example) for r in found.collect())
    assert got == Counter(x for v in values for x in plain_leaves(v))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_no_rows_and_scalars(spark):
    assert jsonmap.profile(spark.createDataFrame([], "value string")).count() == 0
    one = jsonmap.profile(spark.createDataFrame([("3",)], "value string")).first()
    assert (one.path, one.container, one.elements) == ("", "scalar", 1)


def test_native_date_check_equals_the_parser(spark):
    rng = random.Random(9)
    parts = ["2026", "-", "01", "02", "31", "02-29", "2024", "T", " ", ":", "10", "59", "60", "24", "00", ".5", ",123456789", "Z", "+", "08:00", "W", "W53", "2020-W53-7", "2021-W53-1", "20260102", "0000-01-01", "2026-01-02", "\n", "x", "T10:20:30", "T1020", "+0530", "-03", "t09"]
    texts = sorted({"".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(30000)} | {"", " ", "2026-01-02T03:04:05.678Z", "2026-01-02 03:04+01:00", " 2026-01-02 "})
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.is_iso_datetime(F.col("t")).alias("got"), U.parsed_datetime("t").isNotNull().alias("want"))
    assert df.where("got and not want").count() == 0 and df.where("got").count() > 50
    days = ["2026-01-02", "20240229", "2023-02-29", "2020-W53-7", "2021-W53", "2026W021", "0000-01-01", "2026-13-01"]
    times = ["", "T10", " 10:20", "T10:20:30", "T102030", "t10:20:30.5", "T24:00", "T10:60", "T10:20:30,123456789", "T1020"]
    offsets = ["", "Z", "+08:00", "-0330", "+24:00", "+01"]
    real = [d + t + o for d in days for t in times for o in offsets if t or not o] + [" 2026-01-02 ", "", "x"]
    df = spark.createDataFrame([(t,) for t in real], "t string").select("t", V.is_iso_datetime(F.col("t")).alias("got"), U.parsed_datetime("t").isNotNull().alias("want"))
    assert [(r.t, r.got) for r in df.where("got <> want").collect()] == []


def test_depth_of_odd_texts(spark):
    texts = {"1": 0, "null": 0, '"a[{"': 0, '"["': 0, ' {"a": 1}': 1, "\t\r\n[1, 2]": 1, '{"a": "["}': 1, '{"a\\"[": "]"}': 1, '[[], {"b": [1]}]': 3, "{}": 1, "": 0}
    for text, deep in texts.items():
        assert jsonmap.depth(spark.createDataFrame([(text,), (None,)], "value string")) == deep, text
    assert jsonmap.depth(spark.createDataFrame([(None,)], "value string")) == 0


def test_equal_values_are_counted_before_they_are_looked_into(spark):
    rows = spark.createDataFrame([('{"a": "2024-02-30", "b": true}',), ('{"a": "2024-02-29", "b": "true"}',)] * 3 + [('{"a": ["2024-02-29", null], "b": "bool:"}',)], "value string")
    p = jsonmap.profile(rows)
    plan = p._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert "HashAggregate" in below and "SortAggregate" not in below and "yyyyMMdd" not in below and "yyyyMMdd" in plan
    got = {r.path: (r.observed, r.nulls, r.elements, r.distinct_values, r.texts, round(r.datetime_rate, 6), r.length_sum, r.min_length, r.max_length, r.types) for r in p.collect()}
    assert got == {"a": (7, 1, 8, 2, 7, round(4 / 7, 6), 70, 10, 10, "array,scalar"), "b": (7, 0, 7, 3, 4, 0.0, 17, 4, 5, "scalar")}


def test_iso_dates_with_odd_edges(spark):
    yes = ["2024-02-29", "\u3000 20240229\n", "\x1c2024-W53".replace("W53", "W52"), "2020W53", "2024W521T10", "2024-02-29TZ"[:-2], "2024-02-29T10:00Z", "2024-02-29 10", "\xa02024-02-29\x85", "20240229W10"]
    no = ["2024-02-30", "20240230", "2024-W53", "0000-01-01", "2024-02-29T10:00ZZ", "20240-02-29", "2024-2-29", "", "\u200b2024-02-29", "2024-02-29\x00", "W", "2024"]
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", V.is_iso_datetime(F.col("t")).alias("is")).collect()
    assert {r.t for r in got if r["is"]} == set(yes)
