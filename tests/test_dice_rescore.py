"""Every benchmark item against every document, by plain Python and by the query's SQL."""

import random
import re

import duckdb
import pyarrow as pa
import pytest

from docquarry.functions import pairs
from docquarry.plans import catalog


def plain(t):
    return None if t is None else re.sub("[^a-z0-9]", "", t.lower())


def score(q, t):
    if q == "" or t == "":
        return 0.0
    if q is None or t is None:
        return None
    if q in t:
        return 1.0
    a, b = ({x[i : i + 2] for i in range(len(x) - 1)} for x in (q, t))
    return (2 * len(a & b) / (len(a) + len(b))) if a or b else 0.0


def test_every_item_is_scored(spark, tmp_path):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abz09 É!") for _ in range(rng.randint(0, n)))
    docs = [(i, word(60)) for i in range(60)] + [(60, None), (61, ""), (62, "a"), (63, "z"), (64, "?"), (None, word(40)), (65, "zz" * 1500 + "q")]
    items = [(i, word(12)) for i in (1, 2, 7, 99, 100, 150, 200)] + [(300, None), (301, "a"), (302, " "), (303, "ab"), (None, word(9))]
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.query_id, r.rank): (r.doc_id, r.lexical) for r in catalog.QUERIES["dice_rescore"](spark, str(tmp_path)).collect()}
    want = {}
    for i, q in items:
        s = [(score(plain(q), plain(t)), d) for d, t in docs]
        s.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is None, x[1] or 0))
        want |= {(i, k + 1): (d, None if x is None else round(x, 6)) for k, (x, d) in enumerate(s[:10])}
    assert got.keys() == want.keys()
    for key, (d, x) in want.items():
        assert got[key] == (d, x if x is None else pytest.approx(x, abs=1e-6)), key
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert {(r[0], r[3]): (r[1], r[2]) for r in con.execute(catalog.ORACLES["dice_rescore"]).fetchall()} == got


def test_pair_bits(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", "a", "zz", "09"] + ["".join(rng.choice(pairs.LETTERS) for _ in range(rng.randint(0, 90))) for _ in range(50)]
    monkeypatch.setattr(pairs, "CHARS", 64)
    monkeypatch.setattr(pairs, "TEXTS", 7)
    for some in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string())[1:], pa.array([], pa.string())):
        for t, bits in zip(some.to_pylist(), pairs._bits(some).to_pylist(), strict=True):
            want = {pairs.LETTERS.index(t[i]) * 36 + pairs.LETTERS.index(t[i + 1]) for i in range(len(t) - 1)} if t is not None else None
            assert (None if bits is None else {64 * k + b for k, w in enumerate(bits) for b in range(64) if w >> b & 1}) == want
