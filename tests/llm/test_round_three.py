"""Spelling variants, prefix trie, nearest neighbours: against plain versions, and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docquarry.llm import nearest, prefix_trie, spelling
from docquarry.llm import queries as Q

from .helpers import lower, words

SF = "/root/testdata/sf0.001"

# --- spelling variants


def counts_plain(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_plain(vocabulary):
    near = {w: [x for x in vocabulary if one_apart(w, x)] for w in vocabulary}
    best = {w: min(x, key=lambda y: (-vocabulary[y], y)) if x else None for w, x in near.items()}
    form = {w: b if b and vocabulary[b] >= 2 * vocabulary[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), vocabulary[form[w]] if form[w] else None) for w, n in vocabulary.items()}


def test_spelling_variants(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcéÀz") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    pool = list(base)
    for w in base * 3:
        i = rng.randrange(len(w))
        pool += [w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿ") + w[i + 1 :], w[:i] + "a" + w[i:], w[:i] + w[i] + w[i:]]
    weights = [1 / (1 + k % 17) ** 2 for k in range(len(pool))]
    rows = [(i, " ".join(rng.choices(pool, weights, k=400)).title() if i % 9 == 0 else "-".join(rng.choices(pool, weights, k=400))) for i in range(40)]
    # Chains: each form is twice as frequent as the word before it.
    rows += [(900 + k, " ".join(["chainsaw" + "b" * j for j in range(4) for _ in range(3 * 2 ** (4 - j))])) for k in range(1)]
    rows += [(1, None), (2, ""), (None, "lonely lonely lonely"), (7, rows[7][1]), (8, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 30_000 + "\n" + ("x" * 30_001 + ",") * 3)]
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, word string")
    want = variants_plain(counts_plain(rows))
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(spelling.count_words(docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] not in (w[0], w[1]) for w in want)


def test_spelling_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b 123")], "doc_id long, text string")
    for some in (docs, docs.limit(0)):
        assert spelling.spelling_variants(spelling.count_words(some)).collect() == []


def test_every_candidate_once():
    """With a filter that lets all through, candidates are exactly the strings one edit away."""
    letters = np.array(sorted(ord(c) for c in "abé"), np.uint8)
    full = np.full(1, 2**64 - 1, np.uint64)
    for at_once in (1, 1 << 17):
        before, spelling.AT_ONCE = spelling.AT_ONCE, at_once
        try:
            made = list(spelling.neighbours(["aabé", "bbbb", "éa"], letters, 64, full))
        finally:
            spelling.AT_ONCE = before
        for w in ("aabé", "bbbb", "éa"):
            mine = [c for x, c in made if x == w]
            want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abé"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abé"}
            assert len(mine) == len(set(mine)) and set(mine) == want - {w}


# --- prefix trie


def rebuilt_plain(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            by[c].append((turn is not None, turn or 0, role or "", key, text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in by.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - int(math.fmod(c, 20)), [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}


def trie_plain(said):
    members = defaultdict(list)
    for c, s in said.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, leaves, saved = defaultdict(list), {}, {}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(words(p[-1][1])) if p else 0)
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(said[c]) == len(p)))
        yield (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())


def talks():
    rng = random.Random(9)
    say = ["yes", "no", "a b c", "", None, "what is this"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(say)) for c in [*range(-25, 300), *range(5000, 5100, 3)] for t in range(rng.randint(1, 6)) if c % 20 or c % 3]
    rows += [(600 + c, t, "user", "the same") for c in range(60) for t in range(7)]  # copies
    rows += [(700 + c, t, "user", f"long {t}" if t < 40 else f"own {c}") for c in range(12) for t in range(42)]  # a long shared chain
    rows += [(800, None, "user", "null turn"), (800, 1, "user", "tie"), (800, 1, "user", "tie"), (800, 1, "assistant", "tie"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("local", [{}, {"local_rows": 1}, {"local_rows": 10}, {"local_turns": 30}])
def test_prefix_trie(spark, local):
    rows = talks()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    out = prefix_trie.prefix_trie(Q.rebuilt(prefix_trie.encode_turns(turns)), **local)
    assert Counter(tuple(r) for r in out.collect()) == Counter(trie_plain(rebuilt_plain(rows)))


def test_frequent_turns_by_broadcast(spark, monkeypatch):
    rows = talks()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = {r.conv_id: len(r.ids) for r in prefix_trie.encode_turns(turns).collect()}
    monkeypatch.setattr(prefix_trie, "FREQUENT", 3)
    out = prefix_trie.encode_turns(turns).collect()
    assert {r.conv_id: len(r.ids) for r in out} == plain
    assert len({i for r in out for i in r.ids}) == len({(r or "", t or "") for c, _, r, t in rows if c is not None})


def test_prefix_trie_of_nothing_and_of_turnless(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.encode_turns(none)).collect() == []
    seqs = spark.createDataFrame([(5, [], []), (3, [], [])], "conv_id long, ids array<long>, words array<long>")
    (root,) = prefix_trie.prefix_trie(seqs).collect()
    assert tuple(root) == (3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())


def test_many_copies_are_digested_over_chunks(spark):
    ids = list(range(-9000, 9000, 2))
    seqs = spark.createDataFrame([(i, [1], [4]) for i in ids], "conv_id long, ids array<long>, words array<long>")
    rows = {r.depth: r for r in prefix_trie.prefix_trie(seqs).collect()}
    assert rows[1].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert rows[0].saved_tokens == rows[1].saved_tokens == 4 * (len(ids) - 1)


def test_a_deep_conversation_needs_no_deep_stack():
    deep = list(range(30_000))
    nodes = prefix_trie.quick_nodes([(1, 1, deep, [1] * 30_000, b"a"), (2, 1, deep[:-1] + [-5], [1] * 30_000, b"b")], 0)
    assert len(nodes) == 30_002 and nodes[0][5] == 2 and nodes[0][6] == 29_999


# --- nearest neighbours


def nearest_plain(rows, k=20):
    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    vectors = {}
    for i, v in rows:
        if i is not None and fine(v):
            vectors[i] = min(vectors.get(i, v), v)
    out = {}
    for q, v in vectors.items():
        if q % 20 == 0:
            found = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def clusters(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 25, dims))
    return (centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dims))).tolist()


def found_of(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("norms", ["equal", "uneven"])
def test_nearest_recall(spark, monkeypatch, norms):
    monkeypatch.setattr(nearest, "CELL_ROWS", 64)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearest, "CELL_QUERIES", 8)
    monkeypatch.setattr(nearest, "FREQUENT", 20)
    rng = np.random.default_rng(2)
    rows = []
    for i, v in enumerate(clusters(3000, 24, 1, 0.3)):
        v = np.array(v) / np.linalg.norm(v)
        rows.append((i, (v * (10 ** rng.uniform(-3, 3) if norms == "uneven" else 1)).tolist()))
    rows += [(10_000 + i, rows[7][1]) for i in range(900)]  # one vector many times
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double")
    got, want = found_of(nearest.nearest(df, Q.F.col("vec_id") % 20 == 0)), nearest_plain(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    assert all(got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and q not in dict(got[q]) for q in got)
    truth = dict(rows)
    assert all(s == float((np.array(truth[q]) * np.array(truth[i])).sum()) for q in got for i, s in got[q])
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_nearest_prunes(spark, monkeypatch):
    """Close clusters: most vectors are never verified."""
    points = np.array(clusters(4000, 32, 5, 0.02))
    points /= np.linalg.norm(points, axis=1)[:, None]
    at = nearest.project(points, 1.0, 8)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and self.ndim == 2 and self.shape[1] == 32 and key.dtype.kind == "i":
                seen.append(len(key))
            return np.asarray(super().__getitem__(key))

    ids = [[i] for i in range(len(points))]
    blocks = nearest._blocks(at, 64)
    assert sorted(np.concatenate(blocks).tolist()) == list(range(4000)) and max(map(len, blocks)) <= 64
    monkeypatch.setattr(nearest, "_blocks", lambda points, most: blocks)
    real = [points[b].view(Counted) for b in blocks]

    class Vectors:
        def __getitem__(self, key):
            return real[next(k for k, b in enumerate(blocks) if b is key)]

    list(nearest.search_cell(at, Vectors(), ids, points[:50], at[:50], np.full(50, -np.inf), 1.0, 21, nearest.chi_square_limit(8, 0.95)))
    assert 0 < sum(seen) < 0.2 * 50 * 4000


def test_nearest_on_odd_tables(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.25]), (3, [2.0, 0.0]), (4, [2.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [None, 1.0]), (40, [float("inf"), 1.0])]
    rows += [(None, [9.0, 9.0]), (60, [1.0, 2.0, 3.0]), (61, [-1.0, 0.0, 0.0]), (80, [1.0] * 5), (2, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = Q.F.col("vec_id") % 20 == 0
    got = found_of(nearest.nearest(df, asks))
    assert got == {q: v for q, v in nearest_plain(rows).items() if v}
    assert nearest.nearest(df.limit(0), asks).collect() == []
    assert nearest.nearest(df.where("vec_id in (5, 7)"), asks).collect() == []


def test_chi_square_limit():
    assert abs(nearest.chi_square_limit(8, 0.95) - 15.5073) < 1e-3 and abs(nearest.chi_square_limit(2, 0.5) - 2 * math.log(2)) < 1e-9


def test_op13_recall_on_the_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in Q.table(spark, SF, "embeddings").collect()]
    got, want = found_of(Q.op13_nearest(spark, SF)), nearest_plain(rows)
    assert got.keys() == want.keys()
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) >= 0.9 * sum(map(len, want.values()))
