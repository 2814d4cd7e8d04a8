"""Language-model scores, SimHash, token counts, WARC, packing."""

import base64
import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import components, lm_score, mixing, packing, simhash, warc, wordpiece
from docquarry.llm import queries as Q

from .helpers import jaccard, linked, lower, shingles, words


def texts(n, seed, length=60, vocabulary=400):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(["an", "er", "th", "in", "ou", "la", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(pool) for _ in range(length)) for _ in range(n)]


HARD = [None, "", " \n\t ", "word", "WORD", "x" * 50_000, "a\x0bb\x0cc\rd", "é😀 中文 , .", "tab\tand  two\n\nlines \n"]

# --- SimHash


def fingerprint_plain(text, size=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, size)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash_groups(spark, crowd):
    rng = random.Random(5)
    base = texts(25, 5, length=300)
    rows = list(enumerate(base))
    for i in range(100):  # near copies
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(1000 + i, t) for i, t in enumerate(HARD)] + [(7, base[7]), (None, "lost")]
    out = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()
    assert len(out) == len(rows)
    prints = {i: fingerprint_plain(t) for i, t in rows if i is not None}
    want = linked(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len(set(want.values())) < len(want) - 20
    for r in out:
        assert (r.doc_id is None and r.component_id is None) or (r.fp % 2**64, r.component_id) == (prints[r.doc_id], want[r.doc_id])


def test_simhash_empty_and_radius(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.near_dedup(none).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_groups(none, radius=3)


def test_near_dedup(spark):
    rng = random.Random(6)
    base = texts(30, 6, length=400, vocabulary=3000)
    rows = [(i, t, "x") for i, t in enumerate(base)]
    for i in range(60):
        w = base[i % 30].split()
        for _ in range(4):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((100 + i, " ".join(w), "x"))
    rows += [(500, base[3], "x"), (501, base[3].upper(), "x"), (502, None, "x"), (503, "", "x"), (None, base[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = simhash.near_dedup(docs, crowd=8)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    sets = {i: set(shingles(t, 5)) for i, t, _ in rows if i is not None}
    want = linked(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8 or not (sets[a] or sets[b]))
    assert set(range(30)) <= kept and None in kept
    roots = {i for i, root in want.items() if i == root}
    assert roots <= kept and len(kept - {None} - roots) <= 1  # the search finds over 0.99 here


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (300, None)]
    star = [(1000 + i, 999) for i in range(300)]
    got = dict(components.connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200, 999: 999, **{1000 + i: 999 for i in range(300)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- packing


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(Q.tokenizer_path())
    encoder = packing.WordEncoder(Q.tokenizer_path(), most=50)
    odd = ["İstanbul ΣΑΣ. a,b don't I'M <|endoftext|>x <|ENDOFTEXT|>", "x́ y ́, é. É, 12. a1. ... ,. ﬁn, q r ǅ, 中文. 中文,", "ß. ẞ, ŉ. Ά, '. ',", *[t or "" for t in HARD], *texts(5, 7)]
    for t in odd:
        assert encoder.ids(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:50]


def check_packing(pieces, capacity=4096):
    found = defaultdict(list)
    for p in pieces:
        found[p.sequence_id].append(p)
    padding = 0
    for s in found.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    rows = list(enumerate(texts(300, 8, length=500))) + [(1000 + i, t) for i, t in enumerate(HARD)] + [(2000, " ".join(texts(40, 9))), (None, "nobody"), (3, texts(300, 8, length=500)[3])]
    out = packing.pack_documents(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, offset int"), Q.tokenizer_path()).collect()
    assert check_packing(out) < 0.05 * sum(p.length for p in out)
    plain, want = Tokenizer.from_file(Q.tokenizer_path()), Counter()
    for i, t in rows:
        want[i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2])] += 1
    pieces = defaultdict(list)
    for p in out:
        pieces[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for (i, ids), times in want.items():
        mine = sorted(x for x in pieces[i] if x[3] == len(ids))
        assert sum(x[1] for x in mine) == times * len(ids)
        for start, length, crc, _ in mine:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        assert all(sum(a <= k < a + n for a, n, _, _ in mine) == times for k in (0, len(ids) // 2, len(ids) - 1))
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), Q.tokenizer_path()).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=24, max_size=24))
def test_column_generation_covers_exactly(counts):
    demand = np.array(counts)
    used = packing.column_generation(demand, 24)
    total = sum((p * n for p, n in used), np.zeros(24, np.int64))
    assert (total == demand).all()
    assert all((p * np.arange(1, 25)).sum() <= 24 and n > 0 for p, n in used)
    least = -(-int((demand * np.arange(1, 25)).sum()) // 24)
    assert sum(n for _, n in used) <= 1.3 * least + 24


def test_best_fill_is_best():
    rng = random.Random(15)
    for _ in range(100):
        sizes = np.array(sorted(rng.sample(range(1, 30), 5)))
        left = np.array([rng.randint(0, 3) for _ in sizes])
        room = rng.randint(1, 60)
        got = packing.best_fill(left, sizes, room)
        assert (got <= left).all()
        sums = {0}
        for n, k in zip(sizes.tolist(), left.tolist(), strict=True):
            sums = {a + n * j for a in sums for j in range(k + 1)}
        assert int((got * sizes).sum()) == max(x for x in sums if x <= room)


def test_pack_in_many_shards(spark):
    rng = random.Random(10)
    pieces = spark.createDataFrame([(i, 0, rng.choice([rng.randint(1, 4096), 700]), 0, 0) for i in range(3000)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    out = packing.pack(pieces, shard_rows=50).collect()
    assert len(out) == 3000 and len({p.doc_id for p in out}) == 3000
    assert check_packing(out) < 0.06 * sum(p.length for p in out)  # whole pieces: no plan does better


def test_segments_hold_the_miss_chance():
    p = math.acos(1.6 / 1.8) / math.pi
    for bits in range(24, 33):
        each = 1 - (1 - p) ** bits - bits * p * (1 - p) ** (bits - 1)
        n = simhash.segments_for(bits, 0.8, 0.05)
        assert each**n <= 0.05 < each ** (n - 1)


def test_near_duplicates_at_the_greatest_width(spark):
    rows, sets = [], {}
    for i in range(100):  # pairs just over the least similarity
        w = [f"w{i}_{k}" for k in range(404)]
        v = list(w)
        for k in range(10, 136, 18):
            v[k] = "changed"
        k = 200
        while jaccard(set(shingles(" ".join(w), 5)), set(shingles(" ".join([*v[:k], f"x{k}", *v[k + 1 :]]), 5))) >= 0.8:
            v[k] = f"x{k}"
            k += 1
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        sets[i] = jaccard(set(shingles(rows[-2][1], 5)), set(shingles(rows[-1][1], 5)))
    assert all(0.8 <= x < 0.81 for x in sets.values())
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bits=32).collect()}
    assert all(got[2 * i] == 2 * i for i in range(100))
    assert sum(got[2 * i + 1] == 2 * i for i in range(100)) >= 88  # 95 expected; 20 segments find 51


def test_near_duplicates_that_differ_in_repeats(spark):
    rows = []
    for i in range(20):
        w = [f"w{i}_{k}" for k in range(900)]
        phrase = [f"p{i}_{k}" for k in range(10)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w + phrase * 20)), (3 * i + 2, " ".join(w + phrase * 9))]
    a, b = (set(shingles(t, 5)) for _, t in rows[:2])
    assert 0.97 < jaccard(a, b) < 1 and set(shingles(rows[2][1], 5)) == b
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 3 * 3 for i in range(60)}


def test_near_duplicates_in_a_crowded_bucket(spark):
    """A family around one text: each variant is under 0.8 to the base and to other variants,
    but has one near copy, which only a comparison within the buckets finds."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(40):
        v = list(base)
        for k in rng.sample(range(0, 400, 5), 12):
            v[k] = f"v{i}_{k}"
        u = list(v)
        u[rng.randrange(1, 400)] = f"u{i}"
        rows += [(1 + i, " ".join(v)), (101 + i, " ".join(u))]
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    want = linked(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert want == {0: 0} | {i: i for i in range(1, 41)} | {100 + i: i for i in range(1, 41)}
    for crowd in (1024, 4):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()}
        assert got == want


# --- token counts


def greedy(word, first, later):
    at = n = 0
    while at < len(word):
        pool = later if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abcd", min_size=1, max_size=14), max_size=10))
def test_automaton_is_greedy_longest_match(first, later, found):
    automaton = wordpiece.Automaton(first, later)
    for w in found:
        assert automaton.length(w) == greedy(w, first, later)


def greedy_whole(word, first, later):
    """The mark and the word; a character without a piece is its bytes."""
    end = next((e for e in range(len(word), 0, -1) if word[:e] in first), 0)
    at, n = end, 1
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in later), None)
        at, n = end or at + 1, n + (1 if end else len(word[at].encode()))
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abñ", min_size=1, max_size=5), max_size=12), st.sets(st.text("abñ", min_size=1, max_size=5), max_size=12), st.lists(st.text("abñ中", min_size=1, max_size=14), max_size=10))
def test_whole_automaton_counts_every_word(first, later, found):
    automaton = wordpiece.Automaton(first, later, whole=True)
    for w in found:
        assert automaton.length(w) == greedy_whole(w, first, later)


def test_op6_counts_words_without_a_marked_piece(spark, tmp_path):
    model = Q.tokenizer_path("piece_bpe_32k.model")
    first, later = map(set, wordpiece.vocabulary(model))
    run = "ñ" + "中文字" * 2000 + "\U00013000"
    rows = [(1, "ñado"), (2, run), (3, "the ñado, ß")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in Q.op6_token_counts(spark, str(tmp_path)).collect()}
    assert got[1] == (1, 3, 0)  # the mark, ñ, ado
    assert got == {i: (len(words(t)), sum(greedy_whole(w, first, later) for w in words(t)), 0) for i, t in rows} and got[2][1] > 4000


def test_token_counts(spark):
    rows = list(enumerate(texts(40, 11))) + [(1000 + i, t) for i, t in enumerate(HARD)] + [(None, "a b"), (1, "again")]
    model = Q.tokenizer_path("piece_bpe_32k.model")
    out = wordpiece.token_counts(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string"), model).collect()
    first, later = map(set, wordpiece.vocabulary(model))
    want = Counter()
    for i, t in rows:
        n = [greedy(w, first, later) if len(w) < 1000 else wordpiece.Automaton(first, later).length(w) for w in words(t)]
        want[i, len(n), sum(n) + n.count(0), n.count(0)] += 1
    assert Counter(map(tuple, out)) == want
    assert wordpiece.token_counts(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


# --- WARC


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_archive_round_trip(spark, chunk):
    odd = ["", None, "\r\n\r\n", "a\n", "\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "é😀" * 50, "x" * 300, "\r", "no end\n\n"]
    rows = [(i, f"http://a/{i}", t) for i, t in enumerate(odd)] + [(100 + i, None, t) for i, t in enumerate(odd[2:])] + [(50, "http://x\r\ny", "own"), (None, "u", "own"), (3, "u", "a\n")]
    out = warc.archive_pages(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string"), chunk=chunk).collect()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = Counter()
    for i, _, t in rows:
        b, f = (t or "").encode(), first.get(t or "")
        mine = i is None or f == i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if mine else "revisit", None if mine else f] += 1
    assert Counter(map(tuple, out)) == want


def test_archive_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.archive_pages(pages, least_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_broken_archive_fails(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="breaks off"):
        warc.read_archives(spark, str(tmp_path)).collect()


# --- language model

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def plain_contexts(piece, i):
    """The two bytes before byte i of a piece, and its contexts, one by one."""
    mix = lambda h, x: ((h ^ (x * 0x2C1B3C6D & M32)) * 0xD3A2646D) & M32
    fold = lambda h: h ^ (h >> 15)
    h = 0
    for k in range(1, 5):
        h = fold(((h + (piece[i - k] + 1 if i >= k else 0)) * 0x2C1B3C6D) & M32)

    def start(j):  # of the word that holds byte j, or goes on there
        while j > 0 and piece[j - 1] not in b" \t\n\x0b\x0c\r":
            j -= 1
        return j

    def word(a, b):
        total, power = 0, 1
        for c in piece[a:b]:
            total, power = (total + (c + 1) * power) & M64, power * 0x9E3779B97F4A7C15 & M64
        return (((total + 0x51ED27) & M64) * 0xD6E8FEB86659FD93 & M64) >> 32

    begin = start(i)
    own = word(begin, i)
    last = tail = 0
    if begin:
        last = word(start(begin - 1), begin - 1)
        for k in range(1, 4):
            tail = (tail * 257 + (piece[begin - 1 - k] + 1 if begin - 1 - k >= 0 else 0)) & M32
    two = [piece[i - k] if i >= k else 255 for k in (2, 1)]
    return two[0] * 256 + two[1], {"four": h, "word": own, "tail": fold(mix(own, tail)), "last": fold(mix(own, last))}


def plain_path(code, before, byte):
    w = int(code.tree[before]) * 256 + byte
    return [int(x) for x in code.packed[code.first[w] : code.first[w] + code.length[w]]]


def plain_slot(h, packed, k, bits):
    return ((h ^ (packed & ~1)) * int(mixing._M[k]) & M32) >> (32 - bits)


def plain_counts(found, code, bits):
    tables = [np.zeros(2 << b, np.uint32) for b in bits]
    for t in found:
        for piece in mixing.pieces(t):
            for i, byte in enumerate(piece):
                before, hashes = plain_contexts(piece, i)
                for packed in plain_path(code, before, byte):
                    for k, name in enumerate(mixing.CONTEXTS):
                        tables[k][2 * plain_slot(hashes[name], packed, k, bits[k]) + (packed & 1)] += 1
    return tables


def plain_score(text, code, tables, bits, weights):
    """Total bits of a text, one decision after the other."""
    own, total = [0.0] * mixing.INPUTS, 0.0
    cells = [[mixing.PRIOR, mixing.PRIOR / (1 + math.exp(-((c + 0.5) / 2 - mixing.CELLS / 4)))] for c in range(mixing.CELLS)]
    for piece in mixing.pieces(text):
        held, stops, todo = {}, set(mixing.block_stops(len(piece)).tolist()), []
        for i, byte in enumerate(piece):
            before, hashes = plain_contexts(piece, i)
            guess, run = held.get(hashes[mixing.OWN], (None, 0))
            held[hashes[mixing.OWN]] = (byte, run + 1 if guess == byte else 1)
            way = plain_path(code, before, guess) if run else []
            for d, packed in enumerate(plain_path(code, before, byte)):
                x, seen = [], []
                for k, name in enumerate(mixing.CONTEXTS):
                    slot = plain_slot(hashes[name], packed, k, bits[k])
                    x.append(int(tables[k][slot]))
                    if name in mixing.SEEN:
                        seen.append(int(tables[len(mixing.CONTEXTS) + list(mixing.SEEN).index(name)][slot]))
                row = min(run, mixing.RUNS - 1) if d < len(way) and [w & 1 for w in way[:d]] == [w & 1 for w in plain_path(code, before, byte)[:d]] else 0
                sign = 1 if row and way[d] & 1 else -1
                x.append(sign * int(mixing.RUN_INPUT[row]))
                todo.append((x, (seen[0] * 4 + seen[1]) * mixing.RUNS + row, packed & 1))
            if i + 1 in stops or i + 1 == len(piece):
                slope, hits = [0.0] * mixing.INPUTS, []
                for x, gate, bit in todo:
                    t = max(-12, min(12, sum((weights[gate][k] / mixing.SCALE + own[k]) * v for k, v in enumerate(x))))
                    p = 1 / (1 + math.exp(-t))
                    cell = max(0, min(mixing.CELLS - 1, int((t + mixing.CELLS / 4) * 2)))
                    refined = max(1e-5, min(1 - 1e-5, p + mixing.REFINED * (cells[cell][1] / cells[cell][0] - p)))
                    total -= math.log2(refined if bit else 1 - refined)
                    slope = [s + (bit - p) * v for s, v in zip(slope, x, strict=True)]
                    hits.append((cell, bit))
                rate = mixing.RATE / mixing.SCALE**2 * min(1, mixing.CALM / len(todo))
                own = [w + rate * s for w, s in zip(own, slope, strict=True)]
                for cell, bit in hits:
                    cells[cell] = [cells[cell][0] + 1, cells[cell][1] + bit]
                todo = []
    return total


def byte_code(found):
    one, two = np.zeros((256, 256), np.int64), {}
    for t in found:
        s = b"\xff\xff" + t + b"\xff"
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            one[b, c] += 1
            two.setdefault(a * 256 + b, np.zeros(256, np.int64))[c] += 1
    return mixing.Code(one, {k: v for k, v in two.items() if v.sum() >= 40})


def train(found, bits=(14, 14, 14, 14), weights=None):
    code, tables = byte_code(found), [np.zeros(2 << b, np.uint32) for b in bits]
    for t in found:
        mixing.count(mixing.pieces(t), code, tables)
    return mixing.Mixer(code, mixing.trained(tables), weights), tables


def test_mixer_equals_one_that_goes_bit_by_bit(monkeypatch):
    found, bits = [t.encode() for t in texts(25, 12, length=60)], (10, 12, 12, 11)
    weights = np.random.default_rng(3).random((mixing.GATES, mixing.INPUTS)) * 0.4
    mixer, tables = train(found, bits, weights)
    for a, b in zip(tables, plain_counts(found, mixer.code, bits), strict=True):
        assert (a == b).all()
    odd = [b"", b"\n", b"  a  a  a\tb", "ñandú 中文字 ñandú".encode(), found[0], found[3] + b" " + found[3], b"x" * 300, bytes(range(255))]
    want = [plain_score(t, mixer.code, mixer.tables, bits, weights) for t in odd]
    assert np.allclose(mixer.score(odd), want, rtol=1e-4)
    monkeypatch.setattr(mixing, "SPAN", 130)  # long texts go on in pieces
    want = [plain_score(t, mixer.code, mixer.tables, bits, weights) for t in odd]
    assert np.allclose(mixer.score(odd), want, rtol=1e-4)


def test_mixer_is_a_probability_and_learns():
    mixer, _ = train([t.encode() for t in texts(60, 12)])
    one = mixer.score([bytes([b]) for b in range(255)])
    # The end's share after one byte differs by byte; all one-byte texts together stay below 1.
    assert sum(2.0**-x for x in one) < 1
    held, noise = [t.encode() for t in texts(20, 12)[-5:]], [bytes(random.Random(1).choices(range(97, 123), k=400))]
    assert mixer.score(held).sum() / sum(map(len, held)) < 3 < mixer.score(noise)[0] / 400


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    found = [t.encode() for t in texts(30, 13, length=200)] + [b"", b"x" * 5000]
    mixer, _ = train(found)
    whole = mixer.score(found)
    monkeypatch.setattr(mixing, "BATCH", 1500)
    assert np.allclose(mixer.score(found), whole, rtol=1e-5)


def test_newton_steps_lower_the_bits():
    found = [t.encode() for t in texts(60, 17)]
    mixer, _ = train(found[:40])
    weights, before = np.full((mixing.GATES, mixing.INPUTS), mixing.FIRST_WEIGHT), mixer.score(found[40:]).sum()
    for _ in range(3):
        x, gate, bit, *_ = mixer.inputs([t + b"\xff" for t in found[40:]])
        weights = mixing.newton_step(mixing.newton_sums(x, gate, bit, weights), weights)
    assert mixing.Mixer(mixer.code, mixer.tables, weights).score(found[40:]).sum() < before


def test_words_are_split_as_bytes_split_them():
    found = [*HARD, "", " a  b\ta ", "\x0b\x0c\r\n", "a\x1cb\x85c\u00a0d", "ÄÖ ä A"]
    found = [t or "" for t in found]
    some, many, at = lm_score.split_words(pc.ascii_lower(pa.array(found, pa.string())))
    got = [some[i] for i in at]
    want = [t.encode().lower().split() for t in found]
    assert got == [w for t in want for w in t] and many.tolist() == list(map(len, want)) and len(set(some)) == len(some)


def test_newton_sums_equal_plain_ones():
    rng = np.random.default_rng(5)
    x, gate, bit = [rng.integers(-127, 128, 3000).astype(np.int8) for _ in range(mixing.INPUTS)], rng.choice([0, 3, 63], 3000).astype(np.int16), rng.integers(0, 2, 3000).astype(np.uint8)
    weights = rng.random((mixing.GATES, mixing.INPUTS)) * 0.4
    want = np.zeros((mixing.GATES, mixing.INPUTS * (mixing.INPUTS + 1)))
    for i in range(3000):
        v = np.array([k[i] for k in x], float)
        p = 1 / (1 + math.exp(-max(-12, min(12, float(weights[gate[i]] @ v) / mixing.SCALE))))
        want[gate[i]] += np.concatenate((np.outer(v, v).ravel() * p * (1 - p), v * (p - bit[i])))
    assert np.allclose(mixing.newton_sums(x, gate, bit, weights), want, rtol=1e-4, atol=1e-1)


def test_lm_scores(spark):
    rows = list(enumerate(texts(150, 14))) + [(1000 + i, t) for i, t in enumerate(HARD)] + [(None, "an er th"), (5, texts(150, 14)[5])]
    out = lm_score.lm_scores(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")).collect()
    key = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    corpus = [words(lower(t or "")) for i, t in rows if key(i)]
    count = Counter(w for t in corpus for w in t)
    count[None] = len(corpus)
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        tokens = [*words(lower(t or "")), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[i, key(i) == 0, len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(r.score < 0 for r in out)
    plain = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.bits_per_byte * r.n_bytes for r in plain) / sum(r.n_bytes for r in plain) < 3
    assert lm_score.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lm_scores_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    out = lm_score.lm_scores(spark.createDataFrame([(i, t) for i, t in zip(held, ["a b", "", None], strict=True)], "doc_id long, text string")).collect()
    assert len(out) == 3 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in out)
    assert {r.doc_id: r.n_tokens for r in out} == dict(zip(held, (3, 1, 1), strict=True))


def test_lm_table_counts_survive_packing():
    counts = np.array([0, 1, 254, 255, 256, 70_000, 2**32 - 1, 0], np.uint32)
    sums = np.arange(8)
    lm_score.add_packed(sums, lm_score.pack(counts))
    assert (sums - np.arange(8)).tolist() == counts.tolist()


def test_lm_tables_are_added_one_slice_at_a_time():
    size, part = 2 * lm_score.SLICE, np.random.default_rng(1).integers(0, 300, 2 * lm_score.SLICE).astype(np.uint32)

    def batches():
        for at in range(20):
            packed = pa.array([lm_score.pack(part + at)] * 2, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([1, 1], pa.int32()), pa.array([at * lm_score.SLICE] * 2), pa.array([False, True]), packed], ["k", "at", "fit", "counts"])

    tracemalloc.start()
    done = [(r["which"], r["at"], r["done"]) for b in lm_score.summed(batches(), list(mixing.SIZES)) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == [(which, at * lm_score.SLICE, mixing.stretched((part.astype(np.int64) + at) * (which + 1)).tobytes()) for at in range(20) for which in (0, 1)]
    assert peak < 10 * size * 8  # all slices' sums are 40 times size * 8
