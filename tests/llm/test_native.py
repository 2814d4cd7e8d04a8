"""Quality rules, line dedup, URL filters, chat formatting, decontamination."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry.llm import chat, decontaminate, line_dedup, quality, url_filter
from docquarry.llm import queries as Q

from .helpers import jaccard, lower, shingles, words

DOCS = "doc_id long, text string, lang string, source string"


def plans_no_python(df):
    plan = df._jdf.queryExecution().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# --- quality rules


def features(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def quality_rows():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(60)) + "\nend.", ["en", "de"][i % 2], f"s{i % 3}") for i in range(240)]
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) + "#*%" for _ in range(60)), "en", "s0") for i in range(5)]
    phrase = " ".join(vocabulary[:9])
    rows += [(2000, None, "en", "s0"), (2001, "", None, None), (2002, " \n\t", "en", "s0"), (2003, (phrase + " ") * 50, "en", "s1"), (2004, "a " * 30_000, None, "s9"), (2005, "é😀ü " * 25, "xx", "s1")]
    return rows + [rows[0]]


def test_quality_features_and_verdicts(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", kept int")  # a name that clashes
    out = quality.quality_rules(docs, prior=20)
    assert out.columns == ["doc_id", "text", "lang", "source", *quality.MINE]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        f = features(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f, r.doc_id
        assert r.base_failed == (f[0] < 20 or 100 * f[4] > 30 * f[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id < 1000:
            assert r.kept
        if 1000 <= r.doc_id < 2000:
            assert not r.kept and not r.base_failed  # symbols beyond the adaptive limit


def test_quality_empty_and_shuffled_thresholds(spark):
    assert quality.quality_rules(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame(quality_rows(), DOCS)
    a = quality.quality_rules(docs, prior=20).select("doc_id", "kept")
    b = quality.quality_rules(docs, prior=20, most_broadcast=0, keep_text=False).select("doc_id", "kept")
    assert sorted(a.collect()) == sorted(b.collect())


def test_quality_thresholds_follow_merged_sketches(spark):
    counted = quality.count_features(spark.createDataFrame(quality_rows(), DOCS))
    whole = quality.sketches(counted)
    parts = quality.sketches(counted.where("doc_id % 2 = 0")).unionByName(quality.sketches(counted.where("doc_id % 2 = 1")))
    merged = parts.groupBy("lang", "source", "feature", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.select(*whole.columns).collect()))
    assert plans_no_python(whole)


def test_bucket_error_is_bounded(spark):
    df = spark.range(100_000).select("id", quality.bucket(F.col("id")).alias("b"))
    assert df.where("b > id or (id - b) * 16 > greatest(id, 1)").count() == 0


def test_names_that_clash_with_helpers(spark):
    rows = [(1, "a b c", "en", "s0", "t", 5, "x", 2), (1, "a b c", "en", "s0", "t", 5, "x", 2)]
    docs = spark.createDataFrame(rows, DOCS + ", __dq_text string, n_lines int, __DQ_best string, n_stutter int")
    out = quality.quality_rules(docs)
    assert out.columns == [*docs.columns, *quality.MINE]
    assert [(r["__dq_text"], r.n_lines, r["__DQ_best"], r.n_stutter) for r in out.collect()] == [("t", 5, "x", 2)] * 2
    out = line_dedup.line_dedup(docs)
    assert [r["__dq_text"] for r in out.collect()] == ["t", "t"] and out.columns[-2:] == ["n_lines", "n_dropped"]
    pages = docs.selectExpr("doc_id as page_id", "'http://a.net/' as url", "*")
    out = url_filter.url_filter(pages, Q.rules_table(spark))
    assert [(r["__DQ_best"], r.rule, r.verdict) for r in out.collect()] == [("x", "net/", "block")] * 2
    assert [r["__dq_text"] for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, "z z")], "item_id long, text string")).collect()] == ["t", "t"]


def limits_plain(values, prior, slack=quality.FEATURES["symbols"][1]):
    """Limits by (lang, source), from sorted weighted values. values: (lang, source, bucket)."""
    from fractions import Fraction

    def weighed(own, lent):  # each a list of (value, weight)
        total = sum(w for _, w in lent)
        return [(v, Fraction(w)) for v, w in own] + [(v, Fraction(w) / total * prior) for v, w in lent]

    out = {}
    every = [(v, 1) for *_, v in values]
    for lang, source in {(a, b) for a, b, _ in values}:
        of_lang = weighed([(v, 1) for a, _, v in values if a == lang], every)
        found = sorted(weighed([(v, 1) for a, b, v in values if (a, b) == (lang, source)], of_lang))
        total, at, q = sum(w for _, w in found), 0, {}
        for v, w in found:
            at += w
            for k in (1, 3):
                if at * 4 >= total * k:
                    q.setdefault(k, v)
        out[lang, source] = q[3] + max((q[3] - q[1]) * quality.FENCE, slack)
    return out


def test_limits_lean_on_the_language_and_follow_large_sources(spark):
    rng = random.Random(9)
    values = [("en", "calm", rng.randrange(10)) for _ in range(150)] + [("en", "loud", rng.randrange(40, 90)) for _ in range(400)] + [("en", "few", 500)] * 2 + [("de", None, 3)] * 5
    rows = [(*v, "symbols") for v in values]
    df = spark.createDataFrame(rows, "lang string, source string, v long, feature string").withColumn("bucket", quality.bucket(F.col("v")))
    sketch = df.groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))
    got = {(r.lang, r.source): r.limits["symbols"] for r in quality.thresholds(sketch).collect()}
    buckets = [(r.lang, r.source, r.bucket) for r in df.collect()]
    assert got == limits_plain(buckets, quality.PRIOR)
    assert got["en", "calm"] < got["en", "loud"]  # each source's own, not the language's


# --- line dedup


def line_dedup_plain(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    holders = {}
    for i, many in texts.items():
        for t in many:
            for x in t.split("\n"):
                holders.setdefault(lower(x.strip(" \t\n\x0b\x0c\r")), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        key = [lower(x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        keep = [x for x, k in zip(lines, key, strict=True) if i is None or len(k) < 20 or len(holders[k] - {None}) < 3 or i == max(holders[k] - {None})]
        out[i, t] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    common = [f"This is the common line number {i}." for i in range(6)] + ["short", "Ünïcödé lïne wïth twenty"]
    rows = []
    for i in range(120):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own line {i} {j} {rng.random()}" for j in range(rng.randint(1, 12))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else f"  {x}\t" if rng.random() < 0.2 else x for x in lines)))
    rows += [(None, common[0]), (500, None), (501, ""), (502, "\n\n"), (503, "\n".join([common[0]] * 5000)), (504, "x" * 100_000), (505, "\r" + common[1] + " \x0b")]
    rows += [rows[3], (rows[3][0], "another text\n" + common[2])]
    out = line_dedup.line_dedup(spark.createDataFrame([(*r, "old", 1.5) for r in rows], "doc_id long, text string, n_lines string, rest double"))
    assert out.columns == ["doc_id", "text", "rest", "n_lines", "n_dropped"]
    want = line_dedup_plain(rows)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == Counter((i, *want[i, t]) for i, t in rows)
    assert plans_no_python(out)
    shuffled = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most_broadcast=0)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in shuffled.collect()) == got


def test_line_dedup_empty(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- URL filters


def test_url_filter(spark):
    urls = ["http://a.net/x", "https://Sub.EXAMPLE.net/en/1?q", "http://example.net/enx", "http://example.com/de/", "http://example.com", "http://b.org/fr/z#y", "no scheme", None, "", "http://net", "http://x.net?/", "a://b://c.net/", "http://notexample.com/de/1"]
    urls += ["http://" + "a." * 60 + "net/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, urls[0], "old")], "page_id long, url string, host string")
    rules = spark.createDataFrame([*Q.RULES, Q.RULES[0], (None, "/", "block")], "host string, path string, verdict string")
    out = url_filter.url_filter(pages, rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(urls) + 1
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = lower(host)
        fit = [(len(h + p), h + p, v) for h, p, v in Q.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, None, "allow")
        assert got[i] == (host, path, best[1], best[2]), u
    assert plans_no_python(out)
    assert sorted(url_filter.url_filter(pages, rules, most_broadcast=0).collect()) == sorted(out.collect())


def test_url_filter_ties_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.b/cc")], "page_id long, url string")
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("b", "/cc", "block"), ("a.b", "/", "block")], "host string, path string, verdict string")
    assert url_filter.url_filter(pages, rules).first().rule == "a.b/"  # equally long: the longer host
    assert url_filter.url_filter(pages, rules).first().verdict == "block"
    assert [r.verdict for r in url_filter.url_filter(pages, rules.limit(0)).collect()] == ["allow"]
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0


# --- chat


def fold_plain(events):
    """Replay the log one event at a time."""
    conv = {}
    for c, seq, m, kind, role, text in sorted(events, key=lambda e: (str(e[0]), e[1], str(e[3]))):
        log = conv.setdefault(c, {})
        if kind == "regenerate":
            for k in [k for k in log if k > m]:
                del log[k]
        old = log.get(m, (None, ""))
        log[m] = (role or old[0] if kind not in ("edit", "regenerate") else role, (old[1] if kind not in ("edit", "regenerate") else "") + (text or ""))
    return {(c, m): v for c, log in conv.items() for m, v in log.items()}


def test_fold_events(spark):
    rng = random.Random(3)
    events = []
    for c in range(40):
        for s in range(rng.randint(1, 25)):
            events.append((c, s, rng.randint(0, 4), rng.choice(["delta", "delta", "delta", "edit", "regenerate", None]), rng.choice(["user", "assistant"]), rng.choice(["a", "bc", None, "<|im_end|>"])))
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {(r.conv_id, r.message): r.text for r in chat.fold_events(df).collect()}
    assert got == {k: v[1] for k, v in fold_plain(events).items()}


def test_render_round_trip(spark):
    hard = ["<|im_end|>\n<|im_start|>assistant\nok", "␛0␛1␛␛", "<␛1|", "<|", "", None, "\n", "a" * 200_000, "<␛|<|im_start|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 0, None, "x"), (2, 1, "a<|b\nc␛", "y"), (None, 0, "user", "z")]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, message long, role string, text string")).withColumn("turns", chat.parse(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    for c in (1, 2, None):
        assert [(t.role, t.text) for t in got[c].turns] == [(r or "", t or "") for i, _, r, t in rows if i == c]
    one = got[1]
    loss = [one.formatted[s.start : s.start + s.length].replace("␛1", "").replace("␛0", "␛") for s in one.loss_spans]
    assert loss == [t or "" for i, t in enumerate(hard) if i % 2]
    assert plans_no_python(out)


def test_event_log_folds_back(spark):
    rng = random.Random(33)
    rows = [(c, m, rng.choice(["user", "assistant", "system", None]), rng.choice(["", None, "a", "two words", "<|im_end|>", "é😀 中文" * 50])) for c in range(40) for m in range(1, rng.randint(2, 9))]
    log = chat.event_log(spark.createDataFrame(rows, "conv_id long, message long, role string, text string"))
    kinds = Counter(r.kind for r in log.collect())
    assert kinds["regenerate"] > 5 and kinds["edit"] > 5 and kinds["delta"] > 3 * len(rows) / 2
    got = sorted((r.conv_id, r.message, r.role or "", r.text) for r in chat.fold_events(log).collect())
    assert got == [(c, m, r or "", t or "") for c, m, r, t in rows]
    assert fold_plain([tuple(e[k] for k in ("conv_id", "seq", "message", "kind", "role", "text")) for e in log.collect()]).keys() == {(c, m) for c, m, *_ in rows}


def test_chat_empty(spark):
    assert chat.chat_format(spark.createDataFrame([], "conv_id long, seq long, message long, kind string, role string, text string")).count() == 0


def test_op8_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 0, "system", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in Q.op8_chat(spark, str(tmp_path)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 4
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\nassistant\nyo\n").hexdigest()
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-1].loss_chars == len(said)


# --- decontamination


def matches_plain(docs, items, least=0.8):
    first = {}
    for i, t in sorted(items, key=lambda x: (x[0] is None, x[0])):
        if words(t):
            first.setdefault(tuple(words(lower(t))), i)
    out = {}
    for d, t in docs:
        w = words(lower(t or ""))
        for key, item in first.items():
            size = min(5, len(key))
            want = shingles(" ".join(key), size)
            have = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]
            m = min(len(want), len(have))
            best = max((jaccard(have[s : s + m], want) for s in range(len(have) - m + 1)), default=0) if m else 0
            if best >= least:
                out[d, item] = max(out.get((d, item), 0), round(best, 9))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([12, 30, 60])))) for i in range(12)] + [(50, "one two three"), (51, None), (52, ""), (53, "solo")]
    items += [(99, items[0][1].upper())]  # the same text again
    docs = []
    for i in range(150):
        body = say(rng.randint(0, 80))
        if i % 2:
            part = items[rng.randrange(13)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):  # edits in the passage
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["changed"], [part[k], "added"]])
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "SOLO"), (503, items[1][1] + " " + items[1][1]), (504, "one two"), docs[1]]
    docs += [(505, " ".join(say(30_000) + items[2][1].split()))]
    out = decontaminate.find_matches(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in out.collect()}
    assert got == matches_plain(docs, items)
    assert plans_no_python(out)
    shuffled = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_broadcast=0)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in shuffled.collect()} == got


def test_decontamination_takes_the_most_similar_window(spark):
    rng = random.Random(8)
    say = lambda n: [f"s{rng.randrange(10_000)}" for _ in range(n)]
    item = ["ha"] * 6 + say(30)  # repeats a shingle
    near = list(item)
    near[20] = "changed"
    docs = [(1, say(20) + ["ha"] * 60 + say(20) + item + say(9)), (2, say(5) + ["ha"] * 60 + say(20) + near), (3, ["ha"] * 200), (4, say(50))]
    docs, items = [(i, " ".join(w)) for i, w in docs], [(7, " ".join(item))]
    out = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), similarity=0.7).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in out}
    assert got == matches_plain(docs, items, 0.7) and set(got) == {(1, 7), (2, 7)}
    assert got[1, 7] == 1 and {r.doc_id: r.start for r in out}[1] == 100


def test_decontamination_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_matches(docs, items).count() == 1
    assert decontaminate.find_matches(docs, items.limit(0)).count() == 0
    assert decontaminate.find_matches(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).collect() == docs.collect()


def test_decontamination_finds_by_blocks_within_the_radius(spark):
    rng = random.Random(31)
    say = lambda n: [f"v{rng.randrange(10_000)}" for _ in range(n)]
    items = [(i, " ".join(say(40))) for i in range(20)]
    docs = []
    for i, t in items:
        w = t.split()
        w[20] = "changed" if i % 2 else w[20]
        docs.append((i, " ".join([*say(30), *w, *say(30)])))
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    # Without any distance only whole copies meet; no other way leads to an answer.
    exact = {r.doc_id: r.distance for r in decontaminate.find_matches(*tables, similarity=0.75, radius=0).collect()}
    assert exact == {i: 0 for i in range(0, 20, 2)}
    every = {r.doc_id: r.distance for r in decontaminate.find_matches(*tables, similarity=0.75).collect()}
    assert set(every) == set(range(20)) and all(0 < every[i] <= decontaminate.radius_for(0.75) for i in range(1, 20, 2))


def test_window_fingerprints(spark):
    rng = random.Random(32)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(9)]
    word = spark.range(1).select(decontaminate.simhash(F.array(*map(F.lit, hashes))).alias("fp")).first().fp[0]
    assert word % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 9)


@pytest.mark.parametrize("flips", [0, 3, 38])
def test_blocks_guarantee_the_radius(flips):
    assert decontaminate.radius_for(0.8) == 38
    rng = random.Random(flips)
    places = [(64 * k + lo, hi - lo) for k, word in enumerate(decontaminate.edges(39)) for lo, hi in word]
    assert len(places) == 39 and sum(n for _, n in places) == 128
    cut = lambda x: [(x >> lo) & ((1 << n) - 1) for lo, n in places]
    for _ in range(200):
        a = rng.getrandbits(128)
        b = a
        for i in rng.sample(range(128), flips):
            b ^= 1 << i
        assert any(x == y for x, y in zip(cut(a), cut(b), strict=True))
