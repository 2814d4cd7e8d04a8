"""Benchmark decontamination: item-sized windows of documents against benchmark items."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, put, shuffled, words_of

SHINGLE = 5
WORDS = 2  # of 64 bits in a fingerprint


def radius_for(similarity: float) -> int:
    """The bits by which fingerprints of windows that similar may differ: 4.6 deviations above
    the mean of a binomial model (missed: about 1 in 400,000). A bit differs with a chance
    of at most acos(c)/pi, as the cosine c is at least 2s/(1+s)."""
    n, p = 64 * WORDS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(n * p + 4.6 * math.sqrt(n * p * (1 - p)))


def _shingles(words: str, size: int) -> Column:
    """Hashes of all ``size``-word shingles of an array of word hashes (none if shorter)."""
    n = F.size(words)
    each = F.transform(words, lambda h, i: F.xxhash64(h, *(F.get(words, i + j) for j in range(1, size)))) if size > 1 else F.col(words)
    return F.slice(each, F.lit(1), F.greatest(n - (size - 1), F.lit(0)))


def _hashed(df: DataFrame) -> DataFrame:
    """``__dq_w``: the hashes of the lower-cased words of ``text``."""
    d = put(df, __dq_w=words_of(lower_ascii(F.coalesce(F.col("text"), F.lit("")))))
    return put(d, __dq_w=F.transform("__dq_w", lambda w: F.xxhash64(w)))


def simhash(hashes: Column) -> Column:
    """SimHash of an array of 64-bit hashes, as an array of WORDS 64-bit words: a bit is 1 if set
    in over half of the hashes (in the later words, of hashes derived from them)."""

    def word(k: int) -> Column:
        own = hashes if k == 0 else F.transform(hashes, lambda h: F.xxhash64(F.lit(k), h))
        ones = lambda b: F.aggregate(own, F.lit(0), lambda s, h: s + F.call_function("getbit", h, b))
        bit = lambda b: F.when(ones(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))

    return F.array(*(word(k) for k in range(WORDS)))


def edges(blocks: int) -> list[list[tuple[int, int]]]:
    """Where each word is cut: its blocks, as (first bit, bit after the last)."""
    per = [blocks // WORDS + (k < blocks % WORDS) for k in range(WORDS)]
    return [[(64 * i // n, 64 * (i + 1) // n) for i in range(n)] for n in per]


def _blocks(fp: Column, radius: int) -> Column:
    """The fingerprint cut into one block more than ``radius``, so that two within the radius
    agree in some block: array<struct<block, value>>."""
    cut = lambda k, a, b: F.shiftrightunsigned(fp[k], a).bitwiseAND((1 << (b - a)) - 1) if b - a < 64 else fp[k]
    cuts = [(k, a, b) for k, word in enumerate(edges(max(radius + 1, WORDS))) for a, b in word]
    return F.array(*(F.struct(F.lit(i).alias("block"), cut(k, a, b).alias("value")) for i, (k, a, b) in enumerate(cuts)))


def find_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, most_broadcast: int = 500_000, radius: int | None = None) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, distance): for each document and
    benchmark item with a similar item-sized window, the most similar one (ties: the first):
    word offset and length, weighted-shingle similarity, Hamming distance of the fingerprints.

    Similarity: sum of the lesser over sum of the greater multiplicities of the five-word
    shingles of window and item, lower-cased. Windows are as long as an item (or as the
    document, if that is shorter). Of these, a similar one holds at least
    ceil(s (n + m) / (1 + s)) of some item's n shingles among its m; this exact bound, which
    loses nothing, leaves out windows that can match no item, and forgets the item. What is
    left is fingerprinted, and its Hamming blocks meet those of the items of that length: all
    fingerprints within the radius meet in some block. Those within the radius are verified
    by their exact similarity, and the best window of each document and item is kept.

    Items are compared by normalised text; of items with equal texts the least item_id
    stands for all. Items of fewer than five words are one shingle of all their words; items
    without words match nothing. A document shorter than an item is one window. Null or empty
    texts have no words; null ids keep their rows; repeated rows give the same match once.
    Either table empty: no rows. Other columns are not read. Tables of at most
    ``most_broadcast`` rows (counted first) are broadcast; larger ones are joined by shuffle.
    ``radius`` (by default ``radius_for``) sets the distance that is looked at.
    """
    radius = radius_for(similarity) if radius is None else radius
    small = lambda df: F.broadcast(df) if df.count() <= most_broadcast else shuffled(df)
    items = _hashed(benchmark.select("item_id", "text")).where(F.size("__dq_w") > 0).groupBy("__dq_w").agg(F.min("item_id").alias("item_id"))
    items = put(items, size=F.least(F.size("__dq_w"), F.lit(SHINGLE)), n_words=F.size("__dq_w"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # 1 to 5 at most
    whole = lambda df: F.coalesce(*(F.when(F.col("size") == k, _shingles("__dq_w", k)) for k in sizes)) if sizes else F.col("__dq_w")
    items = put(items, h=whole(items))
    items = materialize(put(items, n=F.size("h"), item_fp=simhash(F.col("h"))), "items")  # h: in order, repeats included
    spread = items.select("item_id", "size", "n", F.explode("h").alias("h")).groupBy("item_id", "size", "n", "h").agg(F.count("*").alias("c"))
    spread = small(materialize(spread, "item-shingles"))

    base = _hashed(docs.select("doc_id", "text"))
    base = put(base, mark=F.xxhash64(F.coalesce("text", F.lit("")), F.lit(7)), total=F.size("__dq_w")).drop("text")
    hits = None
    for k in sizes:
        each = base.select("doc_id", "mark", "total", F.posexplode(_shingles("__dq_w", k)).alias("p", "h"))
        found = each.join(spread.where(F.col("size") == k), "h").select("doc_id", "mark", "item_id", "size", "n", "c", (F.col("total") - k + 1).alias("held"), "p", "h")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:  # no items
        hits = base.join(spread, base.mark == spread.h).select("doc_id", "mark", "item_id", "size", "n", "c", F.lit(0).alias("held"), F.lit(0).alias("p"), "h").limit(0)
    # p, then hash and item multiplicity, of each shared shingle; a document's repeated rows merge.
    grouped = hits.groupBy("doc_id", "mark", "item_id", "size", "n", "held").agg(F.sort_array(F.collect_set(F.struct("p", "h", "c"))).alias("at"))
    grouped = grouped.withColumn("m", F.least("n", "held"))
    need = F.ceil(F.lit(similarity) * (F.col("n") + F.col("m")) / (1 + similarity) - 1e-9).cast("int")
    grouped = grouped.withColumn("need", F.greatest(need, F.lit(1))).where(F.size("at") >= F.col("need")).withColumn("ps", F.col("at.p"))
    # A window may as well start at its first shared shingle, or end with the document.
    start = lambda p, j: F.struct(F.least(p, F.col("held") - F.col("m")).alias("s"), j.alias("j"))
    enough = F.transform("ps", lambda p, j: F.when(F.get("ps", j + F.col("need") - 1) < p + F.col("m"), start(p, j)))
    grouped = grouped.withColumn("starts", F.array_compact(enough)).where(F.size("starts") > 0)
    # Positions rise, so a window's are among the m on either side of its first.
    near = lambda x: F.slice("at", F.greatest(x.j + 1 - F.col("m"), F.lit(1)), 2 * F.col("m"))
    inside = lambda s: F.filter(near(s), lambda x: (x.p >= s.s) & (x.p < s.s + F.col("m")))
    # Of each hash, occurrences in the window count up to the item's: the similarity grows with
    # their sum, as the sizes of window and item are fixed.
    hashes = lambda w: F.array_distinct(F.transform(w, lambda x: F.struct(x.h.alias("h"), x.c.alias("c"))))
    per = lambda w: F.transform(hashes(w), lambda y: F.least(F.size(F.filter(w, lambda x: x.h == y.h)).cast("long"), y.c))
    each = F.transform(F.transform("starts", lambda s: F.struct(s.s.alias("s"), inside(s).alias("w"))), lambda x: F.struct(per(x.w).alias("per"), x.s.alias("s")))
    shared = lambda x: F.aggregate(x.per, F.lit(0).cast("long"), lambda s, n: s + n)
    likely = F.filter(F.transform(each, lambda x: F.struct(x.s.alias("start"), shared(x).alias("shared"))), lambda x: x.shared >= F.col("need"))
    windows = grouped.select("doc_id", "mark", "size", "n", "m", F.explode(likely).alias("w")).select("doc_id", "mark", "size", "n", "m", "w.start").distinct()
    windows = materialize(windows, "windows")

    keys = small(windows)
    own = base.join(keys, base["doc_id"].eqNullSafe(keys["doc_id"]) & (base["mark"] == keys["mark"])).drop(base["doc_id"]).drop(base["mark"])
    cut = own.withColumn("h", F.slice("__dq_w", F.col("start") + 1, F.col("m") + F.col("size") - 1))
    cut = cut.withColumn("h", F.coalesce(*(F.when(F.col("size") == k, _shingles("h", k)) for k in sizes)) if sizes else F.col("h"))
    one = ["doc_id", "mark", "size", "n", "m", "start"]
    prints = materialize(cut.select(*one, "h", simhash(F.col("h")).alias("fp")).dropDuplicates(one), "prints")
    # Which items of that length lie within the radius: blocks of both sides meet.
    probes = prints.select("*", F.explode(_blocks(F.col("fp"), radius)).alias("b"))
    table = small(materialize(items.select("item_id", "item_fp", "size", "n", F.explode(_blocks(F.col("item_fp"), radius)).alias("b")), "blocks"))
    distance = sum((F.bit_count(F.col("fp")[k].bitwiseXOR(F.col("item_fp")[k])) for k in range(WORDS)), F.lit(0))
    met = probes.join(table, ["size", "n", "b"]).withColumn("distance", distance).where(F.col("distance") <= radius).dropDuplicates([*one, "item_id"])
    # The exact similarity: of each shingle the lesser of both multiplicities.
    pair = [*one, "item_id", "distance"]
    own = met.select(*pair, F.explode("h").alias("h")).groupBy(*pair, "h").agg(F.count("*").alias("here"))
    both = own.join(spread.select("item_id", "h", "c"), ["item_id", "h"]).groupBy(*pair).agg(F.sum(F.least("here", "c")).alias("shared"))
    alike = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    sure = both.withColumn("similarity", alike).where(F.col("similarity") >= similarity)
    return sure.groupBy("doc_id", "item_id").agg(
        F.min_by(F.struct("start", (F.col("m") + F.col("size") - 1).alias("n_words"), "similarity", "distance"), F.struct(-F.col("similarity"), "start", "mark")).alias("w")
    ).select("doc_id", "item_id", "w.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item (``find_matches``). Rows without
    a doc_id stay; null and empty texts hold none; of rows that repeat a doc_id all go if one
    does. Either table empty: all rows stay. All columns pass through."""
    bad = find_matches(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
