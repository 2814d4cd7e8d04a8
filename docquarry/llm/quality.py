"""Quality rules: fixed base rules plus thresholds that adapt to each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, apart, materialize, put, shuffled, words_of

WINDOW = 8
MINE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

#: Feature: (expression in whole units, least distance of the fence from the quartile).
#: All are integers, so that sketches and thresholds are exact in any engine.
FEATURES = {
    "symbols": ("n_symbols * 1000 div greatest(word_chars, 1)", 30),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 600),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 300),
    "stutter": ("n_stutter * 1000 div greatest(n_words, 1)", 300),
    "long_words": ("word_chars * 10 div greatest(n_words, 1)", 40),
}
FENCE = 6  # interquartile ranges
SUB = 16  # buckets per power of two
PRIOR = 20  # documents that the language counts for in each of its sources, and all in each language


def _with_later(step: int) -> Column:
    """Each hash combined with the one ``step`` places on."""
    return F.transform("__dq_hash", lambda h, i: F.xxhash64(h, F.get("__dq_hash", i + step)))


def count_features(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a
    word) and n_stutter (words equal to the one before), all long. Null text: all 0."""
    d = put(docs, __dq_text=F.coalesce(F.col("text"), F.lit("")))
    d = put(d, __dq_words=words_of(F.col("__dq_text")), __dq_full=F.filter(F.split("__dq_text", "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS[1:]}")))
    n = F.size("__dq_words")
    # Windows by their hash, by doubling: words, pairs, fours, eights. A text of fewer words
    # has none.
    d = put(d, __dq_hash=F.transform("__dq_words", lambda w: F.xxhash64(w)))
    pairs = F.size("__dq_hash") - F.size(F.array_compact(F.transform("__dq_hash", lambda h, i: F.nullif(h, F.get("__dq_hash", i - 1)))))
    d = put(d, __dq_stutter=pairs, __dq_hash=F.col("__dq_hash"))
    for step in (1, 2, 4):
        d = put(d, __dq_hash=_with_later(step))
    d = put(d, __dq_hash=F.slice("__dq_hash", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
    # Only texts with a repeated window pay for the sort: neighbours with equal hashes are
    # the repeated windows, and the union of their words is a walk over sorted starts.
    twice = F.size(F.array_distinct("__dq_hash")) < F.size("__dq_hash")
    d = put(d, __dq_sorted=F.when(twice, F.sort_array(F.transform("__dq_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    here = F.transform(
        "__dq_sorted",
        lambda s, j: F.when((s.h == F.get("__dq_sorted", j - 1).h) | (s.h == F.get("__dq_sorted", j + 1).h), s.i),
    )
    d = put(d, __dq_at=F.when(F.col("__dq_sorted").isNotNull(), F.sort_array(F.array_compact(here))))
    spans = F.transform("__dq_at", lambda p, j: F.coalesce(F.least(F.get("__dq_at", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    add = lambda acc, x: acc + x
    out = put(
        d,
        n_words=n.cast("long"),
        word_chars=F.aggregate("__dq_words", F.lit(0).cast("long"), lambda acc, w: acc + F.char_length(w)),
        n_symbols=F.char_length(F.regexp_replace("__dq_text", r"[^#*$%&|<>]+", "")).cast("long"),
        n_dup_lines=(F.size("__dq_full") - F.size(F.array_distinct("__dq_full"))).cast("long"),
        n_repeat_words=F.when(F.col("__dq_at").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(spans, F.lit(0).cast("long"), add)),
        n_lines=F.size("__dq_full").cast("long"),
        n_stutter=F.col("__dq_stutter").cast("long"),
    )
    return out.drop("__dq_text", "__dq_words", "__dq_full", "__dq_hash", "__dq_sorted", "__dq_at", "__dq_stutter")


def bucket(value: Column) -> Column:
    """The sketch bucket of a whole number >= 0: exact below 2 * SUB, then SUB buckets for
    each power of two (relative error under 1/SUB). Returns the bucket's lower end, so
    sketches merge by adding the counts of equal buckets."""
    shift = F.greatest(F.length(F.bin(value)) - F.length(F.bin(F.lit(SUB))), F.lit(0))
    width = F.expr("1L") * F.pow(F.lit(2), shift).cast("long")
    return F.floor(value / width).cast("long") * width


def sketches(counted: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: (lang, source, feature, bucket, n). A hot language or
    source is combined to its buckets before the shuffle."""
    pairs = F.array(*(F.struct(F.lit(k).alias("feature"), bucket(F.expr(e)).alias("bucket")) for k, (e, _) in FEATURES.items()))
    return counted.select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.feature", "p.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, limits map<feature, limit>) for every group in the sketch.

    A group's sketch counts its own documents and, with the weight of ``prior`` documents, the
    sketch of its language; that one likewise leans on the sketch of all. So a group's own
    documents decide the more there are of them, and no size switches anything. Weighted
    counts are whole numbers (all are brought to one denominator). The limit is the upper
    quartile plus ``FENCE`` interquartile ranges, and at least the feature's least distance
    above the quartile."""
    whole = "decimal(38,0)"
    every = sketch.groupBy("feature", "bucket").agg(F.sum("n").cast(whole).alias("n"))
    total = every.groupBy("feature").agg(F.sum("n").cast(whole).alias("total"))

    def leaning(s: DataFrame, keys: list[str], on: DataFrame, over: DataFrame, join: list[str]) -> DataFrame:
        """Counts of ``s`` by ``keys``, each ``over.total`` times, and ``prior`` times those of ``on``."""
        renamed = lambda df: df.withColumnsRenamed({k: f"__dq_{k}" for k in join})
        same = lambda a: [F.col(k).eqNullSafe(F.col(f"__dq_{k}")) for k in join]
        mine = [*keys, "feature", "bucket"]
        own = s.groupBy(*mine).agg(F.sum("n").cast(whole).alias("n"))
        scaled = own.join(renamed(over), same(own)).select(*mine, (F.col("n") * F.col("total")).cast(whole).alias("n"))
        groups = own.select(*keys, "feature").distinct()
        lent = groups.join(renamed(on), same(groups)).select(*mine, (F.col("n") * prior).cast(whole).alias("n"))
        return scaled.unionByName(lent).groupBy(*mine).agg(F.sum("n").cast(whole).alias("n"))

    by_lang = leaning(sketch, ["lang"], every, total, ["feature"])
    of_lang = by_lang.groupBy("lang", "feature").agg(F.sum("n").cast(whole).alias("total"))
    own = leaning(sketch, ["lang", "source"], by_lang, of_lang, ["lang", "feature"])
    part = Window.partitionBy("lang", "source", "feature")
    ranked = own.withColumn("upto", F.sum("n").over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum("n").over(part))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bucket")))
    fences = ranked.groupBy("lang", "source", "feature").agg(at(1).alias("q1"), at(3).alias("q3"))
    slack = F.create_map(*(x for k, (_, s) in FEATURES.items() for x in (F.lit(k), F.lit(s).cast("long"))))
    limit = F.col("q3") + F.greatest((F.col("q3") - F.col("q1")) * FENCE, slack[F.col("feature")])
    return fences.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("feature", limit.alias("limit")))).alias("limits"))


def quality_rules(docs: DataFrame, prior: int = PRIOR, most_broadcast: int = 100_000, keep_text: bool = True) -> DataFrame:
    """Judge ``docs`` (doc_id, text, lang, source, ...): adds n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed and kept (boolean).

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows.
    kept: not base_failed, and no feature above the adaptive limit of the row's language
    and source (``thresholds``). Null lang or source form groups of their own. Empty tables
    give no rows; repeated rows are judged alike and count each; null or empty text has no
    words, so it fails. Very long texts are counted whole. Other columns pass through.

    The counted table is written once; its sketch and its filter both read that table. The
    thresholds are broadcast only while they are at most ``most_broadcast`` groups, else
    they are joined by shuffle. ``keep_text=False`` leaves the text out of all this.
    """
    docs, back = apart(docs)
    names = [c for c in docs.columns if c.lower() not in MINE and (keep_text or c.lower() != "text")]
    # Input columns that share a name with a counted one, but are not replaced, step aside.
    aside = {c: f"__dq_in_{c}" for c in names if c.lower() in ("n_lines", "n_stutter")}
    counted = count_features(docs.withColumnsRenamed(aside))
    counted = materialize(counted if keep_text else counted.drop("text"), "quality")
    limits = materialize(thresholds(sketches(counted), prior), "limits")
    limits = limits.withColumnsRenamed({"lang": "__dq_lang", "source": "__dq_source", "limits": "__dq_limits"})
    limits = F.broadcast(limits) if limits.count() <= most_broadcast else shuffled(limits)
    judged = counted.join(limits, F.col("lang").eqNullSafe(F.col("__dq_lang")) & F.col("source").eqNullSafe(F.col("__dq_source")), "left")
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    above = F.lit(False)
    for k, (e, _) in FEATURES.items():
        above = above | F.coalesce(F.expr(e) > F.col("__dq_limits")[k], F.lit(False))
    out = put(judged, base_failed=failed, kept=~failed & ~above)
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(back.get(c, c)) for c in names), *MINE)
