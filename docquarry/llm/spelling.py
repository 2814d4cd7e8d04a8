"""Spelling variants: words that differ by one code point, found by full neighbourhood generation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, lower_ascii, materialize

#: Runs of letters; every one lies below U+0100, so 256 entries hold what belongs to a letter.
NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
#: Bits of the filter for each word of the vocabulary, probes a candidate, and most bits (64 MB).
FILTER_BITS, PROBES, MOST_BITS = 32, 3, 1 << 29
#: Candidates that a task holds at once.
AT_ONCE = 1 << 17
#: Words of a task that makes candidates: about 1,300 each.
WORDS_A_TASK = 20_000

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_LETTER = np.random.default_rng(11).integers(1, _M64, 256, dtype=np.uint64, endpoint=True)


def count_words(docs: DataFrame, least_chars: int = 5, least_n: int = 3, thin: int = 97) -> DataFrame:
    """(word, n) over the whole texts of ``docs`` (doc_id, text): maximal runs of the letters
    A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. Where ``thin`` divides h, the unsigned
    crc32 of ``<doc_id>:<run>``, the code point at h % length is left out (0: nowhere). Words
    of at least ``least_chars`` code points and ``least_n`` occurrences stay.

    Counts are combined before the shuffle, so a frequent word is one row a task. Null text:
    no words; null doc_id: an empty id; repeated rows count each; empty table: no rows; other
    columns are not looked at.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.split(F.coalesce("text", F.lit("")), NOT_LETTERS)).alias("run"))
    runs = runs.where(F.char_length("run") >= least_chars).select("id", lower_ascii(F.col("run")).alias("run"))
    if thin:
        runs = runs.withColumn("h", F.crc32(F.encode(F.concat_ws(":", "id", "run"), "utf-8")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        runs = runs.select(F.when(F.col("h") % thin == 0, short).otherwise(F.col("run")).alias("run")).where(F.char_length("run") >= least_chars)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _places(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (_mixed(h + np.uint64(probe * 0x632BE59BD9B4E019 & _M64)) & np.uint64(bits - 1)).astype(np.int64)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]), dtype=np.uint64)


def _same_length(words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words by length, with their code points as a matrix."""
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for size, group in by.items():
        yield group, np.frombuffer("".join(group).encode("latin-1"), np.uint8).reshape(len(group), size)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash (mod 2^64) of each row."""
    with np.errstate(over="ignore"):
        return (_LETTER[codes] * _powers(codes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def neighbours(words: list[str], letters: np.ndarray, bits: int, full: np.ndarray) -> Iterator[tuple[str, str]]:
    """(word, candidate) for every distinct string that one deleted, replaced or inserted code
    point (of ``letters``) makes of a word, less those that the filter ``full`` rules out.

    Each candidate is made once: of equal letters in a row the first is deleted, and a letter
    is not inserted behind itself. Hashes follow from those of prefix and suffix; only
    candidates that pass the filter are written out as strings.
    """
    plain = [chr(c) for c in letters]
    for group, every in _same_length(words):
        size = every.shape[1]
        power = _powers(size + 1)
        step = max(1, AT_ONCE // ((size + 1) * len(letters)))
        span = max(1, AT_ONCE // (step * len(letters)))  # positions at once, for very long words
        for low in range(0, len(group), step):
            codes, some = every[low : low + step], group[low : low + step]
            with np.errstate(over="ignore"):
                terms = _LETTER[codes] * power[:size]
                before = np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
                after = before[:, -1:] - before  # of the letters from i on, in their places
                gone = before[:, :size] + after[:, 1:] * _BACK
                first = np.ones(codes.shape, bool)
                first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                for w, i in _passing(gone, first, bits, full):
                    yield some[w], some[w][:i] + some[w][i + 1 :]
                for at in range(0, size + 1, span):
                    to = min(size, at + span)
                    # Replaced letters ...
                    if at < to:
                        new = (before[:, -1:] - terms[:, at:to])[:, :, None] + _LETTER[letters][None, None, :] * power[at:to, None]
                        for w, i, k in _passing(new, codes[:, at:to, None] != letters, bits, full):
                            yield some[w], some[w][: at + i] + plain[k] + some[w][at + i + 1 :]
                    # ... and inserted ones.
                    to = min(size + 1, at + span)
                    new = (before[:, at:to] + after[:, at:to] * np.uint64(_BASE))[:, :, None] + _LETTER[letters][None, None, :] * power[at:to, None]
                    behind = np.full((len(codes), to - at), -1, np.int16)
                    behind[:, at == 0 :] = codes[:, max(at, 1) - 1 : to - 1]
                    for w, i, k in _passing(new, behind[:, :, None] != letters, bits, full):
                        yield some[w], some[w][: at + i] + plain[k] + some[w][at + i :]


def _passing(hashes: np.ndarray, real: np.ndarray, bits: int, full: np.ndarray) -> Iterator[tuple]:
    """Indices of the hashes that are real candidates and pass all probes of the filter."""
    left = np.flatnonzero(real)
    flat = hashes.ravel()
    for probe in range(PROBES):
        at = _places(flat[left], bits, probe)
        left = left[(full[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0]
    return zip(*(x.tolist() for x in np.unravel_index(left, hashes.shape)), strict=True)


def _filter_of(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The vocabulary's Bloom filter. It has ``bits`` bits whatever the vocabulary, so what
    comes to the driver is bounded; words meet in 64-bit cells before."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, codes in _same_length(pdf["word"].tolist()):
                h = word_hashes(codes)
                at = np.concatenate([_places(h, bits, probe) for probe in range(PROBES)])
                yield pd.DataFrame({"cell": at >> 6, "bit": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    found = vocabulary.mapInPandas(cells, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit")).toPandas()
    full = np.zeros(max(1, bits >> 6), np.uint64)
    full[found["cell"].to_numpy(np.int64)] = found["bit"].to_numpy(np.int64).view(np.uint64)
    return full


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of ``vocabulary`` (distinct word, n) at exactly one
    inserted, deleted or replaced code point, in both directions.

    Every string one edit away, over the letters the vocabulary uses, is a candidate; a Bloom
    filter of the vocabulary leaves out nearly all that are no words before anything is
    shuffled (it loses none, and has a fixed most size; the fuller it is, the more candidates
    are shuffled), and an equi-join on the candidate itself decides. No distance is computed.
    """
    spark = vocabulary.sparkSession
    letters = sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.split("word", ""))).distinct().collect() if r[0])
    bits = 64
    size = vocabulary.count()
    while bits < min(MOST_BITS, FILTER_BITS * size):
        bits *= 2
    full = spark.sparkContext.broadcast(_filter_of(vocabulary, bits))
    alphabet = np.array(letters, np.uint8)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple[str, str]] = []
            for pair in neighbours(pdf["word"].tolist(), alphabet, bits, full.value):
                rows.append(pair)
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=["word", "near"])
                    rows = []
            yield pd.DataFrame(rows, columns=["word", "near"])

    dealt = vocabulary.select("word").repartition(1 + size // WORDS_A_TASK, "word")
    candidates = dealt.mapInPandas(emit, "word string, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def spelling_variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``vocabulary`` (word, n).

    ``n_near`` counts the near words (see ``near_words``); ``form`` is the near word of largest
    n (ties: the smallest in code-point order) if that n is at least ``ratio`` times the
    word's, else null; ``root`` follows forms to the last. As n grows by ``ratio`` > 1 with each form,
    chains end; each round doubles the hops, so rounds grow with the logarithm of the longest
    chain. Words must be distinct and letters of ``count_words``; null words are left out;
    empty table: no rows.
    """
    vocabulary = materialize(vocabulary.where("word is not null").select("word", "n"), "vocabulary")
    near = near_words(vocabulary)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    chosen = F.col("best.m") <= -ratio * F.col("n")
    words = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n")
    )
    words = materialize(words, "forms")
    hops = materialize(words.where("form is not null").select("word", F.col("form").alias("to")), "hops")
    while True:
        # Who ends at a word with a form of its own hops on to where that one ends.
        far = hops.join(hops.select(F.col("word").alias("to"), F.col("to").alias("then")), "to", "left")
        far = materialize(far.select("word", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")), "hops")
        drop_materialized(hops)
        hops = far.select("word", "to")
        if not far.where("moved").count():
            break
    drop_materialized(vocabulary)
    return words.join(hops.withColumnRenamed("to", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
