"""Time-coded text: captions, coverage, gaps, transcripts, frame selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_spaced, sentences, strip
from ..functions.values import clock, clock_seconds
from .retrieval import is_small

#: Rows of a part of ``failed_chunks``.
PART_ROWS = 1 << 20


def caption_cues(files: DataFrame, key: str = "media_id", vtt: str = "vtt") -> DataFrame:
    """Cues (key, start, end, text) of WebVTT texts: tags dropped, white space collapsed, and
    only what a cue adds to the one before (``caption_deltas``)."""
    blocks = files.select(key, F.posexplode(F.split(strip(F.col(vtt)), r"\r?\n\s*\r?\n")).alias("n", "block"))
    time = r"(?s)((?:\d{2}:)?\d{2}:\d{2}[.,]\d{3})\s+-->\s+((?:\d{2}:)?\d{2}:\d{2}[.,]\d{3})[^\n]*(?:\n(.*))?"
    part = lambda i: F.regexp_extract("block", time, i)
    plain = F.regexp_replace(part(3), r"<[^>]+>", "")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(c))
    cues = blocks.where(part(1) != "").select(key, "n", F.round(clock_seconds(part(1)), 3).alias("start"), F.round(clock_seconds(part(2)), 3).alias("end"), one_spaced(plain).alias("text"))
    return caption_deltas(cues, key, "n").where("delta <> ''").select(key, "start", "end", F.col("delta").alias("text"))


def caption_deltas(cues: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``delta``: nothing if the text equals the one before, what follows it if it begins
    with it, else all of it."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    rest = strip(F.substring(F.col("text"), F.char_length(before) + 1, F.char_length("text")))
    delta = F.when(F.col("text") == before, "").when((before != "") & F.col("text").startswith(before), rest).otherwise(F.col("text"))
    return cues.withColumn("delta", delta)


def merged_intervals(rows: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of each key as one (key, start, end)."""
    w = Window.partitionBy(key).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.where(F.col(end) > F.col(start)).withColumn("__new", F.coalesce((F.col(start) > seen).cast("int"), F.lit(1)))
    island = flagged.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(key, "__i").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__i")


def coverage(merged: DataFrame, key: str, durations: DataFrame) -> DataFrame:
    """(key, ratio) of the covered part of each duration, rounded to 6 digits; 0 without any."""
    total = merged.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    joined = durations.join(total, key, "left")
    return joined.select(key, F.when(F.col("duration") > 0, F.round(F.coalesce("covered", F.lit(0.0)) / F.col("duration"), 6)).otherwise(0.0).alias("ratio"))


def gaps(merged: DataFrame, key: str, durations: DataFrame) -> DataFrame:
    """(key, start, end) of what the merged intervals leave open in each duration."""
    w = Window.partitionBy(key).orderBy("start")
    inner = merged.select(key, F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("gs"), F.col("start").alias("ge"))
    tail = durations.join(merged.groupBy(key).agg(F.max("end").alias("last")), key, "left").select(key, F.coalesce("last", F.lit(0.0)).alias("gs"), F.col("duration").alias("ge"))
    return inner.unionByName(tail).where("ge > gs").select(key, F.round("gs", 3).alias("start"), F.round("ge", 3).alias("end"))


def speech_ranges(open_gaps: DataFrame, ratios: DataFrame, key: str, durations: DataFrame, least_ratio: float = 0.85, least_seconds: float = 8.0) -> DataFrame:
    """Ranges to transcribe: all of a medium with low coverage, else its gaps of some length."""
    low = ratios.where(F.col("ratio") < least_ratio).join(durations, key).select(key, F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    long = open_gaps.where(F.col("end") - F.col("start") >= least_seconds).join(low.select(key), key, "left_anti")
    return low.unionByName(long)


def best_caption(candidates: DataFrame, key: str) -> DataFrame:
    """Per key the candidate with the highest ratio, language bonus and length."""
    rest = [c for c in candidates.columns if c != key]
    return candidates.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ratio", "language_bonus", F.char_length("transcript"))).alias("b")).select(key, "b.*")


def _cuts(duration: Column, silences: Column, target: float, least: float, most: float) -> Column:
    """Where a recording is cut: from each cut on, at the silence nearest to ``target`` within
    ``least`` and ``most`` seconds, or without one at ``target``, until the rest is short enough."""

    def step(cuts: Column, _: Column) -> Column:
        last = F.element_at(cuts, -1)
        near = F.filter(silences, lambda s: s.between(last + least, last + most))
        best = F.array_min(F.transform(near, lambda s: F.struct(F.abs(s - last - target).alias("off"), s.alias("s")))).s
        return F.when(duration - last > most, F.concat(cuts, F.array(F.round(F.coalesce(best, F.least(last + target, duration)), 3)))).otherwise(cuts)

    steps = F.sequence(F.lit(0), F.ceil(duration / least).cast("int"))
    return F.aggregate(steps, F.array(F.lit(0.0)), step, lambda cuts: F.concat(cuts, F.array(duration)))


def speech_chunks(media: DataFrame, target: float = 150, least: float = 120, most: float = 180, overlap: float = 1.5) -> DataFrame:
    """(media_id, index, start, end) of overlapping chunks of ``media`` (media_id, duration,
    silences array<double>): one projection, no grouping."""
    return _chunks(media.where("duration > 0"), ["media_id"], target, least, most, overlap).select("media_id", "index", "start", "end")


def _chunks(media: DataFrame, keys: list[str], target: float, least: float, most: float, overlap: float) -> DataFrame:
    length = F.col("duration").cast("double")
    inside = F.filter(F.coalesce("silences", F.array().cast("array<double>")), lambda s: (s > 0) & (s < length))
    cut = media.select(*keys, length.alias("d"), _cuts(length, inside, target, least, most).alias("c"))
    at = lambda i: F.get("c", i)
    ends = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(
        i.alias("index"), F.round(F.greatest(F.lit(0.0), at(i) - F.when(i > 0, overlap).otherwise(0.0)), 3).alias("start"),
        F.round(F.least("d", at(i + 1) + F.when(i < F.size("c") - 2, overlap).otherwise(0.0)), 3).alias("end"),
    ))
    return cut.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*")


def speech_chunks_of(ranges: DataFrame, media: DataFrame, target: float = 150, least: float = 120, most: float = 180, overlap: float = 1.5) -> DataFrame:
    """``speech_chunks`` of parts of recordings only: ``ranges`` (media_id, start, end). Chunks
    are numbered through all ranges of a recording, in the order of their starts."""
    own = ranges.where(F.col("end") > F.col("start")).select("media_id", F.col("start").alias("from"), F.col("end").alias("to")).join(media.select("media_id", "silences"), "media_id")
    near = F.transform(F.filter("silences", lambda s: (s > F.col("from")) & (s < F.col("to"))), lambda s: s - F.col("from"))
    parts = own.select("media_id", "from", (F.col("to") - F.col("from")).alias("duration"), near.alias("silences"))
    cut = _chunks(parts, ["media_id", "from"], target, least, most, overlap)
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("from", "index")) - 1
    shift = lambda c: F.round(F.col("from") + F.col(c), 3)
    return cut.select("media_id", number.alias("index"), shift("start").alias("start"), shift("end").alias("end"))


def distinct_frames(frames: DataFrame, threshold: float = 2.0) -> DataFrame:
    """``frames`` (media_id, n, thumb binary) whose thumbnail differs from the last one kept by
    more than ``threshold`` on average. A fold per medium: what is kept depends on what was."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        pdf = pdf.sort_values("n")
        for i, b in enumerate(pdf["thumb"]):
            now = np.frombuffer(b, np.uint8).astype(np.int16)
            if last is None or len(now) == 0 or len(now) != len(last) or np.abs(now - last).mean() > threshold:
                kept.append(i)
                last = now
        return pdf.iloc[kept]

    return frames.select("media_id", "n", "thumb").groupBy("media_id").applyInPandas(run, "media_id long, n long, thumb binary")


def even_sample(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """``n`` rows of each key, evenly spaced with both ends, positions rounded half to even;
    all rows of keys that have no more. Adds ``index``."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    # Position i is wanted if some k in 0..n-1 rounds to it: only the nearest k can.
    step = (F.col("__n") - 1) / F.lit(max(n - 1, 1))
    k = F.bround(F.col("__i") / step)
    wanted = F.lit(False)
    for shift in (-1, 0, 1):
        kk = k + shift
        wanted = wanted | ((kk >= 0) & (kk <= n - 1) & (F.bround(kk * step) == F.col("__i")))
    pick = F.when(F.col("__n") <= n, True).when(F.lit(n <= 1), F.col("__i") == 0).otherwise(wanted)
    return rows_with_index(numbered.where(pick).drop("__i", "__n"), key, order)


def strided_sample(rows: DataFrame, key: str, order: str, most: int = 24) -> DataFrame:
    """At most ``most`` rows of each key at positions floor(i * count / most)."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    k = F.ceil(F.col("__i") * most / F.col("__n"))
    pick = (F.col("__n") <= most) | ((k < most) & (F.floor(k * F.col("__n") / most) == F.col("__i")))
    return rows_with_index(numbered.where(pick).drop("__i", "__n"), key, order)


def rows_with_index(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def sentence_times(sentences: Column, start: Column, duration: Column) -> Column:
    """array<struct<seconds, text>>: sentences spread over a chunk by 0.6 of their share of
    characters and 0.4 of their number, each at the middle of its time."""
    total = F.aggregate(sentences, F.lit(0), lambda a, s: a + F.char_length(s))
    weight = lambda s: 0.6 * F.char_length(s) / F.greatest(total, F.lit(1)) + 0.4 / F.size(sentences)
    before = lambda i: F.aggregate(F.slice(sentences, F.lit(1), i), F.lit(0.0), lambda a, s: a + weight(s))
    return F.transform(sentences, lambda s, i: F.struct(F.round(start + duration * (before(i) + 0.5 * weight(s)), 1).alias("seconds"), s.alias("text")))


def merge_transcript(entries: DataFrame, key: str) -> DataFrame:
    """One transcript per key from entries (key, seconds, text): sorted, each with its clock
    time, joined by blank lines."""
    parts = F.sort_array(F.collect_list(F.struct("seconds", F.concat(F.lit("["), clock(F.col("seconds")), F.lit("] "), "text").alias("line"))))
    return entries.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p.line), "\n\n").alias("transcript"))


def merge_resumed(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Chunk results (media_id, index, text, error, seconds, attempts) after a second run: a new
    result replaces the old one unless the old is good and the new is not; costs add up."""
    o = saved.select("media_id", "index", F.struct("text", "error", "seconds", "attempts").alias("o"))
    n = new.select("media_id", "index", F.struct("text", "error", "seconds", "attempts").alias("n"))
    take = F.col("n").isNotNull() & (F.col("o").isNull() | F.col("o.error").isNotNull() | F.col("n.error").isNull())
    add = lambda f: F.coalesce(F.col(f"o.{f}"), F.lit(0)) + F.coalesce(F.col(f"n.{f}"), F.lit(0))
    one = lambda f: F.when(take, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}"))
    cost = lambda f: F.when(take, add(f)).otherwise(F.col(f"o.{f}"))
    return o.join(n, ["media_id", "index"], "full_outer").select("media_id", "index", one("text").alias("text"), one("error").alias("error"), F.round(cost("seconds"), 3).alias("seconds"), cost("attempts").alias("attempts"))


def nearest_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tolerance: float) -> DataFrame:
    """Each left row with the nearest right row of its key within ``tolerance`` (ties: the
    later one), or nulls. The range join is an equi-join on time buckets: a right row is in
    its own bucket and both beside it."""
    bucket = lambda c: F.floor(c / tolerance).cast("long")
    l = left.withColumn("__b", bucket(F.col(left_time))).withColumn("__id", F.monotonically_increasing_id())  # noqa: E741
    r = right.withColumn("__b", F.explode(F.sequence(bucket(F.col(right_time)) - 1, bucket(F.col(right_time)) + 1)))
    gap = F.abs(F.col(left_time) - F.col(right_time))
    hits = l.select("__id", key, "__b", left_time).join(r, [key, "__b"]).where(gap <= tolerance)
    rest = [c for c in right.columns if c != key]
    best = hits.groupBy("__id").agg(F.min_by(F.struct(*rest), F.struct(gap, -F.col(right_time))).alias("__r"))
    return l.join(best, "__id", "left").select(*left.columns, *(F.col(f"__r.{c}") for c in rest))


def transcript_segments(files: DataFrame, key: str = "media_id", text: str = "transcript") -> DataFrame:
    """(key, n, seconds, text) of a transcript: a line ``[time] text`` opens a segment, and lines
    without a time belong to the one before (to none: seconds -1)."""
    lines = files.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("i", "line")).where(strip(F.col("line")) != "")
    mark = r"^\s*\[(\d+(?:\.\d+)?|\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?)\]\s*(.*)$"
    opens = F.col("line").rlike(mark)
    w = Window.partitionBy(key).orderBy("i")
    n = F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    plain = F.col("n") == 0  # before the first time stamp the first line opens
    parts = lines.select(key, "i", n.alias("n"), F.when(opens, clock_seconds(F.regexp_extract("line", mark, 1))).alias("s"), F.when(opens, strip(F.regexp_extract("line", mark, 2))).otherwise(strip(F.col("line"))).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda p: p.t), " ")
    return parts.groupBy(key, "n").agg(F.coalesce(F.max("s"), F.lit(-1.0)).alias("seconds"), strip(joined).alias("text")).select(key, "n", F.when(plain, -1.0).otherwise(F.col("seconds")).alias("seconds"), "text")


def failed_chunks(results: DataFrame, planned: DataFrame) -> DataFrame:
    """(media_id, index) of chunks with an error or without a result. One count per chunk: results and
    plan are never sorted against each other, and parts hold ``PART_ROWS`` rows, however many there are."""
    keyed = F.col("media_id").isNotNull() & F.col("index").isNotNull()  # a null key meets no other
    r = results.select("media_id", "index", F.col("error").isNotNull().alias("bad"), keyed.alias("has")).where("bad or has")
    p = planned.select("media_id", "index", F.lit(False).alias("bad"), F.lit(False).alias("has"))
    parts = max(1, -(-(results.count() + planned.count()) // PART_ROWS))
    each = r.unionByName(p).repartition(parts, "media_id", "index").groupBy("media_id", "index")
    return each.agg(F.max("bad").alias("bad"), F.max("has").alias("has")).where("bad or not has").select("media_id", "index")


def library(states: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per video of several library roots (root, name, and nullable columns): the first
    root by ``priority`` wins where it has a value."""
    rest = [c for c in states.columns if c not in ("root", "name")]
    ranked = states.join(F.broadcast(roots) if is_small(roots) else roots, "root")
    return ranked.groupBy("name").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("priority"))).alias(c) for c in rest))


def utterance_entries(utterances: DataFrame, key: str = "media_id") -> DataFrame:
    """Entries (key, seconds, text) of recognised utterances (key, chunk_start, start_ms, end_ms,
    text). One of several sentences gives each its own entry: at the utterance's start plus the
    sentence's own share of the characters (not the sum of those before)."""
    text = strip(F.coalesce("text", F.lit("")))
    u = utterances.select(key, text.alias("t"), F.coalesce("chunk_start", F.lit(0.0)).alias("c"), F.coalesce("start_ms", F.lit(0)).cast("double").alias("a"), F.coalesce("end_ms", "start_ms", F.lit(0)).cast("double").alias("b"))
    u = u.where("t <> ''").withColumn("parts", sentences(F.col("t"))).withColumn("several", F.size("parts") > 1)
    each = u.select("*", F.explode(F.when(F.col("several"), F.col("parts")).otherwise(F.array("t"))).alias("part"))
    share = F.char_length("part") / F.char_length("t") * F.greatest(F.col("b") - F.col("a"), F.lit(1.0)) / 1000
    seconds = F.col("c") + F.col("a") / 1000 + F.when(F.col("several"), share).otherwise(0.0)
    return each.select(key, F.round(seconds, 3).alias("seconds"), F.col("part").alias("text"))


def captions_and_speech(cues: DataFrame, speech: DataFrame, key: str = "media_id") -> DataFrame:
    """One transcript per key of caption cues (key, start, text) and recognised entries
    (key, seconds, text), sorted by time and text; blank ones are left out."""
    both = cues.select(key, F.col("start").alias("seconds"), "text").unionByName(speech.select(key, "seconds", "text"))
    return merge_transcript(both.where(strip(F.col("text")) != ""), key)


def speech_usage(results: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, seconds, calls): billed seconds and calls of all chunks and attempts."""
    return results.groupBy(key).agg(F.round(F.sum(F.coalesce("seconds", F.lit(0.0))), 3).alias("seconds"), F.sum(F.coalesce("attempts", F.lit(0))).alias("calls"))


def from_either(value: Column, *paths: tuple[str, ...]) -> list[Column]:
    """For each tuple of JSON paths the first that has a text: responses come in an older and a
    newer layout."""
    return [F.coalesce(*(F.nullif(F.try_variant_get(value, p, "string"), F.lit("")) for p in several)) for several in paths]
