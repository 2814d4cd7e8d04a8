"""Line dedup: drop lines that recur across documents, keeping one copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, apart, lower_ascii, materialize, put, shuffled


def line_key(line: Column) -> Column:
    """A line's key: white space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, most_broadcast: int = 500_000) -> DataFrame:
    """Remove boilerplate lines from ``docs`` (doc_id, text, ...).

    Lines whose key has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents stay only in the largest doc_id holding them (there every copy
    stays). Adds ``n_lines`` (before) and ``n_dropped``; ``text`` becomes the kept lines
    joined by a line feed.

    Plan: explode normalised lines to slim (hash, doc_id) rows, dedupe and write those once,
    count documents per hash (map-side combined, so a hot line is one row per task), join the
    hashes over the threshold back to the slim rows, and give each document its positions
    to drop. Only then the texts move, once, to meet their positions. The hashes over the
    threshold are broadcast while they are at most ``most_broadcast``, so that a hot line's
    rows stay where they are; beyond, they are joined by shuffle.

    Null or empty text: one empty line, nothing dropped, text ''. Null doc_id: passes
    unchanged and counts for no line. Repeated rows count as one document and are treated
    alike. Ties: none, since a doc_id is either the largest or not. Empty table: no rows. Other
    columns pass through; columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    docs, back = apart(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = put(docs, text=text, __dq_mark=F.xxhash64(text))
    lines = base.where("doc_id is not null").select(
        "doc_id", "__dq_mark", F.posexplode(F.transform(F.split("text", "\n", -1), line_key)).alias("__dq_pos", "__dq_key")
    )
    # Two 64-bit hashes with different seeds act as one 128-bit digest of the key.
    held = (
        lines.where(F.char_length("__dq_key") >= min_chars)
        .groupBy(F.xxhash64("__dq_key").alias("__dq_h1"), F.xxhash64(F.lit(1), "__dq_key").alias("__dq_h2"), "doc_id")
        .agg(F.collect_set(F.struct("__dq_mark", "__dq_pos")).alias("__dq_at"))
    )
    held = materialize(held, "lines")
    common = (
        held.groupBy("__dq_h1", "__dq_h2")
        .agg(F.count("*").alias("__dq_n"), F.max("doc_id").alias("__dq_last"))
        .where(F.col("__dq_n") >= min_docs)
    )
    common = materialize(common, "common-lines")
    common = F.broadcast(common) if common.count() <= most_broadcast else shuffled(common)
    drops = (
        held.join(common, ["__dq_h1", "__dq_h2"])
        .where(F.col("doc_id") != F.col("__dq_last"))
        .select("doc_id", F.explode("__dq_at").alias("__dq_at"))
        .groupBy("doc_id", "__dq_at.__dq_mark")
        .agg(F.collect_list("__dq_at.__dq_pos").alias("__dq_drop"))
    )
    split = put(base, __dq_lines=F.split("text", "\n", -1)).join(drops, ["doc_id", "__dq_mark"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__dq_lines") - 1), "__dq_drop")
    kept = F.array_join(F.transform(stay, lambda i: F.get("__dq_lines", i)), "\n")
    out = put(
        split,
        text=F.when(F.col("__dq_drop").isNull(), F.col("text")).otherwise(kept),
        n_lines=F.size("__dq_lines").cast("long"),
        n_dropped=F.coalesce(F.size("__dq_drop"), F.lit(0)).cast("long"),
    )
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*(F.col(f"`{c}`").alias(back.get(c, c)) for c in names), "n_lines", "n_dropped")
