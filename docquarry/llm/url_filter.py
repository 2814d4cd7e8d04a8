"""URL filters: host-suffix and path-prefix rules matched by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, lower_ascii, materialize, put, shuffled

_PREFIX = 8  # hex digits of the digest that the equi-join uses
SALTS = 16
MOST_BYTES = 1 << 24  # of the keys of a table that is broadcast


def url_parts(url):
    """(host, path) of a URL: host after the first ``://`` up to ``/ ? #`` or the end, A-Z
    lower-cased; path then up to ``? #`` or the end. Null or no ``://``: both empty."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", most_broadcast: int = 200_000) -> DataFrame:
    """Judge every row's ``url`` by ``rules`` (host, path, verdict).

    Each distinct (host, path) expands to its host suffixes (whole labels) and, for every
    path length that some rule has, its path prefix of that length. The expressions meet the
    rules in an equi-join on a short digest prefix; full SHA-256 digests then confirm, and
    the rule with the longest host + path wins (ties: the longer host, then ``block``
    before ``allow``, by text order reversed). Adds ``host``, ``path``, ``rule`` (host +
    path of the rule or null) and ``verdict`` (the rule's, else ``default``).

    Rules, and the answers by (host, path), are broadcast while they are at most
    ``most_broadcast`` rows and their hosts and paths (or digests) ``MOST_BYTES`` (both counted
    first). Beyond, their side of the join is repeated under ``SALTS`` salts, so that an expression
    or page that very many rows share is split.

    Null or malformed urls: empty host and path, no rule. Empty rules: all get ``default``.
    Repeated rows are judged alike; rules with a null host or path are ignored. Other columns
    of ``pages`` pass through, those named like an added one are replaced.
    """
    pages, back = apart(pages)
    host, path = url_parts(F.col("url"))
    pages = put(pages, host=host, path=path)
    rules = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(lower_ascii(F.col("host")).alias("__dq_rhost"), F.col("path").alias("__dq_rpath"), F.col("verdict").alias("__dq_rverdict"))
        .distinct()
        .withColumn("__dq_digest", F.sha2(F.concat_ws("\n", "__dq_rhost", "__dq_rpath"), 256))
        .withColumn("__dq_prefix", F.substring("__dq_digest", 1, _PREFIX))
    )
    # One row: the path lengths among the rules, at most as many as the longest rule is long.
    lengths = rules.agg(F.collect_set(F.char_length("__dq_rpath")).alias("__dq_lengths"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    exprs = (
        pages.where("host <> ''").select("host", "path").distinct()
        .crossJoin(F.broadcast(lengths))  # one row
        .withColumn("__dq_suffix", F.explode(suffixes))
        .withColumn("__dq_n", F.explode(F.filter("__dq_lengths", lambda n: n <= F.char_length("path"))))
        .select("host", "path", F.sha2(F.concat_ws("\n", "__dq_suffix", F.substring(F.col("path"), F.lit(1), F.col("__dq_n"))), 256).alias("__dq_full"))
        .withColumn("__dq_prefix", F.substring("__dq_full", 1, _PREFIX))
    )
    order = F.struct(
        (F.char_length("__dq_rhost") + F.char_length("__dq_rpath")).alias("size"), F.char_length("__dq_rhost").alias("host_size"),
        F.col("__dq_rverdict").alias("verdict"), F.concat("__dq_rhost", "__dq_rpath").alias("rule"),
    )
    met = _spread(exprs, rules, ["__dq_prefix"], F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)), "inner", most_broadcast).where("__dq_full = __dq_digest")
    best = materialize(met.groupBy("host", "path").agg(F.max(order).alias("__dq_best")), "url-rules")
    judged = _spread(pages, best, ["host", "path"], F.pmod(F.spark_partition_id(), F.lit(SALTS)), "left", most_broadcast)
    out = put(judged, rule=F.col("__dq_best.rule"), verdict=F.coalesce(F.col("__dq_best.verdict"), F.lit(default)))
    mine = ["host", "path", "rule", "verdict"]
    return out.select(*(F.col(f"`{c}`").alias(back.get(c, c)) for c in pages.columns if c.lower() not in mine), *mine)


def _spread(many: DataFrame, few: DataFrame, keys: list[str], salt: Column, how: str, most_broadcast: int) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``: by a broadcast of ``few`` if it is small, else by
    a shuffle that splits each key by ``salt``; Spark, which does not see the salts' rows in its
    estimate, might broadcast them all."""
    size = few.agg(F.count("*").alias("rows"), F.sum(sum(F.octet_length(k) for k in keys)).alias("bytes")).first()
    if size["rows"] <= most_broadcast and (size["bytes"] or 0) <= MOST_BYTES:
        return many.join(F.broadcast(few), keys, how)
    salted = few.withColumn("__dq_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__dq_salt", salt.cast("int")).join(shuffled(salted), [*keys, "__dq_salt"], how).drop("__dq_salt")
