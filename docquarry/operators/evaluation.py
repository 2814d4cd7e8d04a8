"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_sample(rows: DataFrame, size: str, id_column: str, strata: int, per_stratum: int, seed: str = "20260813", span: int = 1000) -> DataFrame:
    """``per_stratum`` rows of each of ``strata`` interleaved strata over the order by size,
    chosen by the hash of seed and id."""
    # The rank over all rows: those in lesser ranges of sizes, then in its range those of
    # lesser sizes, then the place among equal sizes. One row per range meets in one window.
    counts = rows.groupBy(F.floor(F.col(size) / span).alias("__range"), F.col(size).alias("__size")).agg(F.count("*").alias("__n"))
    upto = lambda part, by: part.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("__range").agg(F.sum("__n").alias("__all"))
    ranges = ranges.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__all").over(upto(Window.partitionBy(F.lit(0)), "__range")), F.lit(0)).alias("__lesser"))
    inside = F.coalesce(F.sum("__n").over(upto(Window.partitionBy("__range"), "__size")), F.lit(0))
    before = counts.withColumn("__inside", inside).join(ranges, F.col("__range").eqNullSafe(F.col("__r"))).select("__size", (F.col("__inside") + F.col("__lesser")).alias("__before"))
    equal = Window.partitionBy(size).orderBy(id_column)
    ranked = rows.withColumn("__place", F.row_number().over(equal)).join(before, F.col(size).eqNullSafe(F.col("__size")))
    ordered = ranked.withColumn("stratum", (F.col("__before") + F.col("__place") - 1) % strata).drop("__place", "__size", "__before")
    pick = Window.partitionBy("stratum").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_column).cast("string")), 256))
    return ordered.withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= per_stratum)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Recall, precision, top-1 and reciprocal rank at ``k``, averaged over ``cases``
    (query_id, kind): one row for each kind and one for all (kind null, ``overall`` true).
    ``ranked``: query_id, item, rank; ``relevant``: query_id, item."""
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "item"], "left_semi")
    found = hits.groupBy("query_id").agg(F.count_distinct("item").alias("hits"), F.min("rank").alias("first"))
    wanted = relevant.groupBy("query_id").agg(F.count_distinct("item").alias("wanted"))
    each = cases.join(wanted, "query_id", "left").join(found, "query_id", "left").na.fill(0, ["hits", "wanted"])
    each = each.select(
        "kind", F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted")).otherwise(0.0).alias("recall"), (F.col("hits") / k).alias("precision"),
        F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("top1"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )
    return each.rollup("kind").agg(F.count("*").alias("cases"), *(F.avg(m).alias(m) for m in ("recall", "precision", "top1", "mrr")), (F.grouping("kind") == 1).alias("overall"))


def metric_deltas(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """b - a for each metric."""
    joined = a.alias("a").join(b.alias("b"), key)
    return joined.select(key, *((F.col(f"b.{m}") - F.col(f"a.{m}")).alias(m) for m in metrics))
