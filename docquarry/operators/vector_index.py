"""A stored index for dense search: k-means cells, probed by nearness, rescored exactly."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.segments import Segments
from .blocks import best_by_cosine
from .retrieval import cosine

ROWS = "id {0}, embedding array<double>, near double, segment long, cell int"
#: Cell of vectors without a length (their cosine is 0); every search looks into it.
NO_LENGTH = -1


def _has_length(c: Column) -> Column:
    return F.exists(c, lambda x: x != 0)


class VectorIndex:
    """Every vector lies in the cell of its nearest centroid, in a table partitioned by cell.

    Centroids are fitted on a bounded sample (``most_sample``, chosen by hash); rows are not
    sampled: all are in the index. A search opens the cells whose centroids are nearest to the
    query and takes the cosine of every vector in them. ``exact=True`` goes on with each cell
    that may hold a better one by its angle, so its result is that of a full scan.
    Adding replaces vectors of the same id; deleting and merging as in the lexical index."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long"):
        self.spark, self.store = spark, Segments(spark, path, "id", id_type=id_type)
        self.schema = ROWS.format(self.store.state()[1]["settings"]["id_type"])

    def fit(self, vectors: DataFrame, cells: int | None = None, most_sample: int = 100_000, seed: int = 7) -> None:
        """Fit the centroids on ``vectors`` (id, embedding) and add them all. ``cells``: by default the root of
        their number, 4096 at most."""
        version, state = self.store.state()
        if state["segments"]:
            raise ValueError("the index holds vectors; merge or start another")
        n = vectors.count()
        cells = cells or max(1, min(4096, math.isqrt(n)))
        share = min(1.0, most_sample / max(1, n))
        sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select(F.col("embedding").cast("array<double>").alias("vec"))
        sample = sample.where(_has_length(F.col("vec"))).select(array_to_vector("vec").alias("features"))
        if sample.isEmpty():
            raise ValueError("no vector to fit centroids on")
        model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", initSteps=2, maxIter=10).fit(sample)
        name = f"model/{version}"
        model.write().overwrite().save(f"{self.store.path}/{name}")
        self.store.log.commit(state | {"extra": state["extra"] | {"model": name, "cells": len(model.clusterCenters())}}, version)
        self.add(vectors)

    def centroids(self) -> DataFrame:
        """(cell, centroid), 4096 rows at most."""
        model = KMeansModel.load(f"{self.store.path}/{self.store.state()[1]['extra']['model']}")
        return self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centroid array<double>")

    def _rows(self, state: dict) -> DataFrame:
        return self.store.live(state, self.store.read(state, "rows", self.schema))

    def add(self, vectors: DataFrame) -> None:
        """Add ``vectors`` (id, embedding); ids that the index holds are replaced. Ids are distinct; rows
        with a null id or vector are left out."""
        version, state = self.store.state()
        number = state["next"]
        model = KMeansModel.load(f"{self.store.path}/{state['extra']['model']}")
        model.setFeaturesCol("features").setPredictionCol("cell")
        rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("id is not null and embedding is not null")
        placed = model.transform(rows.where(_has_length(F.col("embedding"))).withColumn("features", array_to_vector("embedding"))).join(F.broadcast(self.centroids()), "cell")
        placed = placed.select("id", "embedding", cosine(F.col("embedding"), F.col("centroid")).alias("near"), "cell")
        rest = rows.where(~_has_length(F.col("embedding"))).select("id", "embedding", F.lit(0.0).alias("near"), F.lit(NO_LENGTH).alias("cell"))
        # By cell and id: a cell that holds very much is written by several tasks.
        placed = placed.unionByName(rest).repartitionByRange("cell", "id")
        name = self.store.write(placed, "rows", number, "cell")
        gone, gone_rows = [], 0
        if state["segments"]:
            old = self._rows(state).select("id").join(vectors.select("id"), "id", "left_semi")
            buried, gone_rows = self.store.bury(old, number - 1)
            gone = [buried]
        self.store.log.commit(state | {"segments": [*state["segments"], {"rows": name, "number": number}], "gone": [*state["gone"], *gone], "gone_rows": state["gone_rows"] + gone_rows, "next": number + 1}, version)

    def delete(self, ids: DataFrame) -> None:
        """Vectors whose id is among ``ids`` (id)."""
        version, state = self.store.state()
        name, n = self.store.bury(ids.select("id").distinct(), state["next"] - 1)
        self.store.log.commit(state | {"gone": [*state["gone"], name], "gone_rows": state["gone_rows"] + n}, version)

    def merge(self) -> None:
        """Live rows in one segment, with the same centroids."""
        version, state = self.store.state()
        number = state["next"]
        name = self.store.write(self._rows(state).drop("segment").repartitionByRange("cell", "id"), "rows", number, "cell")
        self.store.log.commit(state | {"segments": [{"rows": name, "number": number}], "gone": [], "gone_rows": 0, "next": number + 1}, version)

    def _near_cells(self, queries: DataFrame) -> DataFrame:
        """(query_id, cell, place, angle) of every query and cell, nearest first."""
        unit = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        each = unit.crossJoin(F.broadcast(self.centroids()))  # at most 4096 rows
        cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(F.col("query_vector"), F.col("centroid"))))
        each = each.select("query_id", "cell", F.acos(cos).alias("angle"))
        return each.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("angle", "cell")))

    def search(self, queries: DataFrame, top_k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of the best ``top_k`` by cosine for ``queries`` (query_id, query_vector),
        ties by id: among the ``probes`` nearest cells (``tune`` finds how many; 16 by default), or, with ``exact``, of all.

        Cells and the queries that want them meet in blocks (``blocks.best_by_cosine``), so
        neither the number of queries nor a large cell brings much into one task."""
        _, state = self.store.state()
        rows = self._rows(state).select("id", "embedding", "near", "cell")
        asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        scored = lambda wanted: best_by_cosine(rows.drop("near"), asked, top_k, ["cell"], wanted=wanted).select("query_id", "id", "score")
        probes = probes or state["extra"].get("probes", 16)
        cells = self._near_cells(queries)
        always = queries.select("query_id", F.lit(NO_LENGTH).alias("cell"))
        found = _best(scored(cells.where(F.col("place") <= probes).select("query_id", "cell").unionByName(always)), top_k)
        if not exact:
            return found
        # A vector of a cell is at most the cell's widest angle from its centroid, so it is at least the
        # difference of the angles from the query.
        wide = rows.where(F.col("cell") != NO_LENGTH).groupBy("cell").agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("near")))).alias("wide"))
        floor = found.where(F.col("rank") == top_k).select("query_id", F.col("score").alias("floor"))
        more = cells.where(F.col("place") > probes).join(F.broadcast(wide), "cell").join(floor, "query_id", "left")
        more = more.where(F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("wide") - 1e-7)) >= F.coalesce("floor", F.lit(-2.0)) - 1e-9)
        return _best(found.drop("rank").unionByName(scored(more.select("query_id", "cell"))), top_k)

    def tune(self, recall: float = 0.9, top_k: int = 10, asked: int = 200) -> tuple[int, float]:
        """Find and keep the fewest probes that reach ``recall``: ``asked`` vectors of the index (by hash) are searched
        exactly, and the place of each true neighbour's cell tells from how many probes on it is
        found. Returns the probes and the recall measured with them."""
        version, state = self.store.state()
        rows = self._rows(state).drop("segment")
        queries = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(asked).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
        truth = self.search(queries, top_k + 1, exact=True).where("query_id <> id")
        places = self._near_cells(queries).select("query_id", "cell", "place")
        at = rows.select("id", "cell").join(F.broadcast(truth.select("query_id", "id")), "id").join(places, ["query_id", "cell"], "left")
        counts = dict(at.groupBy(F.coalesce("place", F.lit(0)).alias("place")).count().collect())
        total, upto, probes = sum(counts.values()), 0, 1
        for place in sorted(counts):
            if upto >= recall * total:
                break
            upto, probes = upto + counts[place], max(1, place)
        self.store.log.commit(state | {"extra": state["extra"] | {"probes": probes}}, version)
        return probes, upto / max(1, total)


def _best(hits: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
