"""Approximate nearest neighbours by inner product: 2-stable projections, kd-tree, chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

#: Projected dimensions (even), and the chance that a neighbour lies within the searched radius.
AXES, CHANCE = 8, 0.95
#: Rows of a kd-tree cell, of a block inside it, and queries that meet a cell in one task.
CELL_ROWS, BLOCK_ROWS, CELL_QUERIES = 2048, 256, 2048
#: The tree's splits are fitted on a sample of at most about so many points, into at most so many cells.
MOST_SAMPLE, MOST_CELLS = 1 << 18, 1 << 14
#: Copies of one vector are ranked in so many parts first. Queries of one vector beyond FREQUENT get its answer by broadcast.
PARTS, FREQUENT, MOST_BROADCAST = 16, 10_000, 100_000

PLACED = "rep long, vec array<double>, ids array<long>, cell long, at array<double>"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def chi_square_limit(axes: int, chance: float) -> float:
    """The value that a chi-square variable with an even number of degrees stays under with this chance."""

    def under(x: float) -> float:
        term, total = 1.0, 0.0
        for j in range(axes // 2):
            total += term
            term *= x / 2 / (j + 1)
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while under(high) < chance:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if under(mid) < chance else (low, mid)
    return high


def project(vectors: np.ndarray, most: float, axes: int) -> np.ndarray:
    """Stable projections of vectors scaled to length 1 at most, with one coordinate more
    that fills them up to length 1: then a larger inner product is a smaller distance."""
    scaled = vectors / most
    rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
    along = np.random.default_rng((13, vectors.shape[1])).standard_normal((vectors.shape[1] + 1, axes))
    return scaled @ along[:-1] + rest[:, None] * along[-1]


def fit_tree(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits of a complete kd-tree: axis and value of each inner node, in heap order. Each
    node splits its points at the median of their widest axis."""
    axis, value = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
    parts = {1: points}
    for node in range(1, 1 << levels):
        own = parts.pop(node)
        if len(own):
            axis[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            value[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] > value[node]
        parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
    return axis, value


def descend(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf of each point, from 0."""
    axis, value = tree
    node = np.ones(len(points), np.int64)
    for _ in range(len(axis).bit_length() - 1):
        node = 2 * node + (points[np.arange(len(points)), axis[node]] > value[node])
    return node - len(axis)


def _blocks(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a local kd-tree."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            done.append(own)
            continue
        wide = np.argmax(np.ptp(points[own], axis=0))
        order = own[np.argsort(points[own, wide], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def search_cell(at: np.ndarray, vectors: np.ndarray, ids: list, asked: np.ndarray, asked_at: np.ndarray, floor: np.ndarray, most: float, need: int, limit: float) -> Iterator[tuple[int, int, float]]:
    """(query, vec_id, score) of the ``need`` best of a cell for each query ``asked``, none under its ``floor``.

    Blocks come in order of their projected distance, in them all points within the radius
    are verified on the original vectors. Every verified neighbour may raise the query's
    floor; the radius is where a point as good as the floor would lie with the chance behind ``limit``, so
    the search stops at the first block beyond it."""
    blocks = [(at[b], vectors[b], [ids[i] for i in b]) for b in _blocks(at, BLOCK_ROWS)]
    low, high = np.array([b[0].min(axis=0) for b in blocks]), np.array([b[0].max(axis=0) for b in blocks])
    length = np.sqrt((asked * asked).sum(axis=1))
    for q in range(len(asked)):
        far = (np.maximum(0, np.maximum(low - asked_at[q], asked_at[q] - high)) ** 2).sum(axis=1)
        found: list[tuple[float, int]] = []
        least = floor[q]
        for b in np.argsort(far, kind="stable"):
            radius = limit * max(0.0, 2 - 2 * least / (length[q] * most) + 1e-9)
            if far[b] > radius:
                break
            points, own, names = blocks[b]
            near = np.flatnonzero(((points - asked_at[q]) ** 2).sum(axis=1) <= radius)
            scores = (own[near] * asked[q]).sum(axis=1)
            good = np.flatnonzero(scores >= least)
            if len(good):
                found += [(-scores[g], i) for g in good for i in names[near[g]]]
                found.sort()
                del found[need:]
                if len(found) == need:
                    least = max(least, -found[-1][0])
        for score, i in found:
            yield q, int(i), -float(score)


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part: null vec_ids and vectors that are
    null, empty, zero or hold a null or non-finite component are left out. Repeated rows
    count once; of different vectors with one vec_id the least (in array order) counts."""
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(fine)
    again = materialize(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return rows
    again = _small(again)
    return rows.join(again, "vec_id", "left_anti").unionByName(rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec")))


def _distinct_vectors(rows: DataFrame, asks: Column, need: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (vec_id, vec): (rep, vec, ids, asked) for each different vector, with its
    smallest vec_id, its ``need`` smallest ones and whether a query has it; and (vec_id, rep) of the
    queries. Only digests are shuffled; copies are ranked in parts before they meet."""
    slim = materialize(rows.select("vec_id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), asks.alias("asked")), "digests")
    some = slim.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)))
    for keys in (["h1", "h2", "part"], ["h1", "h2"]):
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("r") <= need)
    groups = some.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = slim.where("asked").groupBy("h1", "h2").agg(F.count("*").alias("asked"))
    groups = materialize(groups.join(asked, ["h1", "h2"], "left"), "vector-groups")
    points = groups.select(F.col("rep").alias("vec_id"), "ids", F.coalesce("asked", F.lit(0)).alias("asked")).join(rows, "vec_id").withColumnRenamed("vec_id", "rep")
    wanted = groups.where("asked is not null").select("h1", "h2", "rep", "asked")
    queries = slim.where("asked").drop("asked").join(_small(wanted.where(F.col("asked") > FREQUENT).select("h1", "h2", F.col("rep").alias("known"))), ["h1", "h2"], "left")
    rare = queries.where("known is null").join(wanted.select("h1", "h2", "rep"), ["h1", "h2"]).select("vec_id", "rep", F.lit(False).alias("often"))
    return points, queries.where("known is not null").select("vec_id", F.col("known").alias("rep"), F.lit(True).alias("often")).unionByName(rare)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


class Index:
    """Vectors in the cells of a kd-tree over their projections. ``rows`` (rep, vec, ids, cell, at) is a
    table in the shared folder that holds every vector; the rest is bounded.

    Vectors are kept apart by length and, as the measure is the inner product, by norm (one
    group for each power of two), so that one long vector does not blur the rest."""

    def __init__(self, points: DataFrame, axes: int):
        spark, self.axes = points.sparkSession, axes
        # The largest component is a column of its own, or each component would look for it again.
        points = points.select("rep", "vec", "ids", F.size("vec").alias("dim"), F.array_max(F.transform("vec", F.abs)).alias("top"))
        norm = F.col("top") * F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top"))))
        points = points.select("rep", "vec", "ids", "dim", norm.alias("norm")).withColumn("band", F.round(F.log2("norm")).cast("int"))
        points = materialize(points, "points")
        found = points.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy("dim", "band").collect()
        self.groups = [(r["dim"], r["band"], r["most"]) for r in found]
        total, number = sum(r["n"] for r in found), {(r["dim"], r["band"]): g for g, r in enumerate(found)}
        groups = spark.sparkContext.broadcast((number, self.groups))

        def placed(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
            number, groups = groups_of.value
            for key, own in pdf.groupby(["dim", "band"], sort=False):
                g = number[key]
                yield g, own, project(_matrix(own["vec"]), groups[g][2], axes)

        groups_of = groups

        def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g, _, at in placed(pdf):
                    yield pd.DataFrame({"g": g, "at": list(at)})

        share = min(1.0, MOST_SAMPLE / max(1, total))
        sample = points.where(F.pmod(F.xxhash64(F.lit(7), "rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        sample = sample.mapInPandas(sampled, "g long, at array<double>").toPandas()
        trees = {}
        for g, r in enumerate(found):
            own = sample["at"][sample["g"] == g]
            levels = max(0, math.ceil(math.log2(min(MOST_CELLS, max(1, r["n"] / CELL_ROWS)))))
            trees[g] = fit_tree(_matrix(own) if len(own) else np.zeros((1, axes)), min(levels, int(math.log2(max(1, len(own))))))
        self.trees = spark.sparkContext.broadcast((groups.value, trees))
        trees_of = self.trees

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g, own, at in placed(pdf):
                    cell = (g << 32) + descend(at, trees_of.value[1][g])
                    yield pd.DataFrame({"rep": own["rep"], "vec": own["vec"], "ids": own["ids"], "cell": cell, "at": list(at)})

        self.rows = materialize(points.mapInPandas(cells, PLACED), "vector-cells")
        drop_materialized(points)
        bounds = [f(F.col("at")[a]).alias(f"{n}{a}") for n, f in (("low", F.min), ("high", F.max)) for a in range(axes)]
        #: cell, n, low and high of each axis; as many rows as cells.
        self.cells = self.rows.groupBy("cell").agg(F.count("*").alias("n"), *bounds).orderBy("cell").toPandas()
        # Very large cells are dealt out: a leaf is a part of a cell.
        parts = spark.createDataFrame([(int(c), int(1 + n // (4 * CELL_ROWS))) for c, n in zip(self.cells["cell"], self.cells["n"], strict=True)], "cell long, parts int")
        self.leaves = self.rows.join(_small(parts), "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))


def _plan(index: Index, limit: float, first: bool):
    """Which leaves a query has to see: at first its own cell of each group; then all whose box
    comes nearer than its radius, but for those it has seen."""
    trees_of, axes = index.trees, index.axes
    of = index.cells["cell"].to_numpy(np.int64) >> 32
    cells = {
        g: (own["cell"].to_numpy(np.int64), own[[f"low{a}" for a in range(axes)]].to_numpy(), own[[f"high{a}" for a in range(axes)]].to_numpy(), (1 + own["n"] // (4 * CELL_ROWS)).to_numpy())
        for g in set(of.tolist())
        for own in (index.cells[of == g],)
    }
    cells_of = index.rows.sparkSession.sparkContext.broadcast(cells)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (_, groups), trees = trees_of.value
        for pdf in batches:
            dims = pdf["vec"].map(len).to_numpy()
            for dim in sorted(set(dims.tolist())):
                own = pdf[dims == dim]
                asked = _matrix(own["vec"])
                top = np.abs(asked).max(axis=1, keepdims=True)
                length = top[:, 0] * np.sqrt(((asked / top) ** 2).sum(axis=1))
                at = project(asked / length[:, None], 1.0, axes)
                floor = own["floor"].fillna(-np.inf).to_numpy(np.float64)
                for g, (size, _, most) in enumerate(groups):
                    if size != dim or g not in cells_of.value:
                        continue
                    names, low, high, parts = cells_of.value[g]
                    home = (g << 32) + descend(at, trees[g])
                    for c in range(len(names)):
                        mine = home == names[c]
                        if first:
                            chosen = np.flatnonzero(mine)
                        else:
                            away = (np.maximum(0, np.maximum(low[c] - at, at - high[c])) ** 2).sum(axis=1)
                            bound = 2 - 2 * floor / (length * most) + 1e-9
                            chosen = np.flatnonzero((bound >= 0) & (away <= limit * bound))
                        for part in range(1 if first else int(parts[c])):
                            to = chosen[~mine[chosen]] if part == 0 and not first else chosen
                            if len(to):
                                yield pd.DataFrame({"cell": names[c], "part": part, "asked": own["rep"].to_numpy()[to], "vec": own["vec"].to_numpy()[to], "at": list(at[to]), "floor": floor[to]})

    return emit


def _search(index: Index, queries: DataFrame, need: int, limit: float, first: bool) -> DataFrame:
    """(rep, vec_id, score) of the leaves that ``queries`` (rep, vec, floor) have to see. Leaf and queries
    meet in blocks: where more than ``CELL_QUERIES`` want a leaf, copies of it share them."""
    wanted = materialize(queries.mapInPandas(_plan(index, limit, first), "cell long, part int, asked long, vec array<double>, at array<double>, floor double"), "wanted-cells")
    blocks = wanted.groupBy("cell", "part").agg((1 + F.floor(F.count("*") / CELL_QUERIES)).cast("int").alias("blocks"))
    blocks = _small(materialize(blocks, "query-blocks"))
    left = wanted.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("asked"), F.col("blocks")))
    right = index.leaves.join(blocks, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))))
    trees_of = index.trees

    def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["rep", "vec_id", "score"]
        if not len(asked) or not len(rows):
            return pd.DataFrame([], columns=names)
        most = trees_of.value[0][1][int(rows["cell"].iloc[0]) >> 32][2]
        who, ids = asked["asked"].to_numpy(), [list(x) for x in rows["ids"]]
        found = search_cell(_matrix(rows["at"]), _matrix(rows["vec"]), ids, _matrix(asked["vec"]), _matrix(asked["at"]), asked["floor"].to_numpy(np.float64), most, need, limit)
        return pd.DataFrame([(who[q], i, s) for q, i, s in found], columns=names)

    keys = ["cell", "part", "block"]
    return left.select(*keys, "asked", "vec", "at", "floor").groupBy(*keys).cogroup(right.select(*keys, "vec", "ids", "at").groupBy(*keys)).applyInPandas(meet, "rep long, vec_id long, score double")


def nearest(vectors: DataFrame, asks: Column, k: int = 20, axes: int = AXES, chance: float = CHANCE) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of ``vectors`` (vec_id, embedding) that ``asks`` (a
    condition on vec_id) selects, the ``k`` other rows of largest inner product, best first,
    ties by vec_id; fewer where there are fewer. The score is taken in double precision on the
    original vectors. Vectors of different lengths do not meet. What takes no part, and how
    repeated rows count: see ``clean_vectors``. Empty table: no rows. Other columns are not looked at.

    Method: Gaussian (2-stable) projections to ``axes`` dimensions; the squared projected distance of two
    points over their squared distance follows chi-square. Points lie in a kd-tree: cells over
    all, blocks in each cell. A query first searches its own cells, which gives a floor for
    its k-th score, then all cells that come nearer than the radius within which a point as good as
    the floor lies with ``chance``; in each it goes through blocks by projected distance, verifies
    all points within the radius, and the radius shrinks as the floor rises. So each true neighbour is
    found with this chance at least, at every size; nothing else is cut. Equal vectors are one point.
    """
    need, limit = k + 1, chi_square_limit(axes, chance)
    rows = materialize(clean_vectors(vectors), "vectors")
    points, queries = _distinct_vectors(rows, asks, need)
    points, queries = materialize(points, "distinct-vectors"), materialize(queries, "queries")
    index = Index(points, axes)
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    asked = points.where("asked > 0").select("rep", "vec")
    once = _search(index, asked.withColumn("floor", F.lit(None).cast("double")), need, limit, True)
    once = materialize(once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= need), "first-found")
    floors = once.where(F.col("r") == need).select("rep", F.col("score").alias("floor"))
    more = _search(index, asked.join(floors, "rep", "left"), need, limit, False)
    found = once.select("rep", "vec_id", "score").unionByName(more)
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= need)
    found = materialize(found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")), "found")
    often = queries.where("often").select("rep").distinct()
    answers = queries.where("not often").join(found, "rep").unionByName(queries.where("often").join(_small(found.join(_small(often), "rep", "left_semi")), "rep"))
    answers = answers.select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x.vec_id != F.col("vec_id")), 1, k).alias("found"))
    answers = answers.select("query_id", F.posexplode("found").alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
