"""Exact dense search as a join of blocks: a matrix product per pair of blocks leaves out what cannot
be among the best, and the cosine itself decides about the rest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Vectors and queries that meet in one task, scores that are looked at together, pairs that are scored together.
BLOCK_ROWS, BLOCK_QUERIES, MATRIX, PAIRS = 1 << 14, 1 << 12, 1 << 22, 1 << 18
#: Far more than a product of unit vectors may be off.
MARGIN = 1e-9
#: Parts up to which their sizes are broadcast.
FEW = 10_000
KEYS = ["__bin", "__sub", "__asked"]


def best_by_cosine(vectors: DataFrame, queries: DataFrame, k: int, group: Sequence[str] = (), threshold: float | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of ``vectors`` (id, embedding array<double>, ...) beside rows of ``queries`` (query_id, query_vector, ...)
    with their ``score``, the cosine: of every query at least its best ``k`` (ties by id), of every query and
    ``group`` where these are columns of both, and nothing under the ``threshold``. Rank what
    comes back: each pair of blocks returns its own best ``k``.

    With ``wanted`` (query_id, one column ``group``) a query meets the parts that it wants, and its best are those
    of all of them. Blocks are dealt out by hash: large parts to several, small ones together;
    vectors are repeated for each block of queries. So no task holds more than a pair of blocks,
    whatever the number of vectors, queries or copies."""
    group = list(group)
    asked = queries if wanted is None else wanted
    own = vectors.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("__subs"))
    theirs = asked.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("__blocks"))
    if group:
        bins = -(-vectors.count() // BLOCK_ROWS) or 1
        sizes = own.join(theirs, group).withColumn("__bin", F.pmod(F.xxhash64(*group), F.lit(bins)))
        sizes = F.broadcast(sizes) if own.limit(FEW + 1).count() <= FEW else sizes
        beside = lambda df: df.join(sizes, group)
    else:
        sizes = F.broadcast(own.crossJoin(theirs).where("__subs > 0 and __blocks > 0").withColumn("__bin", F.lit(0).cast("long")))  # one row
        beside = lambda df: df.crossJoin(sizes)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sub, block = F.pmod(F.xxhash64("id"), "__subs").cast("int"), F.pmod(F.xxhash64("query_id"), "__blocks").cast("int")
    v = beside(vectors).withColumns({"__sub": sub, "__asked": every("__blocks")}).drop("__subs", "__blocks")
    q = beside(asked).withColumns({"__sub": every("__subs"), "__asked": block}).drop("__subs", "__blocks")
    if wanted is not None:
        q = q.groupBy("query_id", *KEYS).agg(F.collect_list(group[0]).alias("__wanted")).join(queries, "query_id")
    v, q = (df.withColumn(c, F.col(c).cast("array<double>")) for df, c in ((v, "embedding"), (q, "query_vector")))
    kept = [f for f in vectors.schema if f.name != "embedding"]
    kept_q = [f for f in queries.schema if f.name != "query_vector" and f.name not in group]
    schema = StructType([*kept, *kept_q, StructField("score", DoubleType())])
    run = _pair_of_blocks(k, group, threshold, wanted is not None, [f.name for f in kept], [f.name for f in kept_q])
    q = q.toDF(*(f"__q{c}" for c in q.columns))  # both sides may come from the same tables
    return v.groupBy(*KEYS).cogroup(q.groupBy(*(f"__q{c}" for c in KEYS))).applyInArrow(run, schema)


def _pair_of_blocks(k: int, group: list[str], threshold: float | None, listed: bool, kept: list[str], kept_q: list[str]) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.rename_columns([c.removeprefix("__q") for c in right.column_names]).combine_chunks()
        at, of, scores = _best(left, right, k, group, threshold, listed) if len(left) and len(right) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        columns = {c: left[c].take(pa.array(at)) for c in kept} | {c: right[c].take(pa.array(of)) for c in kept_q}
        return pa.table(columns | {"score": pa.array(scores, mask=np.isneginf(scores))})

    return run


def _best(left: pa.Table, right: pa.Table, k: int, group: list[str], threshold: float | None, listed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of vectors, places of queries and scores of the best ``k`` of every query; -inf stands for
    null, which the cosine of vectors of different lengths is."""
    v, q = _matrix(left["embedding"], -1), _matrix(right["query_vector"], -2)
    width = max(v[0].shape[1], q[0].shape[1])
    v, q = (_Side(np.pad(m, ((0, 0), (0, width - m.shape[1]))), n) for m, n in (v, q))
    codes: dict = {}
    part = np.array([codes.setdefault(x, len(codes)) for x in _values(left, group)])
    if listed:
        wants = right["__wanted"].combine_chunks()
        number, code = np.repeat(np.arange(len(right)), np.diff(wants.offsets.to_numpy())), [codes.get((x,), -1) for x in wants.flatten().to_pylist()]
    else:
        number, code = np.arange(len(right)), [codes.get(x, -1) for x in _values(right, group)]
    code = np.asarray(code, np.int64)
    place = np.empty(len(left), np.int64)
    place[pc.sort_indices(left["id"], null_placement="at_start").to_numpy()] = np.arange(len(left))
    # Of equal vectors of one part the k of the smallest ids can be among the best.
    same = np.unique(np.concatenate([v.matrix, v.length[:, None]], axis=1).view(np.dtype((np.void, 8 * (width + 1)))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((place, same, part))
    new = np.r_[True, (part[order][1:] != part[order][:-1]) | (same[order][1:] != same[order][:-1])]
    order = order[_nth(new) < k]
    by_code = np.argsort(code, kind="stable")
    found, top = [], np.full((len(right), k), -np.inf)
    for c in range(len(codes)):
        rows = order[np.searchsorted(part[order], c) : np.searchsorted(part[order], c, "right")]
        mine = number[by_code[np.searchsorted(code[by_code], c) : np.searchsorted(code[by_code], c, "right")]]
        step = max(1, MATRIX // len(rows))
        for i in range(0, len(mine), step):
            one = _scored(v, q, rows, mine[i : i + step], top, k, threshold)
            if len(one[0]) > 4 * k * len(mine[i : i + step]):  # many ties, or scores that have no bound
                some = _first(k, one[1], one[2], place[one[0]])
                one = tuple(x[some] for x in one)
            found.append(one)
    at, of, scores = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = _first(k, of, scores, place[at])
    return at[order], of[order], scores[order]


def _first(k: int, of: np.ndarray, scores: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places of the best ``k`` of every query. NaN counts as the largest, as it does in Spark."""
    order = np.lexsort((place, np.where(np.isnan(scores), -np.inf, -scores), of))
    return order[_nth(np.r_[True, of[order][1:] != of[order][:-1]] if len(order) else np.zeros(0, bool)) < k]


def _nth(new: np.ndarray) -> np.ndarray:
    """Places in runs, from a mark at the first of each."""
    starts = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(starts, np.diff(np.r_[starts, len(new)]))


class _Side:
    """Vectors, filled up with zeros, with lengths and norms as the cosine has them."""

    def __init__(self, matrix: np.ndarray, length: np.ndarray):
        self.matrix, self.length = np.ascontiguousarray(matrix), length
        self.along = np.ascontiguousarray(matrix.T)  # one row a component
        with np.errstate(all="ignore"):
            square = np.zeros(len(matrix))
            for x in self.along:
                square += x * x
            self.norm = np.sqrt(square)
            usual = (self.norm > 1e-100) & (self.norm < 1e100)
            self.unit = np.where(usual[:, None], self.matrix / self.norm[:, None], 0.0)
        #: Their products say nothing; all their pairs are scored.
        self.odd = ~usual & (self.norm != 0)


def _scored(v: _Side, q: _Side, rows: np.ndarray, mine: np.ndarray, top: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that may be among the best ``k`` of a query, by its best products so far (``top``, which goes on)."""
    near = q.unit[mine] @ v.unit[rows].T
    apart = None
    if len(np.unique(v.length[rows])) > 1 or (q.length[mine] != v.length[rows[0]]).any():
        apart = q.length[mine][:, None] != v.length[rows][None, :]
        near[apart] = 0.0
        near[apart & ((q.norm[mine] > 0) & (q.length[mine] >= 0))[:, None] & ((v.norm[rows] > 0) & (v.length[rows] >= 0))[None, :]] = -np.inf
    odd = q.odd[mine][:, None] | v.odd[rows][None, :] if q.odd[mine].any() or v.odd[rows].any() else None
    if odd is not None:
        near[odd] = -np.inf
    most = min(k, len(rows))
    best = np.concatenate([top[mine], np.partition(near, len(rows) - most, axis=1)[:, len(rows) - most :]], axis=1)
    top[mine] = np.partition(best, most, axis=1)[:, most:]
    floor = top[mine].min(axis=1)
    if threshold is not None:
        floor = np.maximum(floor, threshold)
    may = near >= (floor - MARGIN)[:, None]
    i, j = np.nonzero(may if odd is None else may | odd)
    scores = np.zeros(len(i))
    for s in range(0, len(i), PAIRS):
        a, b = mine[i[s : s + PAIRS]], rows[j[s : s + PAIRS]]
        with np.errstate(all="ignore"):
            dot = np.zeros(len(a))
            for x, y in zip(v.along, q.along, strict=True):  # in the order of the cosine, so equal to it bit by bit
                dot += x[b] * y[a]
            norms = v.norm[b] * q.norm[a]
            both = (v.length[b] >= 0) & (q.length[a] >= 0) & ((norms > 0) | np.isnan(norms))
            scores[s : s + PAIRS] = np.where(both, np.where(v.length[b] == q.length[a], dot / norms, -np.inf), 0.0)
    if threshold is not None:
        good = (scores >= threshold) | np.isnan(scores)
        i, j, scores = i[good], j[good], scores[good]
    return rows[j], mine[i], scores


def _values(table: pa.Table, group: list[str]) -> list[tuple]:
    return list(zip(*(table[c].to_pylist() for c in group))) if group else [()] * len(table)


def _matrix(column: pa.ChunkedArray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows and their lengths; one that is null or has a null has the length ``none``, and zeros."""
    lists = column.combine_chunks()
    counts = pc.list_value_length(lists).fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    starts = np.r_[0, np.cumsum(np.maximum(counts, 0))]
    width = int(max(counts.max(initial=0), 0))
    values = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)
    if flat.null_count:
        holes = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
        bad = (counts >= 0) & (holes[starts[1:]] > holes[starts[:-1]])
    else:
        bad = np.zeros(len(counts), bool)
    if not bad.any() and (counts == width).all():
        return values.reshape(len(counts), width), counts.astype(float)
    out = np.zeros((len(counts), width))
    full = np.repeat(np.arange(len(counts)), np.maximum(counts, 0))
    out[full, np.arange(len(full)) - starts[full]] = values
    out[bad] = 0.0
    return out, np.where(bad, none, counts).astype(float)
