"""Blocks of postings: terms are counted per row and rows gathered per term, in Arrow batches, so that one
row of a stored index holds many postings and nothing is shuffled posting by posting."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens (or postings) that are gathered together, postings of a block, rows of an Arrow batch of token arrays.
GATHERED, BLOCK, BATCH_ROWS = 2_000_000, 4096, 1000
POSTINGS = "postings array<struct<chunk_id:{0},size:int,f:double>>"
BLOCKS = f"term string, collection_id string, ingest_run_id string, {POSTINGS}"


def _gathered(batches: Iterable[pa.RecordBatch], weigh) -> Iterator[pa.RecordBatch]:
    """Batches joined up to ``GATHERED`` of what ``weigh`` counts per row; larger ones are cut."""
    held, size = [], 0
    for b in batches:
        n = weigh(b)
        at, total = 0, np.cumsum(n)
        while at < len(n):
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + GATHERED - size, side="right")))
            held.append(b.slice(at, to - at))
            size += int(total[to - 1]) - before
            at = to
            if size >= GATHERED or at < len(n):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _codes(c: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of equal values (-1: null), and the values."""
    d = c.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _owners(b: pa.RecordBatch) -> np.ndarray:
    """One number for each collection and run."""
    (one, _), (two, values) = (_codes(b.column(b.schema.get_field_index(c))) for c in ("collection_id", "ingest_run_id"))
    return np.unique(one * (len(values) + 1) + two, return_inverse=True)[1]


def _blocks(terms: pa.Array, code: np.ndarray, row: np.ndarray, f: np.ndarray, owner: np.ndarray, b: pa.RecordBatch) -> dict[str, pa.Array]:
    """Postings, sorted by term and owner, as blocks; ``row`` is where in ``b`` a posting's row is."""
    own = owner[row]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])))
    first = np.flatnonzero(new)
    start = np.flatnonzero((np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))) % BLOCK == 0)
    at = pa.array(row)
    each = pa.StructArray.from_arrays([b.column("chunk_id").take(at), b.column("size").take(at), pa.array(f, pa.float64())], ["chunk_id", "size", "f"])
    lead = pa.array(row[start])
    return {
        "term": terms.take(pa.array(code[start])), "collection_id": b.column("collection_id").take(lead), "ingest_run_id": b.column("ingest_run_id").take(lead),
        "postings": pa.ListArray.from_arrays(pa.array(np.append(start, len(code)), pa.int32()), each),
    }


def _out(columns: dict[str, pa.Array], names: Sequence[str], like: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    whole = pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, like[c]) for c in names], list(names))
    for i in range(0, n, 10_000):
        yield whole.slice(i, 10_000)


def counted(chunks: DataFrame, weights: Sequence[float], id_type: str) -> DataFrame:
    """Of ``chunks`` (chunk_id, collection_id, ingest_run_id, size, content_hash, tokens array<string>, parts
    array<int>: how many tokens each weight is for) two kinds of rows: each chunk's own (term null)
    and blocks of postings (term, collection_id, ingest_run_id, postings). One pass, nothing is shuffled."""
    weights = np.array(weights, np.float64)
    own = ["chunk_id", "collection_id", "ingest_run_id", "size", "content_hash"]
    names = ["term", "postings", *own]

    def run(batches):
        for b in _gathered(batches, lambda b: pc.list_value_length(b.column("tokens")).fill_null(0).to_numpy(zero_copy_only=False) + 1):
            post = pa.list_(pa.struct([("chunk_id", b.schema.field("chunk_id").type), ("size", pa.int32()), ("f", pa.float64())]))
            like = {"term": pa.string(), "postings": post} | {c: b.schema.field(c).type for c in own}
            yield from _out({c: b.column(c) for c in own}, names, like)
            n, owner = b.num_rows, _owners(b)
            lists = b.column("tokens")
            code, terms = _codes(lists.flatten())
            row = np.repeat(np.arange(n), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            # A list of parts for each row with tokens, in their order.
            held = np.where(lists.is_null().to_numpy(zero_copy_only=False)[:, None], 0, np.array(b.column("parts").flatten().fill_null(0)).reshape(n, len(weights)))
            w = np.repeat(np.tile(weights, n), held.ravel())
            order = np.argsort(owner, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            key = code * n + rank[row]
            by = np.argsort(key, kind="stable")[np.count_nonzero(code < 0) :]  # none for null tokens
            key = key[by]
            if len(key):
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                f, key = np.add.reduceat(w[by], first), key[first]
                yield from _out(_blocks(terms, key // n, order[key % n], f, owner, b), names, like)

    return chunks.mapInArrow(run, f"term string, {POSTINGS.format(id_type)}, chunk_id {id_type}, collection_id string, ingest_run_id string, size int, content_hash string")


def gathered(postings: DataFrame, id_type: str) -> DataFrame:
    """Single postings (term, chunk_id, size, collection_id, ingest_run_id, f) as blocks."""
    names = ["term", "collection_id", "ingest_run_id", "postings"]

    def run(batches):
        for b in _gathered(batches, lambda b: np.ones(b.num_rows, np.int64)):
            code, terms = _codes(b.column("term"))
            owner = _owners(b)
            row = np.argsort(code * (owner.max() + 1) + owner, kind="stable")
            yield from _out(_blocks(terms, code[row], row, b.column("f").to_numpy(zero_copy_only=False)[row], owner, b), names, {})

    return postings.select("term", "chunk_id", "size", "collection_id", "ingest_run_id", "f").mapInArrow(run, BLOCKS.format(id_type))


def opened(blocks: DataFrame) -> DataFrame:
    """The postings of blocks, one a row, beside the blocks' other columns."""
    return blocks.select(*(c for c in blocks.columns if c != "postings"), F.inline("postings"))
