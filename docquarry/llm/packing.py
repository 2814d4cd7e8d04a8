"""Packing token pieces into sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 4096
UNIT = 16  # tokens per unit of the length histogram
#: A piece may be cut into parts of so many units, if whole pieces would leave over this
#: share of the sequences empty. The choice goes by the hash of a piece, in so many groups.
PART = 8
SPARE = 0.015
GROUPS = 64


class WordEncoder:
    """Token ids of words, as bytes of little-endian 32-bit numbers, kept in a table of bounded
    size. The pre-tokenizer never joins across ASCII white space, so a text's ids are those of
    its words. Words of ASCII letters go straight to the merges. Other words of letters are
    one pre-token each, whose last token ends a word; so many of them are encoded in one call
    and told apart by these tokens."""

    def __init__(self, tokenizer_file: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(tokenizer_file), most
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _each(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _together(self, words: list[bytes]) -> None:
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # some letters fold to other characters
            return self._each(words)
        data, a = ids.tobytes(), 0
        for w, b in zip(words, (cuts * 4).tolist(), strict=True):
            self.known[w] = data[a:b]
            a = b

    def _learn(self, words: list[bytes]) -> None:
        letters, other, merge = [], [], self.tokenizer.model.tokenize
        for w in words:
            if w.isalpha() and w.islower():
                self.known[w] = np.array([t.id for t in merge(w.decode())], "<u4").tobytes()
            else:
                (letters if w.decode().isalpha() else other).append(w)
        for i in range(0, len(letters), 2000):
            self._together(letters[i : i + 2000])
        for i in range(0, len(other), 2000):
            self._each(other[i : i + 2000])

    def ids(self, text: str) -> bytes:
        data = text.encode()
        # The tokenizer lower-cases, but finds its special tokens before; so do that here only
        # where none can arise.
        words = (data if b"<|" in data else data.lower()).split()
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
                new = list(set(words))
            # A letter before a last comma or stop: two pre-tokens.
            ended = {w: (w[:-1], w[-1:]) for w in new if len(w) > 1 and w[-1] in b",." and w[-2:-1].isalpha()}
            wanted = {x for pair in ended.values() for x in pair}
            wanted.update(w for w in new if w not in ended)
            self._learn([w for w in wanted if w not in known])
            for w, (a, b) in ended.items():
                known[w] = known[a] + known[b]
        return b"".join([known[w] for w in words])


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, parts) of every document: its token
    ids and the end id, cut at multiples of ``capacity``; ``parts`` has the digests of a last
    piece's parts, by which ``pack`` may cut it. One pass; only digests leave it."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = WordEncoder(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                n, view = len(ids) // 4, memoryview(ids)
                for start in range(0, n, capacity):
                    piece = view[4 * start : 4 * (start + capacity)]
                    parts = [zlib.crc32(piece[i : i + step]) for i in range(0, len(piece), step)] if len(piece) < 4 * capacity else None
                    for column, x in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, parts), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64()) if i == 5 else pa.int64()) for i, x in enumerate(rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"])

    step = 4 * UNIT * PART
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_pattern(prices: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: how often each size 1..capacity is taken
    for the highest total price."""
    worth, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = prices[:c] + worth[c - 1 :: -1][:c]  # size s leaves c - s
        s = int(total.argmax())
        worth[c], choice[c] = (total[s], s + 1) if total[s] > worth[c - 1] else (worth[c - 1], 0)
    taken, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if choice[c]:
            taken[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return taken


def column_generation(demand: np.ndarray, capacity: int, rounds: int = 100_000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering ``demand[s-1]`` pieces of each size s
    exactly. The linear program's columns are priced by ``best_pattern``; its solution is
    rounded down; what is left is packed from the largest on, each sequence filled as far as
    the remaining sizes can (``best_fill``). A program not solved in ``rounds`` steps fails."""
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    m = len(sizes)
    # Revised simplex; the first basis repeats one size per pattern.
    basis = np.zeros((m, m))
    basis[np.arange(m), np.arange(m)] = capacity // sizes
    cost, inverse = np.ones(m), np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand[sizes - 1]
    for _ in range(rounds):
        dual = cost @ inverse
        prices = np.zeros(capacity)
        prices[sizes - 1] = np.maximum(dual, 0)
        if dual.min() < -1e-9:  # more pieces than asked for: a surplus column
            i = int(dual.argmin())
            column, price = np.zeros(m), 0.0
            column[i] = -1
        else:
            column, price = best_pattern(prices, capacity)[sizes - 1].astype(float), 1.0
            if dual @ column <= 1 + 1e-7:
                break
        step = inverse @ column
        grows = step > 1e-9
        if not grows.any():
            break
        ratio = np.full(m, np.inf)
        ratio[grows] = x[grows] / step[grows]
        out = int(ratio.argmin())
        x -= ratio[out] * step
        x[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        basis[:, out], cost[out] = column, price
    else:
        raise RuntimeError("the linear program did not come to an end")
    left, used = demand[sizes - 1].astype(np.int64), []

    def take(pattern: np.ndarray, most: int) -> None:
        held = pattern > 0
        times = min(most, int((left[held] // pattern[held]).min())) if held.any() else 0
        if times:
            left[:] = left - times * pattern
            full = np.zeros(capacity, np.int64)
            full[sizes - 1] = pattern
            used.append((full, times))

    for j in np.argsort(-x):
        if cost[j]:
            take(basis[:, j].astype(np.int64), int(x[j] + 1e-6))
    while left.any():
        pattern = np.zeros(m, np.int64)
        top = int(np.flatnonzero(left)[-1])
        pattern[top] = 1
        pattern += best_fill(left - pattern, sizes, capacity - int(sizes[top]))
        take(pattern, int(left.max()))
    return used


def best_fill(left: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """How many of each size, at most ``left``, fill ``room`` best. Sums are bits of whole
    numbers, and counts are taken in powers of two."""
    reach, steps, mask = [1], [], (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        most, k = min(int(left[i]), room // int(sizes[i])), 1
        while most > 0:
            n = min(k, most)
            reach.append((reach[-1] | (reach[-1] << (n * int(sizes[i])))) & mask)
            steps.append((i, n))
            most, k = most - n, 2 * k
    taken, at = np.zeros(len(sizes), np.int64), reach[-1].bit_length() - 1
    for before, (i, n) in zip(reach[-2::-1], steps[::-1], strict=True):
        if not before >> at & 1:
            taken[i] += n
            at -= n * int(sizes[i])
    return taken


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, shard_rows: int = 50_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (doc_id, start, length, ...), which
    are at most ``capacity`` long.

    Lengths are counted in units (rounded up), a histogram of capacity/unit numbers by hash
    group, which is all that the driver sees. ``column_generation`` turns it into patterns.
    Where whole pieces cannot fill sequences well (all are a little over half a sequence,
    say), the pieces of some hash groups are cut into their ``parts`` to fill the gaps. Pieces of
    each size are ranked, in shards of bounded size, and rank ranges are dealt to the slots
    of the patterns; the table of ranges is bounded by the number of sizes, so it is
    broadcast. Inside a sequence the pieces follow each other without gaps.

    Repeated rows are pieces of their own; null doc_id ranks first; no rows, no sequences.
    """
    spark, units = pieces.sparkSession, capacity // unit
    size = F.ceil(F.col("length") / unit).cast("int")
    total = pieces.count()
    shards = max(64, total // shard_rows)
    p = _cut(pieces, size, units) if "parts" in pieces.columns else pieces
    names = [c for c in pieces.columns if c != "parts"]
    p = p.select(*names, size.alias("__dq_size"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).alias("__dq_shard"))
    counts = materialize(p.groupBy("__dq_size", "__dq_shard").agg(F.count("*").alias("n")), "sizes")
    demand = np.zeros(units, np.int64)
    for r in counts.groupBy("__dq_size").agg(F.sum("n").alias("n")).collect():  # capacity/unit rows at most
        demand[r["__dq_size"] - 1] = r["n"]
    rows, sequence, ranked = [], 0, np.zeros(units, np.int64)
    for pattern, times in column_generation(demand, units):
        slot = 0
        for s in np.flatnonzero(pattern)[::-1]:
            k = int(pattern[s])
            rows.append((int(s) + 1, int(ranked[s]), int(ranked[s]) + k * times, k, slot, sequence))
            ranked[s] += k * times
            slot += k
        sequence += times
    ranges = spark.createDataFrame(rows, "__dq_rsize int, __dq_from long, __dq_to long, __dq_each int, __dq_slot int, __dq_seq long")
    upto = Window.partitionBy("__dq_size").orderBy("__dq_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__dq_size", "__dq_shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__dq_before"))
    own = Window.partitionBy("__dq_size", "__dq_shard").orderBy("doc_id", "start")
    rank = p.withColumn("__dq_rank", F.row_number().over(own)).join(offsets, ["__dq_size", "__dq_shard"])
    rank = rank.withColumn("__dq_rank", F.col("__dq_rank") - 1 + F.col("__dq_before"))
    dealt = rank.join(F.broadcast(ranges), F.expr("__dq_size = __dq_rsize and __dq_rank >= __dq_from and __dq_rank < __dq_to"))
    nth = F.col("__dq_rank") - F.col("__dq_from")
    dealt = dealt.withColumns({
        "sequence_id": F.col("__dq_seq") + F.floor(nth / F.col("__dq_each")).cast("long"),
        "__dq_at": F.col("__dq_slot") + nth % F.col("__dq_each"),
    })
    inside = Window.partitionBy("sequence_id").orderBy("__dq_at").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(*names, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))


def _cut(pieces: DataFrame, size: Column, units: int) -> DataFrame:
    """``pieces`` with those of some hash groups cut into their parts, if that is needed."""
    group = F.pmod(F.xxhash64(F.lit("cut"), "doc_id", "start"), F.lit(GROUPS)).cast("int")
    by = np.zeros((units, GROUPS), np.int64)
    for r in pieces.groupBy(size.alias("s"), group.alias("g")).agg(F.count("*").alias("n")).collect():  # units * GROUPS rows at most
        by[r.s - 1, r.g] = r.n

    def demand(cut: int) -> np.ndarray:
        out, parted = by[:, cut:].sum(1), by[:, :cut].sum(1)
        out[-1] += parted[-1]  # full pieces stay whole
        for s in np.flatnonzero(parted[:-1]) + 1:
            full = (s - 1) // PART
            out[PART - 1] += full * parted[s - 1]
            out[s - full * PART - 1] += parted[s - 1]
        return out

    def spare(cut: int) -> float:
        d = demand(cut)
        used = sum(n for _, n in column_generation(d, units)) * units
        return (used - int((d * np.arange(1, units + 1)).sum())) / max(used, 1)

    tried = {0: spare(0)}
    while tried[max(tried)] > SPARE and max(tried) < GROUPS:
        last = max(tried)
        cut = min(GROUPS, last + max(1, int(np.ceil(GROUPS * tried[last]))))
        tried[cut] = spare(cut)
    cut = min(tried, key=lambda c: (tried[c] > SPARE, c if tried[c] <= SPARE else tried[c]))
    if not cut:
        return pieces
    apart = (group < cut) & (size < units) & F.col("parts").isNotNull()
    step = PART * UNIT
    part = F.posexplode("parts").alias("i", "crc")
    small = pieces.where(apart).select("*", part).withColumns({
        "ids_crc32": F.col("crc"), "start": F.col("start") + F.col("i") * step, "length": F.least(F.lit(step), F.col("length") - F.col("i") * step),
    })
    return pieces.where(~apart).unionByName(small.drop("i", "crc"))


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and pack all pieces: (doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset). Null or empty text: the end id alone."""
    return pack(materialize(tokenized_pieces(docs, tokenizer_file, end_id, capacity), "pieces"), capacity)
