"""Language-model scores: corpus counts, trained context mixing and a word baseline."""

from __future__ import annotations

import ctypes
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mixing
from .common import drop_materialized, materialize

#: Bytes of text whose words are looked up together, and slots of a table shipped together.
BLOCK = 8_000_000
SLICE = 1 << 17
#: Bytes of training text after which a task ships its tables: their 32-bit counts cannot wrap.
SHIP = 1 << 26
#: One of so many training documents fits the weights of the gates before its counts are added.
FIT = 32
FIT_STEPS = 3


def is_held_out(doc_id: Column) -> Column:
    """Documents that are scored but not learned from: crc32 of the id as text, mod 10, is 0."""
    return _crc(doc_id) % 10 == 0


def _crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def release() -> None:
    """Give what a task has freed back to the system, as its worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of ``texts``, how many words each text has, and each word's place
    among the different ones."""
    lists = pc.ascii_split_whitespace(texts)
    words, of = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")  # white space at an end leaves an empty word
    coded = words.filter(full).dictionary_encode()
    many = np.bincount(of.filter(full).to_numpy(), minlength=len(texts))
    return coded.dictionary.cast(pa.binary()).to_pylist(), many, coded.indices.to_numpy()


def _blocks(docs: DataFrame, shards: int) -> DataFrame:
    """Of ``docs`` (doc_id, mark, held_out, text): for each block of rows one row with its
    documents (shard -1: ids, word numbers), one row per shard of words with the block's
    different words and how often its training documents hold each, and one row (shard -2)
    with how often these hold each three bytes in a row."""
    names = ["block", "shard", "words", "counts", "doc_id", "known", "mark", "held_out", "sizes"]
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    arrow = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        ids, known, marks, held, sizes, numbers, number, times, size, threes, few, few_size = [], [], [], [], [], [], {}, [], 0, {}, [], 0

        def add_threes():
            nonlocal few, few_size
            if few:
                # Two end bytes before a text, one after it; what runs across texts is left out.
                s = np.frombuffer(b"".join(b"\xff\xff" + t + b"\xff" for t in few), np.uint8).astype(np.uint32)
                key = (s[:-2] << 16) | (s[1:-1] << 8) | s[2:]
                key = np.sort(key[(s[1:-1] != 255) | (s[:-2] == 255)])
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                for k, n in zip(key[first].tolist(), np.diff(np.append(first, len(key))).tolist(), strict=True):
                    threes[k] = threes.get(k, 0) + n
            few, few_size = [], 0

        def flush():
            nonlocal ids, known, marks, held, sizes, numbers, number, times, size, serial, threes
            add_threes()
            block, serial = f"{part}-{serial}", serial + 1
            found = list(number)
            shard = np.fromiter((zlib.crc32(w) % shards for w in found), np.int32, len(found))
            order = np.argsort(shard, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            seen = np.bincount(np.concatenate([np.empty(0, np.uint32), *times]), minlength=len(found)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            rows = [(block, -1, rank[np.concatenate(numbers)].tobytes(), None, ids, known, marks, held, sizes)]
            for at in np.split(order, cuts) if len(order) else []:
                rows.append((block, int(shard[at[0]]), b" ".join([found[i] for i in at.tolist()]), seen[at].tobytes(), None, None, None, None, None))
            keys = np.array(list(threes), np.int64)
            rows.append((block, -2, keys.tobytes(), np.array(list(threes.values()), np.int64).tobytes(), None, None, None, None, None))
            out = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)
            ids, known, marks, held, sizes, numbers, number, times, size, threes = [], [], [], [], [], [], {}, [], 0, {}
            return out.to_batches()

        for b in batches:
            texts = pc.ascii_lower(b.column(3).fill_null(""))
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < len(texts):
                # Rows up to the one that fills the block.
                before = int(ends[at - 1]) if at else 0
                to = min(len(texts), int(np.searchsorted(ends, before + BLOCK - size)) + 1)
                some, n_words, n = split_words(texts.slice(at, to - at))
                for w in some:
                    if w not in number:
                        number[w] = len(number)
                n = np.fromiter(map(number.__getitem__, some), np.uint32, len(some))[n]
                train = ~np.array(b.column(2).slice(at, to - at).to_pylist(), bool)
                ids += [i or 0 for i in b.column(0).slice(at, to - at).to_pylist()]
                known += b.column(0).slice(at, to - at).is_valid().to_pylist()
                marks += b.column(1).slice(at, to - at).to_pylist()
                held += (~train).tolist()
                sizes += n_words.tolist()
                numbers.append(n)
                times.append(n[np.repeat(train, n_words)])
                for data in texts.slice(at, to - at).filter(pa.array(train)).cast(pa.binary()):
                    few.append(data.as_py())
                    few_size += len(few[-1])
                    if few_size > mixing.BATCH:
                        add_threes()
                size, at = size + int(ends[to - 1]) - before, to
                if size >= BLOCK:
                    yield from flush()
        if ids:
            yield from flush()
        release()

    return docs.mapInArrow(run, "block string, shard int, words binary, counts binary, doc_id array<long>, known array<boolean>, mark array<long>, held_out array<boolean>, sizes array<long>")


def _words(blocks: DataFrame) -> DataFrame:
    """Per shard: one row with the number of its different training words and of all (block
    null), and for each block's row the training counts of its words, in its order."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        parts = [w.split(b" ") for w in pdf["words"]]
        for words, counts in zip(parts, pdf["counts"], strict=True):
            for w, n in zip(words, np.frombuffer(counts, np.int64).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        rows = [(b, key[0], np.fromiter(map(total.__getitem__, words), np.int64, len(words)).tobytes(), 0, 0) for b, words in zip(pdf["block"], parts, strict=True)]
        rows.append((None, key[0], None, sum(n > 0 for n in total.values()), sum(total.values())))
        return pd.DataFrame(rows, columns=["block", "shard", "counts", "words", "tokens"])

    return blocks.where("shard >= 0").select("shard", "block", "words", "counts").groupBy("shard").applyInPandas(run, "block string, shard int, counts binary, words long, tokens long")


def _base(blocks: DataFrame, words: DataFrame, tokens: int, distinct: int, ends: int) -> DataFrame:
    """Per row: (doc_id, mark, held_out, n_tokens, n_known, base_score)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        head = pdf.iloc[0]
        counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in pdf["counts"].iloc[1:])])
        at, sizes = np.frombuffer(head["words"], np.uint32), np.asarray(head["sizes"], np.int64)
        over = tokens + 0.1 * (distinct + 1)
        end = float(np.log10((ends + 0.1) / over))
        stops = np.concatenate(([0], np.cumsum(sizes)))
        # A padding zero lets texts without words be summed too.
        add = lambda x: np.where(sizes > 0, np.add.reduceat(np.append(x[at], 0), stops[:-1]), 0)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(np.array(head["doc_id"], np.int64), ~np.array(head["known"], bool)), "mark": head["mark"], "held_out": head["held_out"],
            "n_tokens": sizes + 1, "n_known": add((counts > 0).astype(np.int64)).astype(np.int64) + int(ends > 0), "base_score": add(np.log10((counts + 0.1) / over)) + end,
        })

    none = ["cast(null as array<bigint>) as doc_id", "cast(null as array<boolean>) as known", "cast(null as array<bigint>) as mark", "cast(null as array<boolean>) as held_out", "cast(null as array<bigint>) as sizes"]
    answers = words.where("block is not null").selectExpr("block", "shard", "cast(null as binary) as words", "counts", *none)
    heads = blocks.where("shard = -1")
    schema = "doc_id long, mark long, held_out boolean, n_tokens long, n_known long, base_score double"
    return heads.unionByName(answers).groupBy("block").applyInPandas(run, schema)


def _code(blocks: DataFrame) -> mixing.Code:
    """The byte code, from the training texts' counts of three bytes in a row. To the driver
    come 65,536 counts and those after the ``mixing.TREES`` most frequent pairs."""

    def run(batches):
        for b in batches:
            for k, n in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k.as_py(), np.int64)), pa.array(np.frombuffer(n.as_py(), np.int64))], ["k", "n"])

    threes = blocks.where("shard = -2").select("words", "counts").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    threes = materialize(threes.withColumn("pair", F.expr("k div 256")), "threes")
    one, two = np.zeros((256, 256), np.int64), {}
    for r in threes.groupBy(F.expr("k % 65536").alias("k")).agg(F.sum("n").alias("n")).collect():
        one[r.k // 256, r.k % 256] = r.n
    top = threes.groupBy("pair").agg(F.sum("n").alias("all")).where(F.col("all") >= mixing.TREE_COUNT).orderBy(F.desc("all"), "pair").limit(mixing.TREES)
    for r in threes.join(F.broadcast(top), "pair").select("pair", "k", "n").collect():
        two.setdefault(r.pair, np.zeros(256, np.int64))[r.k % 256] = r.n
    return mixing.Code(one, two)


def pack(counts: np.ndarray) -> bytes:
    """Counts as bytes, and where one is 255 or more its place and all of it; then compressed,
    behind the length."""
    more = np.flatnonzero(counts >= 255)
    data = np.minimum(counts, 255).astype(np.uint8).tobytes() + more.astype("<u4").tobytes() + counts[more].astype("<u4").tobytes()
    return len(data).to_bytes(4, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def add_packed(sums: np.ndarray, data: bytes) -> None:
    """Add counts that ``pack`` has packed to ``sums``."""
    data = pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)
    sums += np.frombuffer(data, np.uint8, len(sums))
    more, counts = np.frombuffer(data, "<u4", offset=len(sums)).reshape(2, -1)
    sums[more] += counts.astype(np.int64) - 255


def _counted(texts: DataFrame, code, bits: list[int], fit: bool) -> DataFrame:
    """The tables that tasks count from ``texts`` (one column), as rows of compressed slices."""

    def run(batches):
        held = 0
        tables = [np.zeros(2 << s, np.uint32) for s in bits]

        def ship():
            for k, t in enumerate(tables):
                for i in range(0, len(t), 2 * SLICE):
                    part = t[i : i + 2 * SLICE]
                    if part.any():
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i // 2], pa.int64()), pa.array([fit]), pa.array([pack(part)], pa.binary())], ["k", "at", "fit", "counts"])
                t[:] = 0

        part, size = [], 0
        for b in batches:
            for text in b.column(0):
                for p in mixing.pieces(_lower(text.as_py())):
                    if part and size + len(p) > mixing.GROUP:
                        mixing.count(part, code.value, tables)
                        part, size = [], 0
                    part.append(p)
                    size += len(p)
                    held += len(p)
                    if held > SHIP:
                        mixing.count(part, code.value, tables)
                        part, size, held = [], 0, 0
                        yield from ship()
        if part:
            mixing.count(part, code.value, tables)
        yield from ship()
        del tables
        release()

    return texts.mapInArrow(run, "k int, at long, fit boolean, counts binary")


def summed(batches, bits: list[int]):
    """Packed counts (k, at, fit, counts), sorted by slice, as finished slices of the mixer's
    tables: without (which 0) and with (1) the texts that fit the weights. One slice is held at
    a time."""
    now = sums = None

    def finished():
        (k, at), n = now, sums[0].copy()
        for which in (0, 1):
            n += sums[1] if which else 0
            done = [(k, mixing.stretched(n))]
            if mixing.CONTEXTS[k] in mixing.SEEN:
                i = list(mixing.SEEN).index(mixing.CONTEXTS[k])
                done.append((len(mixing.CONTEXTS) + i, mixing.classes(n, mixing.SEEN[mixing.CONTEXTS[k]])))
            for table, x in done:
                yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([table], pa.int32()), pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["which", "k", "at", "done"])

    for b in batches:
        for k, at, fit, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if now != (k, at):
                if now:
                    yield from finished()
                now, sums = (k, at), np.zeros((2, 2 * min(SLICE, 1 << bits[k])), np.int64)
            add_packed(sums[int(fit)], c.as_py())
    if now:
        yield from finished()


def _tables(texts: DataFrame, sample: DataFrame, code, bits: list[int]) -> DataFrame:
    """Slices of the mixer's tables, see ``summed``. Tasks count, and equal slices are added up
    across tasks."""
    parts = _counted(texts, code, bits, False).unionByName(_counted(sample, code, bits, True))
    each = parts.repartition("k", "at").sortWithinPartitions("k", "at")
    return materialize(each.mapInArrow(lambda batches: summed(batches, bits), "which int, k int, at long, done binary"), "tables")


def _collected(tables: DataFrame, which: int, bits: list[int]) -> list[np.ndarray]:
    sizes = [*bits, *(bits[mixing.CONTEXTS.index(k)] for k in mixing.SEEN)]
    out = [np.zeros(1 << s, np.int8) for s in sizes]
    for r in tables.where(F.col("which") == which).select("k", "at", "done").toLocalIterator():
        out[r.k][r.at : r.at + len(r.done)] = np.frombuffer(r.done, np.int8)
    return out


def _weights(sample: DataFrame, code, tables) -> np.ndarray:
    """The gates' weights: Newton steps whose sums, a few numbers per gate, Spark adds up over
    the sampled texts, under tables that have not counted these."""
    weights = np.full((mixing.GATES, mixing.INPUTS), mixing.FIRST_WEIGHT)
    width = mixing.INPUTS * (mixing.INPUTS + 1)

    def sums(now):
        def run(batches):
            mixer, total = mixing.Mixer(code.value, tables.value), np.zeros((mixing.GATES, width))
            for b in batches:
                texts = [_lower(t.as_py()) for t in b.column(0)]
                for part in mixing.batches(texts):
                    for p in mixing.pieces(texts[part[0]]) if len(part) == 1 else [None]:
                        x, gate, bit, *_ = mixer.inputs([p] if p else [texts[j] + mixing.END_BYTE for j in part])
                        total += mixing.newton_sums(x, gate, bit, now)
            del mixer
            release()
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "x"])

        return sample.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))

    for _ in range(FIT_STEPS):
        found = np.zeros(mixing.GATES * width)
        for r in sums(weights).collect():  # GATES * INPUTS * (INPUTS + 1) rows
            found[r.i] = r.x
        weights = mixing.newton_step(found.reshape(mixing.GATES, width), weights)
    return weights


def lm_scores(docs: DataFrame, most_bits: int = 22) -> DataFrame:
    """Score the texts of ``docs`` (doc_id, text): (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, n_bytes, bits_per_byte) per row.

    ``score`` is the log10 probability of the lower-cased text and its end under the context
    mixing model of ``mixing``, learned from all rows that are not held out, then adapting
    online within each text; ``base_score`` is the word unigram baseline.

    Texts are read three times and never shuffled. The first pass turns blocks of rows into
    word numbers plus, by shard of words, the block's different words and their training
    counts; shards, whose number follows the counted input, add these up over the corpus and
    answer each block with the counts of its words. The second pass counts the model's
    tables over all training texts; their size follows the counted training bytes up to
    2^``most_bits`` slots a context, the bound that makes them fit for a broadcast. The weights of
    the gates are fitted on one of ``FIT`` training documents, chosen by hash. The third pass
    scores.

    Null or empty text: no words, one end. Null doc_id: id text '' decides on held_out, the
    row keeps its null. Repeated rows: each is learned from and returned. No training rows:
    all counts 0, and the model is uniform over the code. Empty table: no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("mark"), is_held_out(F.col("doc_id")).alias("held_out"),
        (F.floor(_crc(F.col("doc_id")) / 10) % FIT == 0).alias("fit"), text.alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("all"), F.sum(F.when(~F.col("held_out"), F.octet_length("text"))).alias("train"), F.count_if(~F.col("held_out")).alias("ends")).first()
    ends, shards = size["ends"], max(8, (size["all"] or 0) // 4_000_000)
    blocks = materialize(_blocks(rows.select("doc_id", "mark", "held_out", "text"), shards), "blocks")
    words = materialize(_words(blocks), "words")
    n = words.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    tokens, distinct = n[1] + ends, n[0] + int(ends > 0)

    code = spark.sparkContext.broadcast(_code(blocks))
    grown = max(10, math.ceil(math.log2(max(size["train"] or 0, 1))) + 1)
    bits = [min(s, grown, most_bits) for s in mixing.SIZES]
    sample = materialize(rows.where("not held_out and fit").select("text"), "sample")
    # The finished tables, of a size that ``bits`` bounds, come to the driver one after the other.
    tables = _tables(rows.where("not held_out and not fit").select("text"), sample, code, bits)
    fitting = spark.sparkContext.broadcast(_collected(tables, 0, bits))
    weights = _weights(sample, code, fitting)
    fitting.destroy()
    model = spark.sparkContext.broadcast((_collected(tables, 1, bits), weights))

    def run(batches):
        mixer = mixing.Mixer(code.value, *model.value)
        for b in batches:
            texts = [_lower(t.as_py()) for t in b.column(2)]
            score = mixer.score(texts) * -np.log10(2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, texts)), pa.int64()), pa.array(score)], ["id", "mark", "n_bytes", "score"])
        del mixer
        release()

    scored = materialize(rows.select("doc_id", "mark", "text").mapInArrow(run, "id long, mark long, n_bytes long, score double"), "scores").dropDuplicates(["id", "mark"])
    model.destroy()
    code.destroy()
    drop_materialized(sample)
    drop_materialized(tables)
    base = _base(blocks, words, tokens, distinct, ends)
    both = base.join(scored.withColumnRenamed("mark", "same"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("same")))
    return both.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (F.col("score") / -np.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
