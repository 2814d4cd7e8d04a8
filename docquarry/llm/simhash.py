"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, shuffled, sized
from .components import connected_components

SEED = 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; a text of fewer words is one shingle,
    a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", len(words) - size + 1)


def _derived(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash, by the SplitMix64 steps (public constants)."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``words`` signed 64-bit words; a bit is 1 if set in over half the hashes. The first
    word is of the hashes themselves."""
    if not len(hashes):
        return [0] * words
    out = []
    for k in range(words):
        h = _derived(hashes, k) if k else hashes
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
            ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp array<long>, same binary). With ``distinct`` a repeated shingle counts
    once, and ``same`` is a 128-bit digest of the set of shingles; otherwise it is null."""

    def run(batches):
        for b in batches:
            fps, same = [], []
            for text in b.column(1):
                h = shingle_hashes(text.as_py(), shingle)
                if distinct:
                    h = np.unique(h)
                fps.append(fingerprint(h, words))
                same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if distinct else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64())), pa.array(same, pa.binary())], ["doc_id", "fp", "same"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp array<long>, same binary")


def segment(fp: Column, index: int, bits: int) -> Column:
    """Bits index*bits .. (index+1)*bits of the fingerprint, within one 64-bit word."""
    per = 64 // bits
    return F.shiftrightunsigned(fp[index // per], (index % per) * bits).bitwiseAND((1 << bits) - 1)


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def segment_tables(nodes: DataFrame, segments: int, bits: int, *also: str) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes`` (id, fp): the table (seg, key, b) of exact segment values, and the probes
    (seg, key, a, exact) with the ball of radius 1 around each; both with the columns
    ``also``. A pair one bit apart in a segment has one value of even and one of odd parity,
    so only even values flip bits."""
    values = F.array(*(F.struct(F.lit(i).alias("seg"), segment(F.col("fp"), i, bits).alias("key")) for i in range(segments)))
    table = nodes.select("id", *also, F.explode(values).alias("s")).select("s.seg", "s.key", F.col("id").alias("b"), *also)
    key = F.col("key")
    flips = F.array(*(key.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(bits)))
    ball = F.when(F.bit_count(key) % 2 == 0, F.concat(F.array(key), flips)).otherwise(F.array(key))
    probes = table.select("seg", F.posexplode(ball).alias("flip", "key"), F.col("b").alias("a"), *also)
    return table, probes.select("seg", "key", "a", (F.col("flip") == 0).alias("exact"), *also)


def _matches(table: DataFrame, probes: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that meet in a segment bucket of at most ``crowd`` nodes, each once or a
    few times; and the buckets (seg, key, least) that hold more."""
    crowded = table.groupBy("seg", "key").agg(F.count("*").alias("n"), F.min("b").alias("least"))
    crowded = materialize(crowded.where(F.col("n") > crowd).select("seg", "key", "least"), "crowded")
    few = table.join(sized(crowded), ["seg", "key"], "left_anti")
    pairs = probes.join(shuffled(few), ["seg", "key"]).where("a <> b and (not exact or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.distinct(), crowded


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, crowd: int = 64) -> DataFrame:
    """One row per document: (doc_id, fp long, component_id), linking 64-bit fingerprints
    at most ``radius`` (0 to 2) bits apart; component_id is the least doc_id reachable.

    Equal fingerprints collapse first (a map-side combined minimum), so copies cost one
    node. Two 32-bit segments: of two fingerprints within 3 bits, one segment differs in at
    most 1, so balls of radius 1 in each segment find all pairs, and the complete distance
    is then verified. A bucket of over ``crowd`` fingerprints makes no pairs: its members,
    and all probes that reach it, meet instead at the whole fingerprints one bit around
    each. Any two within 2 bits share such a point, and any two that share one are within
    2 bits, so linking all to the least at each point loses and adds nothing.

    Null text: no words, fingerprint 0, linked like any other. Null doc_id: its row is
    returned with a null component. Repeated rows and ties: same fingerprint, same
    component, one output row per input row. Empty table: no rows.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    prints = materialize(fingerprints(docs, shingle).select("doc_id", F.col("fp")[0].alias("fp")), "prints")
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    # The fingerprint itself is the id while matching.
    table, probes = segment_tables(nodes.select(F.col("fp").alias("id"), F.array("fp").alias("fp")), 2, 32)
    pairs, crowded = _matches(table, probes, crowd)
    close = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    reach = probes.join(sized(crowded.select("seg", "key")), ["seg", "key"], "left_semi").select(F.col("a").alias("fp")).distinct()
    around = F.concat(F.array("fp"), F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64))))
    points = reach.select("fp", F.explode(around if radius == 2 else F.array("fp")).alias("at"))
    least = points.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("at", "a")
    met = points.join(shuffled(least), "at").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    edges = close.unionByName(met).distinct() if radius else close.limit(0)
    rep = lambda k: shuffled(nodes.select(F.col("fp").alias(k), F.col("rep").alias(f"{k}_rep")))
    by_id = edges.join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    found = connected_components(by_id)
    labels = nodes.join(shuffled(found), nodes.rep == found.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = prints.join(shuffled(labels), "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes array<long>): the distinct shingles of the documents in ``ids``."""

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])

    one = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sized(ids), "id", "left_semi")
    return one.mapInArrow(run, "id long, hashes array<long>").dropDuplicates(["id"])


def _near(pairs: DataFrame, nodes: DataFrame, far: int) -> DataFrame:
    """Of the pairs (text, lead), a few for each text, those whose fingerprints are at most
    ``far`` bits apart, as (a, b)."""
    fp = lambda k: shuffled(nodes.select(F.col("id").alias(k), F.col("fp").alias(f"{k}_fp")))
    by_text = pairs.groupBy("text").agg(F.collect_set("lead").alias("leads")).join(fp("text"), "text")
    both = by_text.select("text", "text_fp", F.explode("leads").alias("lead")).join(fp("lead"), "lead")
    close = both.where(distance(F.col("text_fp"), F.col("lead_fp")) <= far)
    return close.select(F.least("text", "lead").alias("a"), F.greatest("text", "lead").alias("b")).distinct()


def _alike(close: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose shingle sets are similar enough."""
    close = materialize(close, "close")
    ids = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
    sets = materialize(_sets(docs, ids, shingle), "sets")
    of = lambda k: shuffled(sets).select(F.col("id").alias(k), F.col("hashes").alias(f"{k}_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    alike = F.when(F.size("a_set") + F.size("b_set") == 0, F.lit(1.0)).otherwise(shared / (F.size("a_set") + F.size("b_set") - shared))
    found = materialize(close.join(of("a"), "a").join(of("b"), "b").where(alike >= similarity).select("a", "b"), "alike")
    drop_materialized(close)
    drop_materialized(sets)
    return found


def differing(similarity: float) -> float:
    """The chance that a bit differs between sets of this Jaccard similarity, at most: their
    cosine c is at least 2s/(1+s), and the chance is acos(c)/pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def segments_for(bits: int, similarity: float, miss: float) -> int:
    """How many segments of so many bits it takes until a pair of this similarity differs by
    more than one bit in all of them with a chance of at most ``miss`` (binomial model)."""
    p = differing(similarity)
    found = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return math.ceil(math.log(miss) / math.log1p(-found))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, miss: float = 0.05, bits: int | None = None, crowd: int = 1024, most_broadcast: int = 500_000
) -> DataFrame:
    """(doc_id, component_id) for every row with a doc_id: documents whose shingle sets have
    a Jaccard similarity of at least ``similarity`` are linked.

    A longer SimHash is cut into segments, whose width (``bits``) grows with the number of
    texts (24 to 32 bits), so that chance matches stay a few per text. The number of segments
    grows with the width, so that at every size a pair of the least ``similarity`` is missed
    with a chance of at most ``miss``. Texts that agree in any segment up to one bit are
    candidates; their complete distance, then their exact similarity is verified.

    First each text meets the least text of every bucket that it reaches: linear, however
    large a bucket is. The groups so found are known when each text meets all other members
    of every bucket that it reaches: only pairs of different groups are compared, and their
    complete distance is verified where they meet, so that only close pairs leave the join.
    In a bucket the members of the least text's group are one side, the others another:
    texts of that group meet the others only, so a bucket of n texts, k of them outside the
    group, costs n * k comparisons. A side of over ``crowd`` members is compared in blocks of
    about so many, each a join key of its own, so no task has to take a whole bucket.

    Fingerprints are of the distinct shingles, as the similarity is. Texts with equal shingle
    sets (by a 128-bit digest) collapse to one node first.
    Null and empty texts are equal and form one group. Null doc_id: left out here.
    """
    bits = bits or min(32, max(24, math.ceil(math.log2(max(2, docs.where("doc_id is not null").count()))) + 7))
    segments = segments_for(bits, similarity, miss)
    words = math.ceil(segments / (64 // bits))
    prints = materialize(fingerprints(docs, shingle, words, distinct=True).where("doc_id is not null"), "prints")
    nodes = materialize(prints.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp")), "nodes")
    # The bits that differ are binomial: keep up to four deviations above the mean.
    p, n = differing(similarity), 64 * words
    far = int(n * p + 4 * math.sqrt(n * p * (1 - p))) + 1
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    table, probes = segment_tables(nodes, segments, bits)
    buckets = table.groupBy("seg", "key").agg(F.min("b").alias("b"), F.count("*").alias("n"))
    first = probes.join(shuffled(buckets.select("seg", "key", F.col("b").alias("lead"))), ["seg", "key"]).where("a <> lead").select(F.col("a").alias("text"), "lead")
    edges = _alike(_near(first, nodes, far), docs, shingle, similarity)
    groups = materialize(connected_components(edges), "groups")

    of = nodes.join(sized(groups.withColumnRenamed("id", "__dq_id")), F.col("id") == F.col("__dq_id"), "left").select("id", "fp", F.coalesce("component", "id").alias("group"))
    table, probes = segment_tables(of, segments, bits, "group")
    shared = table.join(shuffled(buckets.where("n > 1").select("seg", "key", F.col("b").alias("least"))), ["seg", "key"])
    lead = of.select(F.col("id").alias("least"), F.col("group").alias("lead"))
    rest = materialize(shared.where("b <> least").join(shuffled(lead), "least").select("seg", "key", "b", "least", F.col("group").alias("b_group"), "lead"), "rest")
    aside = F.col("b_group") != F.col("lead")
    blocks = lambda n: F.ceil(n / F.lit(crowd)).cast("int")
    sides = rest.groupBy("seg", "key", "lead").agg(blocks(F.count_if(aside)).alias("others"), blocks(F.count_if(~aside)).alias("own"))
    sides = materialize(sides, "sides")
    # Only probes that reach such a bucket, and have someone to meet, carry their fingerprint on.
    keys = F.broadcast(sides) if sides.count() <= most_broadcast else shuffled(sides)
    every = lambda other, n: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(other).alias("other"), i.alias("block")))
    goals = F.concat(every(True, F.col("others")), F.when(F.col("group") == F.col("lead"), F.array().cast("array<struct<other:boolean,block:int>>")).otherwise(every(False, F.col("own"))))
    # The few places that a text reaches travel as one row to its fingerprint.
    reach = probes.join(keys, ["seg", "key"]).select("a", "group", F.struct("seg", "key", "exact", goals.alias("goals")).alias("place")).where(F.size("place.goals") > 0)
    reach = materialize(reach.groupBy("a", "group").agg(F.collect_list("place").alias("places")), "reach")
    placed = rest.join(keys.drop("lead"), ["seg", "key"]).withColumn("other", aside)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("b"), F.when(aside, F.col("others")).otherwise(F.col("own"))).cast("int"))
    placed = placed.select("seg", "key", "b", "least", "b_group", "other", "block")
    fp = lambda k: shuffled(nodes.select(F.col("id").alias(k), F.col("fp").alias(f"{k}_fp")))
    apart = sum((F.bit_count(F.col("a_fp")[i].bitwiseXOR(F.col("b_fp")[i])) for i in range(words)), F.lit(0))
    meet = F.expr("group <> b_group and (not exact or a < b and a <> least)") & (apart <= far)
    going = reach.join(fp("a"), "a").select("a", "a_fp", "group", F.explode("places").alias("p"))
    going = going.select("a", "a_fp", "group", "p.seg", "p.key", "p.exact", F.explode("p.goals").alias("goal")).select("*", "goal.other", "goal.block").drop("goal")
    other = going.join(shuffled(placed.join(fp("b"), "b")), ["seg", "key", "other", "block"]).where(meet).select(*pair).distinct()
    more = _alike(other, docs, shingle, similarity)
    for used in (rest, sides, reach):
        drop_materialized(used)
    found = connected_components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)).withColumnRenamed("id", "__dq_id")
    labels = nodes.join(shuffled(found), F.col("id") == F.col("__dq_id"), "left").select("same", F.coalesce("component", "id").alias("component_id"))
    return prints.join(shuffled(labels), "same").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row(s) with the least doc_id stay.
    Rows without a doc_id stay. Of rows that repeat one doc_id all stay or go alike."""
    groups = near_duplicates(docs, **options)
    gone = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(sized(gone), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
