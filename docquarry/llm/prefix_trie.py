"""Prefix trie of conversations: distributed MSD radix partitioning, finished by multikey quicksort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, words_of

#: A bucket of more different sequences, or turns, is dealt out by its next turn.
LOCAL_ROWS, LOCAL_TURNS = 1_000, 200_000
#: Turns more frequent than this have their ids broadcast, buckets too, while they are few.
FREQUENT, MOST_BROADCAST = 10_000, 100_000
#: Conversation ids of a chunk lie within 2 to this power.
CHUNK_BITS = 12

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, seq binary, up binary"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def encode_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words) for each conversation of ``turns`` (conv_id, turn, role, text):
    its turns in order as dictionary ids, and the words of each one's text.

    Equal (role, text) have equal ids; null role or text counts as empty. Order is by ``turn``,
    null first; ties by role, then by the SHA-256 of the turn; repeated rows are turns of their own. Rows
    with a null conv_id are left out. Empty table: no rows. Other columns are not looked at.

    Only digests move, never texts. The dictionary is counted with map-side combining and
    written; ids of frequent turns, of which there can be few (rows / ``FREQUENT``), come by a
    broadcast of counted size, so rows of a hot turn stay where they are. One conversation's
    ids must fit a row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), _digest(F.concat(F.char_length(role), F.lit(":"), role, text)).alias("key"), F.size(words_of(text)).cast("long").alias("words")
    )
    rows = materialize(rows, "turns")
    entries = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("words").alias("words")).withColumn("id", F.monotonically_increasing_id())
    entries = materialize(entries, "turn-ids")
    frequent = entries.where(F.col("n") > FREQUENT).select("key", F.col("id").alias("known"))
    rows = rows.join(_small(frequent), "key", "left")
    rare = rows.where("known is null").join(entries.select("key", "id"), "key").drop("known")
    rows = rows.where("known is not null").withColumnRenamed("known", "id").unionByName(rare)
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "key", "id", "words")))
    return rows.groupBy("conv_id").agg(said.alias("said")).select("conv_id", F.col("said.id").alias("ids"), F.col("said.words").alias("words"))


def quick_nodes(rows: list[tuple], depth: int) -> list[list]:
    """Nodes [conv, depth, index of parent, n, children, leaves, saved, end] of different
    sequences ``rows`` (conv, n, ids, words, seq) that share their first ``depth`` ids, from
    the node of that prefix down. Multikey quicksort: groups split three ways at the id that
    stands at their depth; the equal part, one id deeper, is a child node. The recursion is
    kept on a list, so a long conversation needs no deep stack."""
    nodes: list[list] = []
    todo = [(True, rows, depth, -1)]
    while todo:
        opens, rows, d, at = todo.pop()
        if opens:
            end, total, least = None, 0, None
            for r in rows:
                total += r[1]
                least = r[0] if least is None or r[0] < least else least
                if len(r[2]) == d:
                    end = r[4]
            nodes.append([least, d, at, total, 0, 0, (total - 1) * int(rows[0][3][d - 1]) if d else 0, end])
            if at >= 0:
                nodes[at][4] += 1
            at = len(nodes) - 1
            rows = [r for r in rows if len(r[2]) > d] if end is not None else rows
        if not rows:
            continue
        pivot = rows[len(rows) // 2][2][d]
        equal = [r for r in rows if r[2][d] == pivot]
        if len(equal) < len(rows):
            todo += [(False, part, d, at) for part in ([r for r in rows if r[2][d] < pivot], [r for r in rows if r[2][d] > pivot]) if part]
        todo.append((True, equal, d + 1, at))
    for node in reversed(nodes):  # children stand behind their parents
        node[5] += not node[4]
        if node[2] >= 0:
            nodes[node[2]][5] += node[5]
            nodes[node[2]][6] += node[6]
    return nodes


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of the buckets of a partition, which come sorted by bucket."""
    names = [x.split(" ")[0] for x in NODE.split(", ")]
    found, held, about = [], [], None

    def close() -> None:
        nodes = quick_nodes(held, about[1])
        for conv, d, at, *rest in nodes:
            found.append((conv, d, about[3] if at < 0 else nodes[at][0], *rest, about[2] if at < 0 else None))

    def out() -> pd.DataFrame:
        made = pd.DataFrame(found, columns=names)
        made["parent_conv_id"] = made["parent_conv_id"].astype("Int64")
        return made

    for pdf in batches:
        for bucket, depth, up, up_conv, conv, n, ids, words, seq in zip(*(pdf[c] for c in ("bucket", "depth", "up", "up_conv", "conv", "n", "ids", "words", "seq")), strict=True):
            if about and about[0] != bucket:
                close()
                held = []
                if len(found) >= 20_000:
                    yield out()
                    found = []
            about = (bucket, int(depth), up, None if pd.isna(up_conv) else int(up_conv))
            held.append((int(conv), int(n), ids.tolist(), words, seq))
    if held:
        close()
    yield out()


def _end_digests(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256): SHA-256 of the conv_ids of each sequence, ascending, joined by commas. Ids
    are joined in chunks first; a digest then runs over the chunks in order, one at a time, so
    however many copies there are, none gathers in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for pdf in batches:
            done = []
            for seq, ids in zip(pdf["seq"], pdf["ids"], strict=True):
                if seq == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = seq, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["seq", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["seq", "ends_sha256"])

    chunks = members.groupBy("seq", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("seq", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("seq").sortWithinPartitions("seq", "chunk").mapInPandas(run, "seq binary, ends_sha256 string")


def _shared(low: Column, high: Column) -> Column:
    """How many leading elements two arrays share."""
    both = F.least(F.size(low), F.size(high))
    at = F.array_position(F.zip_with(F.slice(low, 1, both), F.slice(high, 1, both), lambda a, b: a != b), F.lit(True))
    return F.when(at == 0, both).otherwise(at - 1).cast("int")


def prefix_trie(sequences: DataFrame, local_rows: int = LOCAL_ROWS, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The trie of ``sequences`` (conv_id, ids array<long>, words array<long>), as of
    ``encode_turns``: one row for each distinct prefix, the empty one (root) included.

    conv_id: smallest member (a conversation that starts with the prefix); depth; parent_conv_id:
    the parent's conv_id (root: null); n_convs: members; n_children; n_leaves: childless nodes
    in its subtree; saved_tokens: over its subtree, (n_convs - 1) times the words of the last
    turn; ends_sha256: SHA-256 of the ids of conversations that end there. Subtrees include
    their top. (conv_id, depth) is unique.

    Method: equal sequences collapse first. A bucket holds all sequences with one prefix; one
    that is too large jumps to the longest prefix that all of it shares and is dealt out by
    the next id, until every bucket is local (a single sequence always is). Local buckets are
    finished by multikey quicksort, many to a task; sums of the large ones follow bottom up.
    Each round writes what is left, so a lost executor costs its tasks only. Rounds follow the branchings of
    large buckets, not the depth.

    conv_id must be unique and not null; a turnless conversation has empty arrays and belongs
    to the root. No rows: no nodes, not even the root.
    """
    members = materialize(sequences.withColumn("seq", _digest(F.array_join(F.col("ids").cast("array<string>"), ","))), "members")
    state = members.groupBy("seq").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("ids").alias("ids"), F.first("words").alias("words"))
    none = F.lit(None)
    state = state.select("*", F.unhex(F.lit("")).alias("bucket"), F.lit(0).alias("depth"), none.cast("binary").alias("up"), none.cast("long").alias("up_conv"))
    state = materialize(state, "sequences")
    large, local, written = [], [], [state]
    while True:
        sizes = state.groupBy("bucket").agg(
            F.count("*").alias("seqs"), F.sum(F.size("ids")).alias("turns"), F.min("depth").alias("depth"), F.min("up").alias("up"), F.min("up_conv").alias("up_conv"), F.min("conv").alias("conv"),
            F.sum("n").alias("n"), F.min(F.struct("ids", "seq", "words")).alias("low"), F.max("ids").alias("high"),
        ).where((F.col("seqs") > 1) & ((F.col("seqs") > local_rows) | (F.col("turns") > local_turns)))
        sizes = sizes.withColumn("to", _shared(F.col("low.ids"), F.col("high")))
        end = F.when(F.size("low.ids") == F.col("to"), F.col("low.seq"))
        found = materialize(sizes.select("bucket", "depth", "up", "up_conv", "conv", "n", "to", F.slice("low.words", F.lit(1), F.col("to")).alias("words"), end.alias("seq")), "large-buckets")
        if found.isEmpty():
            local.append(state)
            break
        large.append(found)
        here = state.join(_small(found.select("bucket", "to", F.col("conv").alias("large_conv"))), "bucket", "left")
        local.append(here.where("to is null").select(*state.columns))
        then = _digest(F.concat(F.hex("bucket"), F.lit(":"), F.col("ids")[F.col("to")].cast("string")))
        here = here.where(F.size("ids") > F.col("to"))
        state = materialize(here.select("seq", "conv", "n", "ids", "words", then.alias("bucket"), (F.col("to") + 1).alias("depth"), F.col("bucket").alias("up"), F.col("large_conv").alias("up_conv")), "sequences")
        written.append(state)

    every = local[0]
    for more in local[1:]:
        every = every.unionByName(more)
    nodes = materialize(every.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_finish, NODE), "nodes")
    tops = nodes.where("up is not null").select("up", "n_leaves", "saved_tokens")
    above = tops.limit(0)
    for found in reversed(large):
        below = tops.unionByName(above).groupBy(F.col("up").alias("bucket")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        chain = found.join(below, "bucket").withColumn("at", F.explode(F.sequence("depth", "to")))
        own = F.when(F.col("at") == 0, F.lit(0)).otherwise((F.col("n") - 1) * F.get("words", F.col("at") - 1))
        first, last = F.col("at") == F.col("depth"), F.col("at") == F.col("to")
        chain = chain.select(
            F.col("conv").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.when(first, F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.sum(own).over(Window.partitionBy("bucket").orderBy(F.desc("at"))) + F.col("below")).alias("saved_tokens"),
            F.when(last, F.col("seq")).alias("seq"), F.when(first, F.col("up")).alias("up"),
        )
        chain = materialize(chain, "large-nodes")
        nodes, above = nodes.unionByName(chain), chain.where("up is not null").select("up", "n_leaves", "saved_tokens")
    for table in written:
        drop_materialized(table)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = nodes.where("seq is not null").join(_end_digests(members), "seq", "left").select(*columns, "ends_sha256")
    return nodes.where("seq is null").select(*columns, F.sha2(F.lit(""), 256).alias("ends_sha256")).unionByName(ended)
