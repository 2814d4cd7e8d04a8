"""A stored inverted index: postings by hash of the term, delta segments, runs with states.

Adding, replacing, activating and deleting touch the rows they concern only; no change and no
search reads the corpus again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.segments import Segments
from .postings import BATCH_ROWS, BLOCKS, counted, gathered, opened
from .retrieval import SMALL, search_index

POSTINGS = BLOCKS + ", segment long, bucket int"
ROWS = "chunk_id {0}, collection_id string, ingest_run_id string, size int, content_hash string, segment long"


class LexicalIndex:
    """Weighted BM25 over tokens of the columns in ``weights``, stored below ``path``.

    ``weights`` and ``buckets`` (by hash of the term; a search opens the buckets of its terms) hold from
    the first change on. Frequencies and sizes are those of all rows that the index holds,
    whatever their state. The log keeps one line for each run, none for a chunk."""

    def __init__(self, spark: SparkSession, path: str, weights: dict[str, float] | None = None, buckets: int = 64, id_type: str = "string"):
        self.spark = spark
        self.store = Segments(spark, path, "chunk_id", weights=weights, buckets=buckets, id_type=id_type)
        settings = self.store.state()[1]["settings"]
        self.weights, self.buckets, kind = settings["weights"], settings["buckets"], settings["id_type"]
        self.id_type = kind
        self.postings_schema, self.rows_schema = POSTINGS.format(kind), ROWS.format(kind)

    def _bucket(self, term) -> F.Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _sorted(self, blocks: DataFrame) -> DataFrame:
        """By term and id: a frequent term is split over tasks, and files hold terms in order."""
        blocks = blocks.withColumns({"bucket": self._bucket("term"), "least": F.col("postings")[0]["chunk_id"]})
        return blocks.repartitionByRange("bucket", "term", "least").sortWithinPartitions("bucket", "term", "least").drop("least")

    def _rows(self, state: dict) -> DataFrame:
        return self.store.live(state, self.store.read(state, "rows", self.rows_schema))

    def stage(self, chunks: DataFrame) -> None:
        """Add ``chunks`` (chunk_id, collection_id, ingest_run_id, an array<string> of tokens for each
        weighted column); a chunk_id that the index holds is replaced. A new run is staged, another
        keeps its state. chunk_ids are distinct; rows with a null one are left out."""
        version, state = self.store.state()
        number, extra = state["next"], state["extra"]
        chunks = chunks.where("chunk_id is not null")
        size = sum((F.size(c) for c in self.weights), F.lit(0))
        digest = F.sha2(F.concat_ws("\x1e", *(F.array_join(c, "\x1f") for c in self.weights)), 256)
        # One pass over the tokens gives rows and blocks; both are read from what it wrote.
        chunks = chunks.select("chunk_id", "collection_id", "ingest_run_id", size.cast("int").alias("size"), digest.alias("content_hash"), F.concat(*self.weights).alias("tokens"), F.array(*(F.size(c) for c in self.weights)).alias("parts"))
        parts = self.store.scratch(counted(chunks, list(self.weights.values()), self.id_type), BATCH_ROWS)
        rows = parts.where("term is null").drop("term", "postings")
        index = self._sorted(parts.where("term is not null").select("term", "collection_id", "ingest_run_id", "postings"))
        segment = {"rows": self.store.write(rows, "rows", number), "postings": self.store.write(index, "postings", number, "bucket"), "number": number}
        self.store.drop(parts)
        added = self.spark.read.schema(self.rows_schema).parquet(f"{self.store.path}/{segment['rows']}")
        gone, gone_rows, n, total = [], 0, 0, 0
        if state["segments"]:
            old = self._rows(state).join(added.select("chunk_id"), "chunk_id", "left_semi")
            name, gone_rows = self.store.bury(old.select("chunk_id"), number - 1)
            gone = [name]
            n, total = old.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        here = added.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        runs = extra.get("runs", []) + [[r[0], r[1], "staged"] for r in added.select("collection_id", "ingest_run_id").distinct().collect() if [r[0], r[1]] not in [x[:2] for x in extra.get("runs", [])]]
        extra = extra | {"runs": runs, "n_rows": extra.get("n_rows", 0) + here[0] - n, "size": extra.get("size", 0) + here[1] - total}
        self.store.log.commit(state | {"segments": [*state["segments"], segment], "gone": [*state["gone"], *gone], "gone_rows": state["gone_rows"] + gone_rows, "next": number + 1, "extra": extra}, version)

    def activate(self, collection: str, run: str) -> None:
        """The run becomes active, the collection's other active ones dormant. No file is touched."""
        version, state = self.store.state()
        runs = [[c, r, "active" if (c, r) == (collection, run) else "dormant" if c == collection and s == "active" else s] for c, r, s in state["extra"].get("runs", [])]
        self.store.log.commit(state | {"extra": state["extra"] | {"runs": runs}}, version)

    def _drop(self, keys: DataFrame, forget: tuple[str, str] | None = None) -> None:
        version, state = self.store.state()
        keys = self._rows(state).join(keys, "chunk_id", "left_semi")
        n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        name, rows = self.store.bury(keys.select("chunk_id"), state["next"] - 1)
        extra = state["extra"] | {"n_rows": state["extra"].get("n_rows", 0) - n, "size": state["extra"].get("size", 0) - total}
        if forget:
            extra["runs"] = [x for x in extra.get("runs", []) if tuple(x[:2]) != forget]
        self.store.log.commit(state | {"gone": [*state["gone"], name], "gone_rows": state["gone_rows"] + rows, "extra": extra}, version)

    def delete_run(self, collection: str, run: str) -> None:
        """All rows of a run, whatever its state; again does no more."""
        _, state = self.store.state()
        own = self._rows(state).where((F.col("collection_id") == collection) & (F.col("ingest_run_id") == run))
        self._drop(own.select("chunk_id"), (collection, run))

    def delete_chunks(self, keys: DataFrame) -> None:
        """Rows whose chunk_id is among ``keys`` (chunk_id)."""
        self._drop(keys.select("chunk_id").distinct())

    def merge(self) -> None:
        """Live rows and postings in one segment; nothing is gone any more. Searches give the same."""
        version, state = self.store.state()
        number = state["next"]
        rows = self._rows(state).drop("segment")
        live = self.store.live(state, opened(self.store.read(state, "postings", self.postings_schema)))
        parts = self.store.scratch(gathered(live, self.id_type))
        postings = self._sorted(parts)
        segment = {"rows": self.store.write(rows, "rows", number), "postings": self.store.write(postings, "postings", number, "bucket"), "number": number}
        self.store.drop(parts)
        self.store.log.commit(state | {"segments": [segment], "gone": [], "gone_rows": 0, "next": number + 1}, version)

    def runs(self) -> list[tuple[str, str, str]]:
        """(collection, run, state) of every run."""
        return [tuple(x) for x in self.store.state()[1]["extra"].get("runs", [])]

    def run_rows(self, collection: str, run: str) -> DataFrame:
        """(chunk_id, digest) of a run's rows, for ``retrieval.verify_run``."""
        own = self._rows(self.store.state()[1]).where((F.col("collection_id") == collection) & (F.col("ingest_run_id") == run))
        return own.select("chunk_id", F.col("content_hash").alias("digest"))

    def search(self, terms: DataFrame, limit: int, collection: str | None = None, state: str | None = "active", runs: Sequence[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
        """``retrieval.search_index`` over this index: hits of all queries of ``terms`` (query_id,
        group_id, term) from one read. Few terms (which is counted) open only their buckets, and
        reach the scan as a filter on the sorted term column."""
        _, log = self.store.state()
        postings = self.store.read(log, "postings", self.postings_schema)
        wanted = [r.term for r in terms.select("term").distinct().limit(SMALL + 1).collect()]
        if len(wanted) <= SMALL:
            buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "term string").select(self._bucket("term")).distinct().collect()]
            postings = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
        live = self.store.live(log, opened(postings))
        # As many rows as runs, from the log.
        states = self.spark.createDataFrame([tuple(x) for x in log["extra"].get("runs", [])], "collection_id string, ingest_run_id string, state string")
        index = live.join(F.broadcast(states), ["collection_id", "ingest_run_id"], "left").withColumnRenamed("chunk_id", "id")
        n, size = log["extra"].get("n_rows", 0), log["extra"].get("size", 0)
        stats = self.spark.createDataFrame([(n, size / n if n else 0.0)], "n_rows long, avg_size double")
        return search_index(index, stats, terms, limit, collection, state, runs, ids)
