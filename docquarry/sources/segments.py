"""Tables that grow by segments: each change writes new Parquet files, then one log entry names
what counts from now on. Readers see the last entry, so a failed change leaves nothing visible."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another change was committed first."""


class Log:
    """Numbered JSON entries below ``path``; an entry is written whole and renamed into place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}")

    def version(self) -> int:
        """Number of the last entry, -1 without any."""
        if not self._fs.exists(self._path("")):
            return -1
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=-1)

    def read(self, version: int | None = None) -> dict:
        """An entry, the last if none is named; of an empty log, an empty one."""
        version = self.version() if version is None else version
        if version < 0:
            return {}
        stream = self._fs.open(self._path(f"{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, entry: dict, after: int) -> None:
        """Append ``entry`` as the one after version ``after``, which must be the last."""
        temporary, target = self._path(f".{uuid.uuid4().hex}"), self._path(f"{after + 1:012d}.json")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            raise Conflict(f"version {after + 1} exists")


class Segments:
    """Keyed rows in segments, with the keys that later segments replaced or deleted.

    A row is live unless ``gone`` holds its key with a segment number at or above its own. Changes cost
    what they touch; ``merge`` in the owner's code writes live rows anew when ``gone`` has grown."""

    def __init__(self, spark: SparkSession, path: str, key: str, **settings):
        self.spark, self.path, self.key, self.log = spark, path.rstrip("/"), key, Log(spark, path)
        if self.log.version() < 0:
            self.log.commit({"segments": [], "gone": [], "gone_rows": 0, "next": 0, "settings": settings, "extra": {}}, -1)

    def state(self) -> tuple[int, dict]:
        version = self.log.version()
        return version, self.log.read(version)

    def write(self, rows: DataFrame, kind: str, number: int, by: str | None = None) -> str:
        """Files of segment ``number``; nothing shows them before a commit."""
        name = f"{kind}/{number}-{uuid.uuid4().hex}"
        writer = rows.withColumn("segment", F.lit(number).cast("long")).write
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        return name

    def scratch(self, rows: DataFrame, batch_rows: int | None = None) -> DataFrame:
        """``rows``, written below ``path`` for one change and read back; ``drop`` deletes them. While they are
        written, Arrow batches hold ``batch_rows`` rows at most, if given."""
        path, batch = f"{self.path}/scratch/{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(batch)
        if batch_rows:
            self.spark.conf.set(batch, str(batch_rows))
        try:
            rows.write.parquet(path)
        finally:
            self.spark.conf.set(batch, before)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, scratch: DataFrame) -> None:
        """Delete what ``scratch`` wrote."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for f in scratch.inputFiles()[:1]:
            folder = path(f).getParent()
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def read(self, state: dict, kind: str, schema: str) -> DataFrame:
        """Rows of all segments of the state, the dead ones too."""
        names = [f"{self.path}/{s[kind]}" for s in state["segments"] if kind in s]
        frames = [self.spark.read.schema(schema).parquet(n) for n in names]
        out = frames[0] if frames else self.spark.createDataFrame([], schema)
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def gone(self, state: dict) -> DataFrame | None:
        if not state["gone"]:
            return None
        found = self.spark.read.parquet(*(f"{self.path}/{n}" for n in state["gone"]))
        return found.groupBy(self.key).agg(F.max("upto").alias("upto"))

    def live(self, state: dict, rows: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
        """``rows`` (with key and segment) without the dead ones. The keys of ``gone`` are broadcast
        while they are few; their number stands in the log."""
        gone = self.gone(state)
        if gone is None:
            return rows
        gone = F.broadcast(gone) if state["gone_rows"] <= most_broadcast else gone
        dead = gone.withColumnRenamed(self.key, "__key")
        return rows.join(dead, (rows[self.key] == dead["__key"]) & (rows["segment"] <= dead["upto"]), "left_anti")

    def bury(self, keys: DataFrame, upto: int) -> tuple[str, int]:
        """Write ``keys`` as gone up to a segment; returns the name and the number of them."""
        name = f"gone/{upto}-{uuid.uuid4().hex}"
        keys.select(self.key, F.lit(upto).cast("long").alias("upto")).write.parquet(f"{self.path}/{name}")
        return name, self.spark.read.parquet(f"{self.path}/{name}").count()
