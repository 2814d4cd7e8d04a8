"""Upload sink: a Python data source whose files become visible by a commit.

``df.write.format("uploads").option("path", root).mode("append").save()`` for rows (name, content).
Files lie below ``root/blobs`` by the SHA-256 of their bytes, so equal contents share one file and a
task that runs twice writes the same. Each task lists its files in a part of a manifest; the
commit names the parts that count. The driver sees one name and two counts for each task."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes that are hashed and written at a time; bytes that a file may have.
BLOCK, MOST = 1024 * 1024, 100 * 1024 * 1024
MANIFEST = "name string, stored string, bytes long, sha256 string, error string"


@dataclass
class Part(WriterCommitMessage):
    name: str
    files: int
    refused: int


def _publish(target: Path, blocks: Iterator[bytes], synced: bool = True) -> None:
    """Write ``blocks`` beside ``target`` and rename it into place; ``synced`` waits for the disk, as
    manifests and commits do, once a task or job."""
    target.parent.mkdir(parents=True, exist_ok=True)
    temporary = target.with_name(f".{uuid.uuid4().hex}")
    try:
        with temporary.open("wb") as f:
            for block in blocks:
                f.write(block)
            if synced:
                f.flush()
                os.fsync(f.fileno())
        os.replace(temporary, target)
    finally:
        temporary.unlink(missing_ok=True)


def _blocks(content: bytes) -> Iterator[bytes]:
    view = memoryview(content)
    return (view[i : i + BLOCK] for i in range(0, len(content), BLOCK))


class _Writer(DataSourceWriter):
    def __init__(self, root: str, most: int):
        self.root, self.most, self.job = Path(root), most, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part:
        part, files, refused = self.root / "manifests" / self.job / f"{uuid.uuid4().hex}.json", 0, 0

        def lines():
            nonlocal files, refused
            for r in rows:
                content = r["content"]
                entry = {"name": r["name"], "stored": None, "bytes": None if content is None else len(content), "sha256": None, "error": None}
                if content is None or len(content) > self.most:
                    entry["error"] = "FILE_MISSING" if content is None else "FILE_TOO_LARGE"
                    refused += 1
                else:
                    digest = hashlib.sha256()
                    for block in _blocks(content):
                        digest.update(block)
                    key = digest.hexdigest()
                    extension = os.path.splitext(r["name"] or "")[1]
                    stored = f"{key[:2]}/{key[2:4]}/{key}{extension if re.fullmatch(r'[.][A-Za-z0-9]{1,16}', extension) else '.txt'}"
                    target = self.root / "blobs" / stored
                    if not (target.exists() and target.stat().st_size == len(content)):
                        _publish(target, _blocks(content), synced=False)
                    entry |= {"stored": stored, "sha256": key}
                    files += 1
                yield (json.dumps(entry, ensure_ascii=False) + "\n").encode()

        _publish(part, lines())
        return Part(part.name, files, refused)

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        entry = {"job": self.job, "parts": sorted(m.name for m in done), "files": sum(m.files for m in done), "refused": sum(m.refused for m in done)}
        _publish(self.root / "commits" / f"{self.job}.json", iter([json.dumps(entry).encode()]))

    def abort(self, messages: list) -> None:
        """Parts of the failed job are taken away; contents stay until ``unreferenced`` names them."""
        for m in messages:
            if m is not None:
                (self.root / "manifests" / self.job / m.name).unlink(missing_ok=True)


class UploadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "uploads"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("uploads are appended")
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("uploads need the columns name and content")
        return _Writer(self.options["path"].removeprefix("file://"), int(self.options.get("most_bytes", MOST)))


def write_uploads(files: DataFrame, root: str, most_bytes: int = MOST) -> None:
    """Store ``files`` (name string, content binary) below ``root``, a folder that all executors
    share, in one commit. Files over ``most_bytes`` and null contents are listed with an error."""
    spark = files.sparkSession
    spark.dataSource.register(UploadSource)
    files.select("name", "content").write.format("uploads").option("path", root).option("most_bytes", str(most_bytes)).mode("append").save()


def committed_uploads(spark: SparkSession, root: str) -> DataFrame:
    """(job, name, stored, bytes, sha256, error) of the files in committed parts. An empty or
    missing folder gives no rows."""
    base = Path(root.removeprefix("file://"))
    if not (base / "commits").exists():
        return spark.createDataFrame([], f"job string, {MANIFEST}")
    commits = spark.read.schema("job string, parts array<string>").json(f"file://{base}/commits").select("job", F.explode("parts").alias("part"))
    at = F.regexp_extract(F.col("_metadata.file_path"), r"manifests/([0-9a-f]+)/([0-9a-f]+\.json)$", 1), F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]+\.json)$", 1)
    entries = spark.read.schema(MANIFEST).json(f"file://{base}/manifests/*").select("*", at[0].alias("job"), at[1].alias("part"))
    return entries.join(commits, ["job", "part"]).select("job", "name", "stored", "bytes", "sha256", "error")


def stored_contents(spark: SparkSession, root: str) -> DataFrame:
    """(stored, content) of every committed content, once."""
    base = root.removeprefix("file://")
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{base}/blobs")
    named = blobs.select(F.regexp_extract("path", r"blobs/(.*)$", 1).alias("stored"), "content")
    known = committed_uploads(spark, root).where("error is null")
    # The reader of binary files leaves empty ones out.
    empty = known.where("bytes = 0").select("stored", F.lit(b"").alias("content")).dropDuplicates(["stored"])
    return named.join(known.where("bytes > 0").select("stored"), "stored", "left_semi").unionByName(empty)


def unreferenced(spark: SparkSession, root: str) -> DataFrame:
    """(stored, bytes) of contents that no commit names: what a failed job left, to be deleted
    when no job runs."""
    base = root.removeprefix("file://")
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{base}/blobs").select(F.regexp_extract("path", r"blobs/(.*)$", 1).alias("stored"), F.col("length").alias("bytes"))
    return blobs.join(committed_uploads(spark, root).select("stored"), "stored", "left_anti")
