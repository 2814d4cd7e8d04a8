"""Library scan: the items below several roots, with their optional files, merged per item."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import values as V

#: Names below a root that are no items, and the files of an item.
NO_ITEMS = ("latest", "tasks.json", "knowledge_index.ndjson")
MANIFEST, SUMMARY, REPORT, TRANSCRIPT, FRAMES = "manifest.json", "summary.json", "report.html", "transcript.txt", "frames"
_SCHEMA = "root string, name string, manifest string, summary string, transcript string, state string, has_report boolean, frames array<string>, modified timestamp"


class _Names(InputPartition):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], states: str, size: int):
        self.roots, self.states, self.size = roots, states, size

    def partitions(self) -> list[InputPartition]:
        """One listing per root; only names, cut into groups, reach the driver. The first root
        that has a name owns it."""
        seen: set[str] = set()
        parts = []
        for root in self.roots:
            if not os.path.isdir(root):
                continue
            with os.scandir(root) as entries:
                names = sorted(e.name for e in entries if not e.is_symlink() and e.is_dir() and not e.name.startswith(".") and e.name not in NO_ITEMS and e.name not in seen)
            seen.update(names)
            parts += [_Names(root, names[i : i + self.size]) for i in range(0, len(names), self.size)]
        return parts or [_Names("", [])]

    def read(self, partition: InputPartition):
        from datetime import UTC, datetime

        def text(path: Path) -> str | None:
            try:
                return path.read_text(encoding="utf-8", errors="replace") if path.is_file() else None
            except OSError:
                return None

        for name in partition.names:
            at = Path(partition.root, name)
            frames = sorted(str(f) for f in (at / FRAMES).glob("*.jpg")) if (at / FRAMES).is_dir() else []
            report = (at / REPORT).exists()
            if (at / MANIFEST).exists() or (at / SUMMARY).exists() or report or frames:
                state = text(Path(self.states, f"{name}.json")) if self.states else None
                modified = datetime.fromtimestamp(at.stat().st_mtime, UTC)
                yield partition.root, name, text(at / MANIFEST), text(at / SUMMARY), text(at / TRANSCRIPT), state, report, frames, modified


class LibrarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["roots"].split("\n"), self.options.get("states", ""), int(self.options.get("size", "256")))


def scan(spark: SparkSession, roots: list[str], states: str = "", size: int = 256) -> DataFrame:
    """One row per item folder of ``roots`` (the first root that has a name owns it; links, dot
    names and folders without any product are left out), its files' texts unparsed. ``states`` is
    a folder of ``<name>.json``. ``size`` items make a task."""
    spark.dataSource.register(LibrarySource)
    return spark.read.format("library").option("roots", "\n".join(roots)).option("states", states).option("size", str(size)).load()


def _text(v: str, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def items(scanned: DataFrame) -> DataFrame:
    """Scanned items with what their files say, newest first by ``created_at`` when sorted:
    (root, name, title, source, source_kind, created_at, duration_seconds, summary, keypoints,
    transcript, has_report, frames). A value comes from the manifest or the summary, then the
    state, which counts only where the manifest names no source. Files that do not parse say nothing."""
    s = scanned.withColumns({n: F.try_parse_json(n) for n in ("manifest", "summary", "state")})
    s = s.withColumn("state", F.when(_text("manifest", "$.source").isNull(), F.col("state")))
    said = F.coalesce(_text("summary", "$.summary"), _text("state", "$.summary.summary"), F.lit(""))
    points = lambda v, p: F.nullif(F.try_variant_get(v, p, "array<string>"), F.array().cast("array<string>"))
    listed = lambda v: F.nullif(F.transform(F.try_variant_get(v, "$.report.keyframes", "array<variant>"), lambda k: F.try_variant_get(k, "$.path", "string")), F.array().cast("array<string>"))
    source = F.coalesce(_text("manifest", "$.source"), _text("state", "$.source"), F.lit(""))
    return s.select(
        "root", "name",
        F.coalesce(_text("state", "$.summary.title_override"), _text("state", "$.report.title"), _text("summary", "$.title_override"), _text("manifest", "$.report.title"), F.col("name")).alias("title"),
        source.alias("source"), V.source_class(source).alias("source_kind"),
        F.coalesce(_text("state", "$.created_at"), _text("manifest", "$.created_at"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_at"),
        F.coalesce(F.try_variant_get("state", "$.report.duration_seconds", "double"), F.try_variant_get("manifest", "$.report.duration_seconds", "double")).alias("duration_seconds"),
        said.alias("summary"), F.coalesce(points("summary", "$.keypoints"), points("state", "$.summary.keypoints"), F.array().cast("array<string>")).alias("keypoints"),
        F.coalesce(_text("manifest", "$.transcript"), F.nullif("transcript", F.lit("")), _text("state", "$.transcript"), F.lit("")).alias("transcript"),
        "has_report", F.coalesce(listed("state"), listed("manifest"), F.col("frames")).alias("frames"),
    )
