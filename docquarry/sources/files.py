"""Readers and writers of document files."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import unix_lines

#: Extensions by the reader that handles them.
READERS = {"text": ("txt", "md", "markdown"), "docx": ("docx",), "json": ("json",), "jsonl": ("jsonl",)}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def reader_for(path: str) -> str:
    extension = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    for name, extensions in READERS.items():
        if extension in extensions:
            return name
    raise ValueError(f"PARSER_NOT_FOUND: {path}")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error): strict UTF-8 with unix line ends; other bytes give no text and
    TXT_INVALID_ENCODING."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = unix_lines(F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))
    return files.select("path", F.when(good, text).alias("text"), F.when(~good, "TXT_INVALID_ENCODING").alias("error"))


def docx_paragraphs(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    if body is None:
        raise ValueError("no body")
    texts = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p"))
    return [t for t in texts if t.strip()]


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, text, error): one row per paragraph, or one with an error."""

    def run(frames):
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(p, i, t, None) for i, t in enumerate(docx_paragraphs(c))]
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows.append((p, 0, None, f"DOCX_INVALID: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "section", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, section int, text string, error string")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row per file; ``records`` explodes it. Text after the value fails."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.trim(F.col("value")).alias("value"))
    # parse_json accepts trailing text; inside brackets a second value is an element or an error.
    whole = F.variant_get(F.parse_json(F.concat(F.lit("["), "value", F.lit("]"))), "$", "array<variant>")
    closed = F.col("value").rlike(r"(?s)^(\{.*\}|\[.*\]|[^\[{].*)$") & (F.size(whole) == 1)
    return files.where(F.col("value") != "").withColumn("value", F.when(closed, F.col("value")).otherwise(F.raise_error(F.lit("malformed JSON"))))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): ``line`` counts the values of a file from 1. Large files are read
    in several splits: a value's number is its place in the split plus the counts of the
    splits before, so no setting of the session is touched and no file is one task."""

    def run(frames):
        count: dict[tuple, int] = {}
        for f in frames:
            places = []
            for at in zip(f["path"], f["split"], strict=True):
                count[at] = count.get(at, 0) + 1
                places.append(count[at])
            yield f.assign(place=places)

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value").where(F.trim("value") != "")
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "split").agg(F.count("*").alias("n")).select("path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = rows.mapInPandas(run, "path string, split long, value string, place long")
    return placed.join(splits, ["path", "split"]).select("path", (F.col("before") + F.col("place")).alias("line"), "value")


def write_artifacts(good: DataFrame, bad: DataFrame, folder: str) -> DataFrame:
    """Write mapped records and issues as JSON lines below ``folder``; return the manifest: one
    row with counts and an order-free digest of each."""
    spark = good.sparkSession
    parts = []
    for name, df in (("records", good), ("mapping-errors", bad)):
        df.write.mode("overwrite").json(f"{folder}/{name}")
        back = spark.read.text(f"{folder}/{name}")
        parts.append(back.agg(F.count("*").alias(f"n_{name.replace('-', '_')}"), F.sha2(F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0)).cast("string"), 256).alias(f"digest_{name.replace('-', '_')}")))
    manifest = parts[0].crossJoin(parts[1])  # one row each
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def missing_embeddings(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Different texts that the cache (key) lacks, with their key."""
    keyed = texts.select(F.sha2(F.concat(F.lit(model), F.lit("\0"), "text"), 256).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")
