"""Embeddings from any function that turns texts into vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: Texts in one call, tries of a call, and the first wait between tries in seconds.
CALL, TRIES, WAIT = 64, 3, 1.0


class Retryable(Exception):
    """What an embedder raises if the same call may succeed later (busy, server error)."""


def embed(texts: DataFrame, embedder: Embedder, column: str = "text", dimension: int | None = None) -> DataFrame:
    """``texts`` with ``embedding`` array<double>. Each task calls ``embedder`` with up to ``CALL``
    texts at a time, in order; a retryable failure is tried again with doubled waits, any other
    fails the task. Vectors must have ``dimension`` numbers, where given, and as many as texts."""
    schema = StructType([*texts.schema, StructField("embedding", ArrayType(DoubleType()))])

    def vectors(part: list[str]) -> list[list[float]]:
        for i in range(TRIES):
            try:
                found = [list(map(float, v)) for v in embedder(part)]
                break
            except Retryable:
                if i == TRIES - 1:
                    raise
                time.sleep(WAIT * 2**i)
        if len(found) != len(part):
            raise ValueError(f"{len(part)} texts, but {len(found)} vectors")
        if dimension and any(len(v) != dimension for v in found):
            raise ValueError(f"a vector does not have {dimension} numbers")
        return found

    def run(frames):
        for f in frames:
            values = f[column].fillna("").tolist()
            yield f.assign(embedding=pd.Series([v for i in range(0, len(values), CALL) for v in vectors(values[i : i + CALL])], index=f.index, dtype=object))

    return texts.mapInPandas(run, schema)


def probe_dimension(embedder: Embedder) -> int:
    """Numbers of a vector, by embedding one text."""
    return len(embedder(["dimension probe"])[0])


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """``vectors``, failing on one whose ``embedding`` has another number of numbers."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dimension} numbers, found "), F.size("embedding").cast("string")))
    return vectors.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(wrong))
