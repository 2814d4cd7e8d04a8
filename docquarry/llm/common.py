"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator here:

* a column that an operator produces replaces an input column of the same name; all other
  input columns pass through; helper columns are named ``__dq_*``, and input columns with such
  names are set aside (``apart``);
* words are maximal runs of characters other than space and U+0009 to U+000D;
* lower-casing changes A-Z only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class and as plain characters.
SPACE_CLASS = r"[ \t\n\x0B\f\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 1000

#: Rows of a table that is broadcast, at most.
MOST_BROADCAST = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and driver and executors are one process (``local[...]``, as in
    tests) a temporary folder of this machine is used, and noted in the session so that
    later calls find it again. On a cluster an unset folder is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.docquarry.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.docquarry.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: this cuts lineage, and
    the files survive the loss of any executor. While it is written, Arrow batches hold
    ``BATCH_ROWS`` rows at most, so those of long texts stay small; then the session has its
    own setting again."""
    spark = df.sparkSession
    path, batch = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(batch, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that must not be broadcast, however small Spark takes it to be:
    its estimate comes from compressed files and does not see the rows that an explode adds."""
    return df.hint("merge")


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join: broadcast if it has at most ``MOST_BROADCAST`` rows, else
    ``shuffled``. They are counted where the caller does not know that they are at most ``rows``."""
    rows = df.limit(MOST_BROADCAST + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= MOST_BROADCAST else shuffled(df)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table of ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def lower_ascii(c: Column) -> Column:
    """``c`` with A-Z in lower case and everything else unchanged. Texts without any upper
    case letter skip the replacement."""
    return F.when(c.rlike("[A-Z]"), F.translate(c, _UPPER, _UPPER.lower())).otherwise(c)


def words_of(c: Column) -> Column:
    """Array of the words of a text (null: no words)."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_CLASS + "+"), "")


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns set; of input columns that share a name (also by case), none
    stays. All expressions see the columns as they were."""
    mine = {k.lower() for k in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in mine]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with input columns whose names begin like those of helper columns renamed, and
    how to rename them back."""
    taken = {c: f"__in_{i}_{c}" for i, c in enumerate(df.columns) if c.lower().startswith("__dq_")}
    return df.withColumnsRenamed(taken), {v: k for k, v in taken.items()}
