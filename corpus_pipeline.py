"""A training corpus from raw documents: five stages, each one operator.

Stages take and return the columns of ``documents`` (others are dropped), whatever their
number of rows: an empty table gives an empty table. Repeated rows are judged alike. What each
does with nulls and ties is stated below; rows with a null doc_id stay in all stages but the
first, which judges them as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import decontaminate, line_dedup, packing, quality, simhash
from docquarry.llm.common import materialize
from docquarry.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null or empty text has no words and goes; null
    lang or source is a group of its own."""
    return quality.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur in three or more (the largest doc_id keeps
    them); ``n_chars`` follows the text. Null text becomes an empty one."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    return out.selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) as n_chars")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the
    document with the least doc_id. Null and empty texts are equal; null doc_ids stay."""
    return simhash.near_dedup(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to an item of ``benchmark``. Null and empty
    texts have none and stay; null doc_ids stay."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences (columns of ``packing.pack_documents``).
    Null or empty text is the end id alone; a null doc_id stays null."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Near-duplicate search and tokenization are beyond SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages. Each stage but the last is written
    to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
