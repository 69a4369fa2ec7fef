"""From raw documents to packed training sequences, in four stages.

A stage's documents are a written table, which is read in the same pieces each time: so numbers of its rows hold, and a
stage decides on rows, not on ids. Nulls in any column, empty and very long texts, repeated rows and ids, and
further columns pass as the operators' docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dieline.llm import lines, near, packing, quality
from dieline.llm.scratch import Scratch, bounded


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, in a column of a name that they don't have."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _kept(docs: DataFrame, decided: DataFrame, row: str, scratch: Scratch) -> DataFrame:
    """The rows of numbered documents but those that were rejected (row, kept)."""
    gone = scratch.save(decided.filter("NOT kept").select(F.col("row").alias(row)), "gone")
    return docs.join(bounded(gone), row, "left_anti").drop(row)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject low-quality documents; each row by its own text, rows without an id as well. Ties stay."""
    scratch = Scratch(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, row = _numbered(docs)
    return _kept(docs, quality.resample(docs, labels, scratch, row_col=row), row, scratch).select([c for c in docs.columns if c != row])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that earlier lines match, those of a row with the same id and text among them. A document of which no text is left goes; n_chars follows the text."""
    found = lines.without_repeated_lines(docs, Scratch(spark))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates over five-word shingles: the first row, whatever the ids. Documents without words stay."""
    scratch = Scratch(spark)
    docs, row = _numbered(docs)
    found = near.near_dedup(docs, scratch, id_col=row).select(F.col("doc_id").alias("row"), "kept")
    return _kept(docs, found, row, scratch).select([c for c in docs.columns if c != row])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 2048."""
    return packing.pack(docs, Scratch(spark))


STAGES = [("quality", classify), ("lines", dedup_lines), ("near", dedup_near), ("packing", pack)]

#: SQL expresses neither the classifier nor the tokens; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's result is written and read again, and the one before it goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    last = ()
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*last)
        last = (name,)
    return STAGES[-1][1](spark, docs, sf_dir)
