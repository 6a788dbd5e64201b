"""The corpus pipeline: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm.common import materialize
from panelweave.llm.exact_dedup import drop_exact_copies
from panelweave.llm.language_id import reject_unknown
from panelweave.llm.ngram_join import drop_near_copies
from panelweave.llm.packing import pack
from panelweave.llm.substring_dedup import dedup_substrings


def _small_batches(spark: SparkSession) -> None:
    """Texts go to the Python workers, of which an executor keeps several, 4 MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


# All stages but the last return the columns of `documents`.  Nulls in columns that a stage does
# not read, and names that clash with those it uses within, change nothing.  An empty table
# gives an empty result; texts are read whole whatever their length.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text, letters or a recognisable language go.

    Null and empty texts go; a null id or lang counts as any other value; rows that repeat
    stay or go together.
    """
    _small_batches(spark)
    return reject_unknown(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one stays: the longest, then that of the smallest id.

    Null and empty texts are one group, of which one row stays; a null id is the smallest; of
    rows that repeat id and text one stays.
    """
    return drop_exact_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more stays, that of the smallest id.

    Null and empty texts are linked with nothing and stay, as do rows with a null id; rows
    that repeat an id are one document.
    """
    _small_batches(spark)
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs and runs of words that repeat earlier ones are taken out of the texts.

    Every row stays; null and empty texts stay as they are, and a text whose every part
    repeats becomes empty.  Earlier is the smaller id, then the place in the text.
    """
    _small_batches(spark)
    return dedup_substrings(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in windows of 2048 tokens.

    A null text is an empty one: its end mark alone.  Rows that repeat are packed each.
    """
    _small_batches(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: The learned stage and the tokens cannot be expressed in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read by the next.

    An empty table gives no pieces.  Columns beside doc_id, text and lang are carried and not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
