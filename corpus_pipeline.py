"""A corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes the documents that its predecessor kept and, but for the last, returns some of them with
the columns they came with, whatever else these are named. A stage's decisions are written as a table of the ids
that go; removing them is an anti join that Spark broadcasts only where that table is small. Rows that share a
doc_id stay or go together. Rows of null doc_id are judged by a stand-in made of their text, above all true ids, so
of copies a row with an id is kept; those of equal text stay or go together. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm.common import table, written
from filelake.llm.decontam import decontaminate
from filelake.llm.langid import foreign, inferred
from filelake.llm.mixing import mix
from filelake.llm.near_dup import near_duplicates
from filelake.llm.wavelet import token_documents


def _id() -> Column:
    """doc_id, or for null a number from 2**62 on by a hash of the text."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62))


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", _id())


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    gone = written(gone.select(F.col("doc_id").alias("gone_id")).distinct(), name)
    return docs.join(gone, _id() == gone["gone_id"], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null and empty texts too) or in none that was learnt; mixtures of
    languages stay."""
    found = written(inferred(_named(docs)), "languages")
    return _without(docs, found.where(foreign(found)), "rejected")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near copies. Texts without words are no copies."""
    return _without(docs, near_duplicates(_named(docs)).where("not kept"), "copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item. Null and empty texts stay."""
    return _without(docs, decontaminate(_named(docs), table(spark, sf_dir, "benchmark")).where("contaminated"), "contaminated")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by the probabilities that meet the target weights. Documents without words stay."""
    return _without(docs, mix(_named(docs)).where("not kept"), "unsampled")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the sample; one row per document, read back from them. Null doc_ids come first, as null;
    a null or empty text has the end id alone."""
    return token_documents(docs, lean=True)  # workers still hold memory of the stages before


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL cannot express the language model or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
