"""Corpus pipeline: language ID, line dedup, near-duplicate groups, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next stage reads back from
Parquet. All but the last return the columns of ``documents``; the last adds the mix's figures. Other columns
are left out, whatever their names; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import Scratch
from reviewlake.llm.decontamination import clean_documents
from reviewlake.llm.jaccard_join import one_of_each_group
from reviewlake.llm.language_id import accepted_documents
from reviewlake.llm.line_dedup import drop_repeated_lines
from reviewlake.llm.mixing import mixed_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject.

    Null texts and texts without a letter go; null ids stay; repeated rows are judged alike; with nothing to learn from, all go.
    """
    return accepted_documents(docs.select(COLUMNS))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are gone; n_chars follows the text, and texts left empty go.

    Null ids come after all others; rows with equal ids are one holder and keep their lines alike; null texts go.
    """
    kept = drop_repeated_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return kept.where(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) one document: the smallest doc_id, nulls last, of equal ids
    the smallest hash of the text, of repeated rows one. Texts without words have no group and stay.
    """
    return one_of_each_group(docs.select(COLUMNS))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none; rows with equal ids go together; an empty benchmark takes nothing."""
    return clean_documents(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: its words, its source's words and target, words taken.

    Documents of which nothing is taken are out of the mix. A null source is one of its own; repeated rows each count; null ids are rows
    like any other.
    """
    return mixed_documents(docs.select(COLUMNS)).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
]

#: SQL expresses neither the classifier nor the hashed draw; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
