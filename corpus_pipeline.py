"""A corpus pipeline: language ID, line dedup, near duplicates, mixing and packing, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard_join, language_id, line_dedup, mixing, packing
from tidemark.llm.common import shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told get it as ``lang``; null texts and texts without a letter go.

    Rows with null or repeated ids are read like any other; ties go to the language that sorts first; without any label to learn
    from, all texts with a letter stay as they are. An empty table stays empty; further columns stay whatever their names.
    """
    return language_id.identified_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that stand in 5 documents or more stay in one of them only: that of the largest id.

    All rows stay, null texts become empty. Rows of one id count as one document and all keep its lines; null ids count as one
    document below all others. An empty table stays empty; further columns stay whatever their names.
    """
    return line_dedup.deduped_documents(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a word 5-gram Jaccard similarity of 0.8 or more, the smallest doc_id stays.

    Ties of ids go to the smaller text hash, null ids come last; repeated rows are one. Rows without words all stay. An
    empty table stays empty; further columns stay whatever their names.
    """
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to weights 3, 1, 2 over 1.5 times all words; repeated epochs repeat rows.

    A null source is a source of its own, the last. Null, empty and blank texts carry nothing and leave; rows of one id follow each
    other in order of size and text hash. An empty table stays empty; further columns stay whatever their names.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's pieces, packed into sequences of at most 2048 tokens.

    Every row is a document of its own, repeated ones too; null ids stay null, equal lengths are ordered by id. An empty table
    gives no pieces; other columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a trained network, which SQL cannot express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each but the last returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
