"""Corpus preparation in stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Toxic documents go, one document of each group of near duplicates stays, documents that hold
benchmark items go, secrets are masked, and what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontaminate, packing, secrets, simhash, toxicity
from netloom.llm.common import materialise, read_table
from netloom.llm.queries import vocabulary_file


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. All labelled documents may teach.

    Null, empty and wordless texts score as a sentence without known words; repeated rows and rows
    with a null id are judged each by its text; without labels all stay; an empty table stays empty.
    """
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), modulus=1, remainder=1)
    return toxicity.without_toxic(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity 0.8 or more.

    The smallest id stays, null ids come last, and of rows that share id and text one stays. Null,
    empty and wordless texts are copies of each other. An empty table stays empty.
    """
    return simhash.without_near_duplicates(docs, words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and wordless texts hold none; repeated rows are judged alike; rows with a null id stay, as
    they can't be told by it; without items all stay; an empty table stays empty.
    """
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text where it is changed.

    Rows are independent, so repeated ones and null ids change nothing; null texts stay null; columns
    of any name keep their values.
    """
    clean = secrets.redact(docs.withColumn("__before", F.col("text")))
    n = F.when(F.col("text") != F.col("__before"), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place and its ids' checksum.

    Null and empty texts have the end id alone; repeated rows and rows with a null id are each packed;
    an empty table has no sequence.
    """
    return packing.pack(docs, vocabulary_file("word_bpe_49k.json"), end_id=2, capacity=4096, checksums=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Models, fingerprints and token ids can't be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
