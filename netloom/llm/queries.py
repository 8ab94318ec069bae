"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontaminate, extraction, language, media, packing, secrets, sharding, simhash, toxicity, urls
from netloom.llm.common import read_table



def vocabulary_file(name: str) -> str:
    """Where a public vocabulary file is: in the folder that ``NETLOOM_TOKENIZERS`` names, else in
    the installed package of them. Every executor needs it in the same place."""
    known = os.environ.get("NETLOOM_TOKENIZERS")
    if known:
        return f"{known}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)



def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: fixed patterns and sliding-window entropy."""
    return secrets.digests(read_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item: every item against every document."""
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the rules, else by boosted trees."""
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents packed into sequences of 4096 ids by minimum bin slack."""
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), end_id=2, capacity=4096, checksums=True)


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(read_table(spark, sf_dir, "pages"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as media members of archives, read back by byte ranges."""
    return media.digests(read_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash over 3-word shingles, links at 3 or fewer differing bits."""
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), radius=3, words=3)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    return sharding.shard(read_table(spark, sf_dir, "documents"), shards=40)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by noisy-or over its sentences."""
    return toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by unigrams summed over all segmentations."""
    return language.judge(read_table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_decontaminate": op2_decontaminate,
    "op3_urls": op3_urls,
    "op4_packing": op4_packing,
    "op5_extraction": op5_extraction,
    "op6_media": op6_media,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secrets": secrets.ORACLE_SQL,
}
