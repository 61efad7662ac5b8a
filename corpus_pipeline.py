"""A corpus pipeline over ``documents``: quality, near duplicates, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe_chunks, compression_quality, mixing, simhash_pivots
from faultline.llm.entry import THRESHOLD
from faultline.llm.store import free_name, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold (operator 5).

    Null and empty texts are scored like any other; repeated rows and null ids are judged each; columns
    of any name stay as they are; an empty table gives an empty one."""
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "score")
    return compression_quality.score(docs, model, name=name).where(F.col(name) >= THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked SimHash fingerprints: that with the smallest id (operator 10).

    Null, empty and wordless texts form one group; null ids come last; of rows that share the smallest id
    one stays; columns of any name stay as they are; an empty table gives an empty one."""
    return simhash_pivots.keep_one(docs, repeats=False)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (operator 9).

    Null texts have no words, a null source is a source; repeated rows and null ids draw on their own;
    columns of any name stay as they are; an empty table gives an empty one."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row per taken copy (operator 2).

    Null texts count as empty; repeated rows and null ids give a row each; an empty table gives no rows."""
    return bpe_chunks.encode_decode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]
#: Compression sizes, XXH64 and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
