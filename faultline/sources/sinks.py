"""Sinks S12-S14: JSON records of fixed / failure-prone files and the CSV dataset.

A fixed file is the record ``{filepath, fic, bic}`` and a failure-prone file ``{filepath, commit,
fixing_commit}`` (plus ``repo`` here).  Decoding reads with an explicit schema, so a record of
another shape yields NULL fields instead of guessed columns.  All writes overwrite the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED_FILE_SCHEMA = "repo string, filepath string, fic string, bic string"
FAILURE_PRONE_SCHEMA = "repo string, filepath string, commit string, fixing_commit string"


def encode_fixed_files(df: DataFrame) -> DataFrame:
    """S12 encode: one JSON string per fixed file."""
    return df.select(F.to_json(F.struct("filepath", "fic", "bic")).alias("json"))


def decode_fixed_files(df: DataFrame, col: str = "json") -> DataFrame:
    return df.select(F.from_json(F.col(col), "filepath string, fic string, bic string").alias("r")).select("r.*")


def encode_failure_prone(df: DataFrame) -> DataFrame:
    """S13 encode: one JSON string per failure-prone file version."""
    return df.select(F.to_json(F.struct("filepath", "commit", "fixing_commit")).alias("json"))


def decode_failure_prone(df: DataFrame, col: str = "json") -> DataFrame:
    return df.select(F.from_json(F.col(col), "filepath string, commit string, fixing_commit string").alias("r")
                     ).select("r.*")


def write_fixed_files_json(df: DataFrame, path: str) -> None:
    df.select("repo", "filepath", "fic", "bic").write.mode("overwrite").json(path)


def read_fixed_files_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXED_FILE_SCHEMA).json(path)


def write_failure_prone_json(df: DataFrame, path: str) -> None:
    df.select("repo", "filepath", "commit", "fixing_commit").write.mode("overwrite").json(path)


def read_failure_prone_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURE_PRONE_SCHEMA).json(path)


def to_csv(df: DataFrame, path: str) -> None:
    """Header line, no index column, overwrite; one part file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
