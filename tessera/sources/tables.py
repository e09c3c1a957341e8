"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations under the names of the message model."""
    return table(spark, folder, "conversations").selectExpr("conv_id AS session_id", "turn AS message_index", "role", "text AS content")
