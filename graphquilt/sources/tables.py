"""Reads the engine's parquet tables from one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODE_TABLES = ("file_node", "function_node")
EDGE_TABLES = ("edge_calls", "edge_imports")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table as it lies; parquet pushdown and pruning stay with Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
