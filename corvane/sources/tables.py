"""Scans: named tables of a folder, and JSON-lines readers of three strictnesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def audited_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the text of broken ones in `_corrupt_record`."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; the first broken one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows by order."""
    return df.orderBy(F.desc(order)).limit(n)
