"""Worksheet grids: text columns with the sheet's name and row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_grid(spark: SparkSession, path: str) -> DataFrame:
    """One worksheet, first row as header, all cells as text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True)


def parquet_grid(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[F.col(c).cast("string") for c in df.columns])
