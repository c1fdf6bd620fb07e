"""Match keys and last-write-wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.parsing import strip

KEY = ("title", "start_date", "end_date")


def remote_key() -> list[Column]:
    """Key columns of a remote event: trimmed summary and ten-character dates,
    empty where there are none."""
    day = lambda m: F.substring(F.coalesce(F.nullif(F.col(f"{m}.dateTime"), F.lit("")), F.col(f"{m}.date"), F.lit("")), 1, 10)
    return [strip(F.coalesce("summary", F.lit(""))).alias("title"), day("start").alias("start_date"), day("end").alias("end_date")]


def event_key() -> list[Column]:
    return [strip(F.col("title")).alias("title"), F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date")]


def last_write_wins(df: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key; ``order`` must tell rows apart."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
