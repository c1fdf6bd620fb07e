"""SQL text helpers over ``spark.sql`` with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    return spark.sql(query, args=args or {})


def rows_as_text(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))


def rows_as_json(df: DataFrame) -> DataFrame:
    """Nulls are kept as nulls."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def json_lines(lines: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Rows of the schema from lines of JSON; a line that is none gives nulls."""
    return lines.select(F.from_json(F.col(column), schema).alias("row")).select("row.*")


def row_exists(df: DataFrame) -> DataFrame:
    """One row: whether there is any."""
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_rows(spark: SparkSession, name: str) -> DataFrame:
    """One row: whether there is the table, and its rows (null: no table)."""
    if table_exists(spark, name):
        return spark.table(name).agg(F.lit(True).alias("found"), F.count("*").alias("n"))
    return spark.range(1).select(F.lit(False).alias("found"), F.lit(None).cast("long").alias("n"))


def execute(spark: SparkSession, statement: str, args: dict | None = None) -> None:
    """Runs a statement; errors are raised, not turned into a flag."""
    spark.sql(statement, args=args or {}).collect()
