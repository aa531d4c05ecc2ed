"""Readers of delivered files: CSV with quoted line breaks, JSON lines, and last-wins imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import clean_optional
from docweave.operators.enrich import cleaned, last_wins


def read_csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """A CSV file with header; quoted fields may hold line breaks and be of any length; doubled quotes stand for one."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=infer, maxCharsPerColumn=-1, encoding="UTF-8")


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """id, content_html of rows with an id."""
    c = read_csv(spark, path).withColumn("id", clean_optional(F.col("id")))
    return c.where(F.col("id").isNotNull())


def numbered_rows(df: DataFrame) -> DataFrame:
    """Rows with row_no in file order: increasing within a file, not contiguous, and made without a shuffle."""
    return df.withColumn("row_no", F.monotonically_increasing_id())


def import_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned metadata, the last row of each id; blank ids are dropped."""
    return last_wins(cleaned(numbered_rows(read_csv(spark, path))), "id", "row_no").drop("row_no")


def import_relationships(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned relationships in file order, duplicates kept; rows without doc_id are dropped."""
    return cleaned(numbered_rows(read_csv(spark, path))).where(F.col("doc_id").isNotNull())


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema else r).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    """One object a line, UTF-8, nulls written."""
    df.write.mode(mode).options(ignoreNullFields="false", **options).json(path)
