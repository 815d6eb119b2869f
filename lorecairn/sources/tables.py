"""Parquet tables: schema-checked reads, appends, and whole new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import DOCUMENTS, RELATIONSHIPS, TOPICS
from ..session import spread


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.schema(DOCUMENTS).parquet(path), "key")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOPICS).parquet(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RELATIONSHIPS).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema, in its order and with its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def append(df: DataFrame, path: str, schema: T.StructType) -> None:
    conform(df, schema).write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Write a table state to a new folder; never the folder it was read from."""
    conform(df, schema).write.mode("errorifexists").parquet(path)


def write_lines(encoded: DataFrame, path: str) -> None:
    encoded.select("value").write.mode("errorifexists").text(path)


def merge_rows(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``old`` replaced or extended by the whole rows of ``new`` with the same key."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.select(*old.columns))
