"""Writers: idempotent inserts, partition rewrites, logs, snapshot documents and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``target`` with the rows whose key it lacks; of rows with one key, one stays."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(key), key, "left_anti").select(target.columns))


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Rewrites only the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_log(rows: DataFrame, path: str, at: str) -> None:
    """Appends JSON lines with the time of ingest."""
    rows.withColumn("at", F.lit(at)).write.mode("append").json(path)


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Additive schema change: columns that are missing or null get their default."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def write_documents(rows: DataFrame, path: str) -> None:
    """A JSON document a row, as text files."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def graph_tables(posts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and relationship tables of the property graph: (kind, id) and (kind, source, target, weight)."""
    nodes = posts.select(F.lit("Author").alias("kind"), F.col("author_id").alias("id")).unionByName(posts.select(F.lit("Narrative").alias("kind"), F.col("narrative").alias("id")))
    links = posts.select(F.lit("PARTICIPATES_IN").alias("kind"), F.col("author_id").alias("source"), F.col("narrative").alias("target"))
    links = links.unionByName(edges.select(F.lit("AMPLIFIED").alias("kind"), "source", "target"))
    return nodes.distinct(), links.groupBy("kind", "source", "target").agg(F.count(F.lit(1)).alias("weight"))


def compacted(spark, path: str, files: int, out: str) -> None:
    """Rewrites a table into fewer files."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(out)
