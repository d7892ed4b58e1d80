"""Snapshots as documents: one nested JSON text for each narrative, its reader, and the gates a read document must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narravane.functions.dialect import operator

#: Fixed value: the version of the document's shape.
VERSION = 5
#: The fields of a document: where each stands, and its type.
FIELDS = {
    "posts": ("summary", "bigint"), "authors": ("summary", "bigint"), "first_day": ("summary", "string"), "last_day": ("summary", "string"), "mean_score": ("sentiment", "double"), "trend": ("sentiment", "string"),
    "slope": ("sentiment", "double"), "edges": ("graph", "bigint"), "connected": ("graph", "bigint"), "isolated": ("graph", "bigint"), "known_bots": ("graph", "bigint"),
}


def documents(snapshots: DataFrame, alerts: DataFrame) -> DataFrame:
    """(narrative, document): summary, sentiment, graph and the alerts in their order, as JSON; fields without a value are left out."""
    listed = alerts.groupBy("narrative").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "message", "severity"))).alias("alerts"))
    parts: dict[str, list[str]] = {}
    for name, (part, _) in FIELDS.items():
        parts.setdefault(part, []).append(name)
    whole = F.struct(F.lit(VERSION).alias("version"), F.col("narrative"), *[F.struct(*names).alias(part) for part, names in parts.items()], F.coalesce("alerts", F.expr("CAST(array() AS array<struct<place:bigint,kind:string,message:string,severity:int>>)")).alias("alerts"))
    return snapshots.join(listed, "narrative", "left").select("narrative", F.to_json(whole).alias("document"))


def save(docs: DataFrame, path: str) -> None:
    """Writes documents as lines of text."""
    docs.select("document").write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(doc) of saved documents as VARIANT; a line that is no JSON gives null."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("doc"))


def flat(loaded: DataFrame) -> DataFrame:
    """The rows that the documents were made of, with their version and number of alerts; null where a document lacks a field."""
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    fields = [get(f"$.{part}.{name}", kind).alias(name) for name, (part, kind) in FIELDS.items()]
    return loaded.where("doc IS NOT NULL").select(get("$.version", "bigint").alias("version"), get("$.narrative", "string").alias("narrative"), *fields, F.size(get("$.alerts", "array<variant>")).cast("long").alias("alerts"))


def alerts_of(loaded: DataFrame) -> DataFrame:
    """(narrative, place, kind, message, severity) of the alerts in the documents."""
    each = loaded.select(F.try_variant_get("doc", "$.narrative", "string").alias("narrative"), F.explode(F.try_variant_get("doc", "$.alerts", "array<variant>")).alias("a"))
    return each.select("narrative", *[F.try_variant_get("a", f"$.{n}", k).alias(n) for n, k in (("place", "bigint"), ("kind", "string"), ("message", "string"), ("severity", "int"))])


@operator("flats")
def document_gates(d):
    """Gates of read documents, with the number of documents that fail each."""
    gates = {
        "version": f"version = {VERSION}", "named": "narrative <> ''", "has posts": "posts > 0", "authors within posts": "authors <= posts", "days in order": "first_day <= last_day", "score in range": "mean_score BETWEEN 0 AND 1",
        "trend known": "trend IN ('escalating', 'declining', 'stable', 'insufficient_data')", "graph adds up": "connected + isolated = authors", "bots within authors": "known_bots <= authors", "has alerts": "alerts > 0",
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS gate, CAST(count_if(NOT coalesce({rule}, false)) AS BIGINT) AS failed FROM flats" for name, rule in gates.items())
