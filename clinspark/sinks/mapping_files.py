"""Mappings written as JSON documents or as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.operators.mapping import TAG_NUMBER, mapping_table
from clinspark.operators.ordering import ordinal_within


def mapping_documents(
    mapping: DataFrame, keys: list[str], entities_per_document: int = 10_000
) -> DataFrame:
    """(keys, part, json): JSON documents of each scope with at most ``entities_per_document``
    entities and the counters of those entities, so that a large scope is many documents instead of
    one that no task could hold. Reading all parts gives the whole mapping back."""
    numbered = ordinal_within(mapping, keys, ["seq"]).withColumn(
        "part", F.floor((F.col("ordinal") - 1) / entities_per_document).cast("int")
    )
    number = F.nullif(F.regexp_extract("replacement", TAG_NUMBER, 1), F.lit("")).cast("bigint")
    counters = (
        numbered.withColumn("_n", number)
        .filter("_n IS NOT NULL")
        .groupBy(*keys, "part", "type")
        .agg(F.max("_n").alias("_n"))
        .groupBy(*keys, "part")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "_n")))).alias("counters"))
    )
    entry = F.struct(F.col("seq"), F.col("entity"), F.struct("type", "replacement").alias("info"))
    parts = numbered.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    entities = F.map_from_entries(
        F.transform("_entries", lambda item: F.struct(item["entity"], item["info"]))
    )
    empty = F.create_map().cast("map<string,bigint>")
    document = F.struct(
        F.lit(1).alias("version"),
        entities.alias("entities"),
        F.coalesce("counters", empty).alias("counters"),
    )
    return parts.join(counters, [*keys, "part"], "left").select(
        *keys, "part", F.to_json(document).alias("json")
    )


def write_mapping(mapping: DataFrame, keys: list[str], path: str, fmt: str = "json") -> None:
    """Write a mapping as JSON documents (one per line of text files) or as a CSV table."""
    if fmt == "json":
        mapping_documents(mapping, keys).select("json").write.mode("overwrite").text(path)
    elif fmt == "table":
        mapping_table(mapping).write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
