"""Mappings as JSON documents: a directory of parts, each a complete mapping of some entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.operators.mapping import TAG_NUMBER

SCHEMA = (
    "version int, entities map<string, struct<type:string, replacement:string>>, "
    "counters map<string, bigint>"
)


def read_mapping_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(mapping, counters)`` of the JSON documents below ``path``.

    Missing parts are empty. Counters that a document does not give are the highest numbers in use.
    """
    documents = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    entries = documents.select(F.explode(F.map_entries("entities")).alias("entry"))
    mapping = entries.select(
        F.col("entry.key").alias("entity"),
        F.col("entry.value.type").alias("type"),
        F.col("entry.value.replacement").alias("replacement"),
    )
    number = F.nullif(F.regexp_extract("replacement", TAG_NUMBER, 1), F.lit("")).cast("bigint")
    used = mapping.select("type", number.alias("n")).filter("n IS NOT NULL")
    used = used.groupBy("type").agg(F.max("n").alias("used"))
    given = (
        documents.select(F.explode(F.map_entries("counters")).alias("entry"))
        .select(F.col("entry.key").alias("type"), F.col("entry.value").alias("n"))
        .groupBy("type")
        .agg(F.max("n").alias("given"))
    )
    # The stated counters of a mapping replace the observed ones as a whole, or not at all.
    stated = given.agg(F.count("*").alias("_types"))
    both = used.join(given, "type", "full_outer").withColumn("_one", F.lit(1))
    both = both.join(F.broadcast(stated.withColumn("_one", F.lit(1))), "_one")
    number = F.when(F.col("_types") == 0, F.col("used")).otherwise(F.col("given"))
    counters = both.select("type", number.alias("last_number")).filter("last_number IS NOT NULL")
    return mapping, counters
