"""Summaries: one prompt for short documents, facts per part and a merge prompt for long ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.fixed_values import MERGE_FACT_LIMIT, SINGLE_PASS_LIMIT
from clinspark.functions.chunking import chunk_fixed
from clinspark.functions.language import detect_language_nl_en
from clinspark.functions.prompts import (
    FACT_LIMITS,
    SUMMARY_LIMITS,
    condense_prompt,
    fact_prompt,
    merge_prompt,
    summary_prompt,
)
from clinspark.functions.replies import strip_think
from clinspark.functions.text import is_blank, route_by_length
from clinspark.operators.inference import ModelFn, reviewed
from clinspark.session import cut_lineage


def _limits(limits: tuple[int, float]) -> list[Column]:
    return [F.lit(limits[0]).alias("max_tokens"), F.lit(limits[1]).alias("temperature")]


def routed(docs: DataFrame, text: str = "text", single_limit: int = SINGLE_PASS_LIMIT) -> DataFrame:
    """Non-blank documents with ``language`` and ``route``."""
    return (
        docs.filter(~is_blank(text))
        .withColumn("language", detect_language_nl_en(text))
        .withColumn("route", route_by_length(text, single_limit))
    )


def single_requests(docs: DataFrame, key: str, text: str, template: str | None) -> DataFrame:
    prompt = summary_prompt(text, "language", template)
    return docs.filter("route = 'single'").select(
        key,
        "route",
        prompt["system"].alias("system"),
        prompt["user"].alias("user"),
        F.lit(False).alias("truncated"),
        *_limits(SUMMARY_LIMITS),
        F.lit(None).cast("string").alias("part_error"),
    )


def fact_requests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One request per part of each long document."""
    parts = docs.filter("route = 'multi'").withColumn("_parts", chunk_fixed(text))
    exploded = parts.select(
        key,
        "language",
        F.size("_parts").alias("parts"),
        F.posexplode("_parts").alias("chunk_idx", "part"),
    )
    prompt = fact_prompt("part", "chunk_idx", "parts", "language")
    return exploded.select(
        key,
        "language",
        "chunk_idx",
        prompt["system"].alias("system"),
        prompt["user"].alias("user"),
        *_limits(FACT_LIMITS),
    )


def fact_groups(facts: DataFrame, key: str, limit: int) -> DataFrame:
    """Facts of a document joined in part order into groups of about ``limit`` characters:
    (key, language, chunk_idx = number of the group, groups, facts, errors).

    A group holds two facts at least, so that every round of merging halves their number, even if a
    single fact is longer than the limit. Blank facts hold nothing and are left out of the text.
    """
    order = Window.partitionBy(key).orderBy("chunk_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = facts.withColumn("_size", F.when(is_blank("fact"), 0).otherwise(F.length("fact") + 2))
    by_size = F.floor(F.coalesce(F.sum("_size").over(before), F.lit(0)) / limit)
    by_place = F.floor((F.row_number().over(order) - 1) / 2)
    placed = filled.withColumn("_group", F.least(by_size, by_place))
    held = F.filter(
        F.sort_array(F.collect_list(F.struct("chunk_idx", "fact"))),
        lambda part: ~is_blank(part["fact"]),
    )
    joined = placed.groupBy(key, "_group").agg(
        F.min("language").alias("language"),
        F.array_join(F.transform(held, lambda part: part["fact"]), "\n\n").alias("facts"),
        F.array_join(F.array_sort(F.array_compact(F.collect_list("part_error"))), "; ").alias("part_error"),
    )
    every = Window.partitionBy(key)
    return joined.select(
        key,
        "language",
        (F.row_number().over(every.orderBy("_group")) - 1).alias("chunk_idx"),
        F.count("*").over(every).alias("groups"),
        "facts",
        F.when(F.col("part_error") != "", F.col("part_error")).alias("part_error"),
    )


def merge_requests(groups: DataFrame, key: str, template: str | None) -> DataFrame:
    """The report request of each document whose facts are one group."""
    prompt = merge_prompt("facts", "language", template)
    return groups.filter("groups = 1").select(
        key,
        F.lit("multi").alias("route"),
        prompt["system"].alias("system"),
        prompt["user"].alias("user"),
        prompt["truncated"].alias("truncated"),
        *_limits(SUMMARY_LIMITS),
        "part_error",
    )


def condense_requests(groups: DataFrame, key: str) -> DataFrame:
    """A request per group of the documents that have several."""
    prompt = condense_prompt("facts", "language")
    return groups.filter("groups > 1").select(
        key,
        "language",
        "chunk_idx",
        "part_error",
        prompt["system"].alias("system"),
        prompt["user"].alias("user"),
        *_limits(FACT_LIMITS),
    )


def _facts(answered: DataFrame, key: str, earlier: Column) -> DataFrame:
    """Replies as facts; a part without a reply is named in ``part_error``."""
    failed = F.when(
        F.col("error").isNotNull(),
        F.concat(F.lit("part "), (F.col("chunk_idx") + 1).cast("string"), F.lit(": "), F.col("error")),
    )
    errors = F.concat_ws("; ", earlier, failed)
    return answered.select(
        key,
        "language",
        "chunk_idx",
        F.coalesce(strip_think("reply"), F.lit("")).alias("fact"),
        F.when(errors != "", errors).alias("part_error"),
    )


def summarize(
    docs: DataFrame,
    model_fn: ModelFn,
    key: str = "doc_id",
    text: str = "text",
    template: str | None = "freeform",
    single_limit: int = SINGLE_PASS_LIMIT,
    merge_limit: int = MERGE_FACT_LIMIT,
) -> DataFrame:
    """(key, route, truncated, summary, error).

    A document of up to ``single_limit`` characters takes one request. A longer one is asked for facts
    part by part; facts are merged in rounds, group by group of about ``merge_limit`` characters, until
    one group is left for the report, so no fact is dropped. ``error`` names the request that failed or
    the parts that are missing from the summary. Each pass of the model is stored before the next, so no
    request is sent twice, and parts are spread evenly before they meet the model.
    """
    none = F.lit(None).cast("string")
    ready = routed(docs, text, single_limit)
    asked = fact_requests(ready, key, text).repartition(key, "chunk_idx")
    facts = cut_lineage(_facts(reviewed(asked, model_fn), key, none))
    requests = single_requests(ready, key, text, template)
    while True:
        groups = cut_lineage(fact_groups(facts, key, merge_limit))
        requests = requests.unionByName(merge_requests(groups, key, template))
        again = condense_requests(groups, key)
        if again.isEmpty():
            break
        answered = reviewed(again.repartition(key, "chunk_idx"), model_fn)
        facts = cut_lineage(_facts(answered, key, F.col("part_error")))
    replies = reviewed(requests, model_fn)
    errors = F.concat_ws("; ", "error", "part_error")
    return replies.select(
        key, "route", "truncated", strip_think("reply").alias("summary"), F.when(errors != "", errors).alias("error")
    )
