"""Mixing sources to target weights with Efraimidis-Spirakis weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.llm.common import ROWS_PER_PIECE, SPACES, Hidden, staged

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0


def word_count(text: str) -> Column:
    """How many runs of non-space characters a text has; 0 for null."""
    marks = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[^{SPACES}]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) fixed by the key: 48 bits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**48)


def source_targets(
    sizes: DataFrame,
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = TOTAL_SHARE,
    most: float = MAX_EPOCHS,
) -> DataFrame:
    """One row per source: ``source_size``, ``weight`` and ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn. Together they get ``share``
    of all words. A target stops at ``most`` times the source's size; the excess goes to the others
    by weight. With the sources in the order of the level at which they fill up
    (``most * size / weight``), the full ones are a prefix of that order, so the common level follows
    from running sums: it is the highest level at which the first source that is not full fits. Sources are the entries of a mixing recipe, a table that people write: the
    windows over it have one row per source, never one per document.
    """
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source))
    one = sizes.groupBy(source).agg(F.sum("size").alias("source_size")).coalesce(1)
    cycle = F.array(*[F.lit(float(value)) for value in weights])
    ranked = one.withColumn(
        "weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", F.col(source).isNull(), F.col(source))
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.lit(float(most)) * F.coalesce(
        F.sum("source_size").over(earlier), F.lit(0)
    )
    levels = ranked.withColumn("level", left / F.sum("weight").over(later))
    fits = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    return levels.select(
        source,
        "source_size",
        "weight",
        F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(fits, F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    quality: Column,
    id_col: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = TOTAL_SHARE,
    most: float = MAX_EPOCHS,
) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``taken`` to every row of ``docs``.

    A source first gives its complete epochs: every document ``floor(target / source_size)`` times.
    The rest of its target is filled by weighted sampling without replacement: documents are sorted
    by ``-ln(u) / quality`` (u fixed by the id), their sizes summed in that order, and a document is
    taken if the middle of its words lies within the rest. ``copies`` says how often a document is
    in the mix, ``taken`` how many words that is. The same table gives the same mix on every run.

    The prefix sums need no task that holds a source: keys are cut into ranges by their exponential
    distribution function (a monotone map onto 0..1), sizes are summed per (source, range), and rows
    are ordered inside ranges only.

    Nulls and edges: a null size counts as 0 words; null sources are one source, last in order; a
    null or non-positive quality counts as 1; rows with a null id share one draw; rows that repeat an
    id and size are alike, and which of them is taken makes no difference. A source without words
    has target 0. Columns named like the added ones are replaced.
    """
    hidden = Hidden(docs, ("source_size", "target", "copies", "taken"))
    sure = F.when(quality > 0, quality).otherwise(F.lit(1.0)).cast("double")
    rows = docs.select(
        *hidden.columns(),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"),
        F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")).alias("_source"),
        (-F.log(uniform(F.col(id_col))) / sure).alias("_key"),
    )
    totals = rows.groupBy(F.col(hidden.own[source]).alias("_named"), "_source").agg(
        F.sum("_size").alias("size"), F.count("*").alias("_rows")
    )
    totals = staged(totals, "mix-totals")
    targets = source_targets(totals.withColumnRenamed("_named", source), source, weights, share, most)
    plan = targets.select(
        F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name")).alias("_source"),
        "source_size",
        "target",
        F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0)).cast("long").alias("_epochs"),
    )
    counted = totals.agg(F.max("_rows")).first()[0] or 0
    ranges = max(64, -(-counted // ROWS_PER_PIECE) * 2)
    ranged = rows.withColumn(
        "_range", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * ranges), F.lit(ranges - 1)).cast("int")
    )
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("_source", "_range")
        .agg(F.sum("_size").alias("_sum"))
        .select("_source", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
        .join(plan, "_source")
    )
    within = Window.partitionBy("_source", "_range").orderBy("_key", hidden.own[id_col], "_size").rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        ranged.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .join(shifts, ["_source", "_range"])
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    )
    middle = F.col("_shift") + F.col("_before") + F.col("_size") / F.lit(2.0)
    copies = (F.col("_epochs") + F.when((F.col("_size") > 0) & (middle <= F.col("_rest")), 1).otherwise(0)).cast("long")
    return summed.withColumn("copies", copies).select(
        *hidden.back(), "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("_size")).alias("taken")
    )
