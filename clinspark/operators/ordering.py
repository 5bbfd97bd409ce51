"""Numbering, joining in order and medians that hold up when one key owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.session import cut_lineage

# A range holds about so many rows at most; small tables are cut finer, for all cores to have some.
ROWS_PER_RANGE, ROWS_PER_SMALL_RANGE = 500_000, 2_000
IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: the lower 33 bits count a partition's rows


def ordinal_within(
    df: DataFrame, keys: list[str], order: list[str], out: str = "ordinal", ranges: int | None = None
) -> DataFrame:
    """``row_number`` per ``keys`` in ``order`` (which must be unique per key), without ever putting
    a whole key into one task.

    A plain window over a hot key sorts that key in one task. Here the rows are dealt to ranges of
    (keys, order) by one range exchange, whose number grows with the table, sorted and counted inside
    their range, and shifted by what earlier ranges hold of the same key. The input is stored first, so
    it is computed once, and so are the dealt rows: bounds are sampled, and counts and numbers must see
    the same ones. Counts are one row per key and range it has rows in; the optimizer broadcasts them
    if they are small.
    """
    names = [*keys, *order]
    stored = cut_lineage(df)
    if ranges is None:
        rows = stored.count()
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(min(partitions, -(-rows // ROWS_PER_SMALL_RANGE)), -(-rows // ROWS_PER_RANGE), 1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION))
    dealt = cut_lineage(
        stored.repartitionByRange(ranges, *names)
        .sortWithinPartitions(*names)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", place)
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    spans = dealt.groupBy(*keys, "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    shifts = spans.select(
        *[F.col(key).alias(f"_k_{key}") for key in keys],
        F.col("_range").alias("_r"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_range") == F.col("_r")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    number = (F.col("_place") + F.col("_shift")).cast("bigint")
    return dealt.join(shifts, same).withColumn(out, number).select(*df.columns, out)


def join_ordered(
    df: DataFrame, keys: list[str], order: list[str], value: str, separator: str, out: str
) -> DataFrame:
    """Join the parts of each key in order. The result is one cell per key, so the parts of a key
    must come from something that was one value before (a document, a row, a transcript)."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_part"))))
    joined = F.array_join(F.transform(parts, lambda part: part["_part"]), separator)
    return df.groupBy(*keys).agg(joined.alias(out))


def exact_median(
    df: DataFrame, keys: list[str], value: str, out: str = "median", weight: str | None = None
) -> DataFrame:
    """The exact median of a non-negative whole number per key (mean of the middle pair).

    Values are first counted per 1024-wide bin; only the one or two bins that hold the middle rows
    are looked at value by value. No task ever holds all values of a key, unlike ``percentile``.
    ``weight`` names a count column if there is one row per key and value already.
    """
    number = F.col(value).cast("bigint").alias("_value")
    known = df.filter(F.col(value).isNotNull())
    if weight is None:
        counts = known.groupBy(*keys, number).agg(F.count("*").alias("_n"))
    else:
        counts = known.select(*keys, number, F.col(weight).alias("_n"))
    counts = counts.withColumn("_bin", F.shiftright("_value", 10))
    running = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    bins = (
        counts.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_bin_n"))
        .withColumn("_upto", F.sum("_bin_n").over(running))
        .withColumn("_total", F.sum("_bin_n").over(everything))
        .withColumn("_before", F.col("_upto") - F.col("_bin_n"))
    )
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)

    def holds(rank: Column, before: str, upto: str) -> Column:
        return (rank >= F.col(before)) & (rank < F.col(upto))

    middle = bins.filter(holds(low, "_before", "_upto") | holds(high, "_before", "_upto"))
    within = (
        Window.partitionBy(*keys, "_bin").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    )
    detail = (
        counts.join(middle.select(*keys, "_bin", "_before", "_total"), [*keys, "_bin"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(within))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    lower = F.max(F.when(holds(low, "_start", "_end"), F.col("_value")))
    upper = F.max(F.when(holds(high, "_start", "_end"), F.col("_value")))
    return detail.groupBy(*keys).agg(((lower + upper) / 2.0).alias(out))
