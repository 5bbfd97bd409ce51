"""Reports as text and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.operators.ordering import join_ordered, ordinal_within

_DOUBLE_RULE = "=" * 80
_SINGLE_RULE = "-" * 80


def comparison_report(
    pairs: DataFrame, keys: list[str], order: list[str], small_keys: bool = True
) -> DataFrame:
    """(keys, report): numbered original/translated blocks of each document.

    ``pairs`` holds ``order``, ``original``, ``translated``. A report is one text, so its blocks come
    together in one cell; numbering itself does not need that.
    """
    numbered = (
        pairs.withColumn("ordinal", F.row_number().over(_window(keys, order)))
        if small_keys
        else ordinal_within(pairs, keys, order)
    )
    block = F.concat(
        F.lit("Paragraph "), F.col("ordinal").cast("string"), F.lit(":\nORIGINAL: "),
        F.col("original"), F.lit("\n\nTRANSLATED: "), F.col("translated"),
        F.lit(f"\n\n{_SINGLE_RULE}\n\n"),
    )
    head = f"Original → Translated\n{_DOUBLE_RULE}\n\n"
    report = join_ordered(numbered.withColumn("_block", block), keys, ["ordinal"], "_block", "", "report")
    return report.withColumn("report", F.concat(F.lit(head), F.col("report")))


def _window(keys: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def markdown_report(
    paragraphs: Column,
    title: Column | None = None,
    source_language: Column | None = None,
    target_language: Column | None = None,
    date: Column | None = None,
) -> Column:
    """Markdown of an array of paragraphs with the header lines that are known."""
    missing = F.lit(None).cast("string")

    def known(value: Column | None) -> Column:
        return missing if value is None else F.nullif(value, F.lit(""))

    source, target = known(source_language), known(target_language)
    languages = F.when(
        source.isNotNull() | target.isNotNull(),
        F.concat(
            F.lit("**Translation**: "), F.coalesce(source, F.lit("Unknown")), F.lit(" → "),
            F.coalesce(target, F.lit("Unknown")),
        ),
    )
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), known(title)),
        languages,
        F.concat(F.lit("**Date**: "), known(date)),
        F.lit("---"),
        F.array_join(paragraphs, "\n\n"),
    )


def dictation_sheet(log: DataFrame) -> DataFrame:
    """The five display columns of a dictation log."""
    return log.select(
        "session_id",
        F.col("nr").alias("#"),
        F.date_format("start_ts", "HH:mm:ss").alias("Start"),
        F.date_format("end_ts", "HH:mm:ss").alias("End"),
        F.col("duration_s").cast("double").alias("Duration (s)"),
        F.col("text").alias("Transcription"),
    )
