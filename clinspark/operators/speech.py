"""Transcripts: entry numbers, durations, accepted texts, time-stamped lines, audio windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark import fixed_values as fixed
from clinspark.functions.signals import is_invented_transcript
from clinspark.functions.text import as_column, format_seconds, is_blank, trim_spaces
from clinspark.operators.ordering import join_ordered, ordinal_within


def accepted_text(text: Column | str, silent: Column, error: Column) -> Column:
    """The log text of an entry: the trimmed transcript or one of two fixed remarks."""
    text = trim_spaces(F.coalesce(as_column(text), F.lit("")))
    return (
        F.when(silent, fixed.NO_SPEECH)
        .when(error.isNotNull(), fixed.TRANSCRIPTION_FAILED)
        .when((text == "") | is_invented_transcript(text), fixed.NO_SPEECH)
        .otherwise(text)
    )


def number_entries(log: DataFrame, session: str = "session_id", order: str = "start_ts") -> DataFrame:
    """Running entry number per session; a session may be of any length."""
    return ordinal_within(log, [session], [order], "nr")


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two timestamps with one decimal."""
    micros = F.unix_micros(as_column(end).cast("timestamp")) - F.unix_micros(
        as_column(start).cast("timestamp")
    )
    return F.round(micros / 1_000_000, 1).cast("decimal(10,1)")


def timestamped_line(start: Column | str, text: Column | str) -> Column:
    start = F.coalesce(as_column(start), F.lit(0.0))
    return F.concat(
        F.lit("["), format_seconds(start), F.lit("] "),
        trim_spaces(F.coalesce(as_column(text), F.lit(""))),
    )


def timestamped_text(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``[MM:SS] text`` lines of each recording."""
    lines = segments.withColumn("_line", timestamped_line("start_s", "text"))
    return join_ordered(lines, keys, order, "_line", "\n", "transcript")


def live_transcript(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Accepted live texts joined by spaces."""
    kept = segments.filter(~is_blank("text") & ~is_invented_transcript("text"))
    return join_ordered(kept.withColumn("text", trim_spaces("text")), keys, order, "text", " ", "transcript")


def audio_windows(
    recordings: DataFrame,
    samples: str = "samples",
    rate: int = fixed.SAMPLE_RATE,
    window_s: int = fixed.LONG_WINDOW_SECONDS,
    stride_s: int = fixed.LONG_STRIDE_SECONDS,
) -> DataFrame:
    """Windows of ``window_s`` seconds that overlap by ``stride_s`` on each side, as sample ranges.

    Every recording has at least one window; the last one ends with the recording.
    """
    size, step = window_s * rate, (window_s - 2 * stride_s) * rate
    total = F.col(samples).cast("bigint")
    last = F.greatest(F.ceil((total - size) / step), F.lit(0))
    return (
        recordings.withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("from_sample", F.col("window_no") * step)
        .withColumn("to_sample", F.least(F.col("from_sample") + size, total))
    )
