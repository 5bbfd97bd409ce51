"""Arrays of PCM samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspark.fixed_values import SAMPLE_RATE, SILENCE_RMS
from clinspark.functions.text import as_column, let


def rms(pcm: Column | str) -> Column:
    """Root mean square of the samples; NULL for an empty array."""
    pcm = as_column(pcm)
    squares = F.aggregate(
        pcm, F.lit(0.0), lambda total, sample: total + sample.cast("double") * sample.cast("double")
    )
    return F.sqrt(squares / F.nullif(F.size(pcm), F.lit(0)))


def is_silent(pcm: Column | str, threshold: float = SILENCE_RMS) -> Column:
    """An empty array is not silent: its mean square is undefined and no comparison holds."""
    return F.coalesce(rms(pcm) < threshold, F.lit(False))


def resample(pcm: Column | str, rate: Column | str | int, target: int = SAMPLE_RATE) -> Column:
    """Linear interpolation to ``target`` Hz; the result has ``round(n / ratio)`` samples."""
    rate = F.lit(rate) if isinstance(rate, int) else as_column(rate)
    ratio = rate.cast("double") / target

    def interpolate(samples: Column) -> Column:
        count = F.floor(F.size(samples) / ratio + 0.5).cast("int")

        def at(index: Column) -> Column:
            position = index * ratio
            low = F.floor(position).cast("int")
            high = F.least(low + 1, F.size(samples) - 1)
            share = position - low
            below = F.get(samples, low).cast("double") * (1 - share)
            return (below + F.get(samples, high).cast("double") * share).cast("float")

        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(
            F.array().cast("array<float>")
        )

    pcm = as_column(pcm).cast("array<float>")
    return F.when(rate == target, pcm).otherwise(let(pcm, interpolate))
