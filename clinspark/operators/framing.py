"""Recordings as frames: cutting, resampling with a carry of one sample, windows for models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.fixed_values import LONG_STRIDE_SECONDS, LONG_WINDOW_SECONDS, SAMPLE_RATE
from clinspark.operators.guarding import Batches, ModelFn

FRAME_SAMPLES = 65_536
COLUMNS = ("recording_id", "seq", "start", "total", "sample_rate", "pcm")


def framed(recordings: DataFrame, frame_samples: int = FRAME_SAMPLES) -> DataFrame:
    """Frames (``COLUMNS``) of recordings that are held as one array each (``recording_id``,
    ``sample_rate``, ``pcm``). An empty recording is one empty frame; a null one has none."""
    sized = recordings.filter("pcm IS NOT NULL").select(
        "recording_id", "sample_rate", F.col("pcm").cast("array<float>").alias("_all"), F.size("pcm").cast("bigint").alias("total")
    )
    last = F.greatest(F.ceil(F.col("total") / F.lit(frame_samples)) - 1, F.lit(0))
    cut = sized.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("start", F.col("seq") * frame_samples)
    return cut.withColumn("pcm", F.slice("_all", (F.col("start") + 1).cast("int"), F.lit(frame_samples))).select(*COLUMNS)


def resampled_frame(
    pcm: np.ndarray, following: float | None, start: int, total: int, ratio: float
) -> tuple[int, np.ndarray]:
    """(first index, samples) of the resampled recording that fall into this frame.

    Sample ``i`` of the result lies at ``i * ratio``, between two samples of which the lower one decides
    about the frame; the upper one may be the next frame's first (``following``).
    """
    count = int(np.floor(total / ratio + 0.5))
    first = max(int(start / ratio) - 2, 0)
    index = np.arange(first, min(int((start + len(pcm)) / ratio) + 3, count), dtype=np.int64)
    position = index * ratio
    low = np.floor(position).astype(np.int64)
    inside = (low >= start) & (low < start + len(pcm))
    index, position, low = index[inside], position[inside], low[inside]
    if not len(index):
        return 0, np.zeros(0, dtype=np.float32)
    held = np.append(pcm, pcm[-1] if following is None else following).astype(np.float64)
    high = np.minimum(low + 1, total - 1)
    share = position - low
    values = held[low - start] * (1 - share) + held[high - start] * share
    return int(index[0]), values.astype(np.float32)


def resample_frames(frames: DataFrame, target: int = SAMPLE_RATE) -> DataFrame:
    """Frames at ``target`` Hz by linear interpolation, ``round(total / ratio)`` samples in all.

    Each frame is worked on by itself; all it needs of its neighbour is one sample. ``next_sample`` is
    taken as read; frames without that column get it by an equi-join of the frames' first samples.
    """
    if "next_sample" not in frames.columns:
        heads = frames.select("recording_id", (F.col("seq") - 1).alias("seq"), F.get("pcm", F.lit(0)).alias("next_sample"))
        frames = frames.join(heads.filter("seq >= 0"), ["recording_id", "seq"], "left")
    kind = frames.schema["recording_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"start": [], "total": [], "pcm": []}
            names = ("pcm", "next_sample", "start", "total", "sample_rate")
            for pcm, following, start, total, rate in zip(*(batch.column(name) for name in names)):
                samples, total = pcm.values.to_numpy(zero_copy_only=False), total.as_py()
                first, whole = start.as_py(), total
                if rate.as_py() != target:
                    ratio = rate.as_py() / target
                    first, samples = resampled_frame(samples, following.as_py(), start.as_py(), total, ratio)
                    whole = int(np.floor(total / ratio + 0.5))
                for name, value in (("start", first), ("total", whole), ("pcm", samples)):
                    rows[name].append(value)
            arrays = [
                batch.column("recording_id"), batch.column("seq"), pa.array(rows["start"], pa.int64()), pa.array(rows["total"], pa.int64()),
                pa.array([target] * batch.num_rows, pa.int32()), pa.array(rows["pcm"], pa.list_(pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, list(COLUMNS))

    whole = frames.select("recording_id", "seq", "start", "total", F.col("sample_rate").cast("int"), F.col("pcm").cast("array<float>"), F.col("next_sample").cast("float"))
    done = whole.mapInArrow(run, f"recording_id {kind}, seq bigint, start bigint, total bigint, sample_rate int, pcm array<float>")
    return done.filter((F.size("pcm") > 0) | (F.col("total") == 0))


def window_pieces(
    frames: DataFrame,
    rate: int = SAMPLE_RATE,
    window_s: int = LONG_WINDOW_SECONDS,
    stride_s: int = LONG_STRIDE_SECONDS,
) -> DataFrame:
    """(recording_id, window_no, at, pcm, offset_s, is_last): what each frame gives to each window.

    Windows of ``window_s`` seconds overlap by ``stride_s`` on both sides; every recording has at least
    one, and the last one ends with the recording. A frame names its windows itself, so frames and
    windows meet on their numbers and no recording is gathered.
    """
    size, step = window_s * rate, (window_s - 2 * stride_s) * rate
    start, length = F.col("start"), F.size("pcm").cast("bigint")
    last = F.greatest(F.ceil((F.col("total") - size) / F.lit(step)), F.lit(0).cast("bigint"))
    first = F.greatest(F.floor((start - size) / F.lit(step)) + 1, F.lit(0).cast("bigint"))
    end = F.least(F.greatest(F.floor((start + length - 1) / F.lit(step)), F.lit(0).cast("bigint")), last)
    numbers = F.when(first <= end, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))
    named = frames.withColumn("_last", last).withColumn("window_no", F.explode(numbers))
    opens = F.col("window_no") * step
    low = F.greatest(start, opens)
    high = F.least(start + length, opens + size)
    return named.select(
        "recording_id",
        "window_no",
        low.alias("at"),
        F.slice("pcm", (low - start + 1).cast("int"), F.greatest(high - low, F.lit(0).cast("bigint")).cast("int")).alias("pcm"),
        (opens / rate).alias("offset_s"),
        (F.col("window_no") == F.col("_last")).alias("is_last"),
    )


def whole_windows(model_fn: ModelFn) -> ModelFn:
    """``model_fn`` over pieces that come in the order of (recording, window, place): each window is put
    together in the worker and given as one row without ``at``."""

    def run(frames: Batches) -> Batches:
        def windows() -> Batches:
            held: list = []
            for frame in frames:
                for row in frame.itertuples(index=False):
                    if held and (row.recording_id, row.window_no) != (held[0].recording_id, held[0].window_no):
                        yield joined(held)
                        held = []
                    held.append(row)
            if held:
                yield joined(held)

        def joined(rows: list) -> pd.DataFrame:
            pcm = np.concatenate([np.asarray(row.pcm, dtype=np.float32) for row in rows])
            one = {"recording_id": rows[0].recording_id, "window_no": rows[0].window_no, "pcm": [pcm], "offset_s": rows[0].offset_s, "is_last": rows[0].is_last}
            return pd.DataFrame(one)

        yield from model_fn(windows())

    return run
