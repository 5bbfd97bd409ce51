"""Dictation logs and transcripts of long recordings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.fixed_values import LONG_STRIDE_SECONDS, LONG_WINDOW_SECONDS, SAMPLE_RATE
from clinspark.functions.audio import is_silent, resample
from clinspark.operators.framing import framed, resample_frames, whole_windows, window_pieces
from clinspark.operators.guarding import ModelFn, guarded
from clinspark.operators.inference import failures, infer, reviewed
from clinspark.operators.speech import accepted_text, duration_seconds, number_entries, timestamped_text
from clinspark.session import cut_lineage


def log_table(entries: DataFrame) -> DataFrame:
    """The dictation log of entries with ``session_id``, ``start_ts``, ``end_ts``, ``text``,
    ``silent`` and ``error``."""
    judged = entries.withColumn(
        "text", accepted_text("text", F.col("silent"), F.col("error"))
    ).withColumn("duration_s", duration_seconds("start_ts", "end_ts"))
    return number_entries(judged).select(
        "session_id", "nr", "start_ts", "end_ts", "duration_s", "text"
    )


def transcript_log(entries: DataFrame, model_fn: ModelFn) -> DataFrame:
    """The dictation log of recorded entries (``sample_rate``, ``pcm``). Silent entries never reach
    the model."""
    ready = entries.withColumn("pcm", resample("pcm", "sample_rate")).withColumn(
        "silent", is_silent("pcm")
    )
    spoken = reviewed(ready.filter("NOT silent").drop("silent"), model_fn)
    columns = ["session_id", "start_ts", "end_ts"]
    heard = spoken.select(
        *columns, F.col("reply").alias("text"), F.lit(False).alias("silent"), "error"
    )
    nothing = F.lit(None).cast("string")
    quiet = ready.filter("silent").select(
        *columns, nothing.alias("text"), "silent", nothing.alias("error")
    )
    return log_table(heard.unionByName(quiet))


@dataclass(frozen=True)
class Transcribed:
    """``texts`` (recording_id, transcript) and ``failures`` (recording_id, window_no, error)."""

    texts: DataFrame
    failures: DataFrame


HEARD = "recording_id string, window_no long, offset_s double, is_last boolean, start_s double, text string"


def transcribe_frames(
    frames: DataFrame,
    model_fn: ModelFn,
    window_s: int = LONG_WINDOW_SECONDS,
    stride_s: int = LONG_STRIDE_SECONDS,
    rate: int = SAMPLE_RATE,
    deadline_s: float | None = None,
) -> Transcribed:
    """Transcripts of ``[MM:SS] text`` lines of recordings in frames (``framing.COLUMNS``).

    Frames are resampled to ``rate`` one by one and cut into overlapping windows that are spread over
    the cluster; a window is put together only in the worker that asks the model. ``model_fn`` yields
    (recording_id, window_no, offset_s, is_last, start_s, text) with times inside the window; of two
    windows that cover a moment, the one further from its edge counts. A window on which the model
    raises, crashes or is later than ``deadline_s`` is a row of ``failures``; the lines of all other
    windows stand.
    """
    pieces = window_pieces(resample_frames(frames, rate), rate, window_s, stride_s)
    dealt = pieces.repartition("recording_id", "window_no").sortWithinPartitions("recording_id", "window_no", "at")
    place = ["recording_id", "window_no"]
    columns = [item.split()[0] for item in HEARD.split(", ")]
    model = whole_windows(guarded(model_fn, place, columns, deadline_s))
    heard = cut_lineage(infer(dealt, model, f"{HEARD}, error string"))
    in_core = ((F.col("window_no") == 0) | (F.col("start_s") >= stride_s)) & (
        F.col("is_last") | (F.col("start_s") < window_s - stride_s)
    )
    spoken = heard.filter("error IS NULL").filter(in_core)
    segments = spoken.withColumn("start_s", F.col("offset_s") + F.col("start_s"))
    texts = timestamped_text(segments, ["recording_id"], ["start_s", "window_no"])
    return Transcribed(texts, failures(heard).select(*place, "error"))


def transcribe_long(
    recordings: DataFrame,
    model_fn: ModelFn,
    window_s: int = LONG_WINDOW_SECONDS,
    stride_s: int = LONG_STRIDE_SECONDS,
    rate: int = SAMPLE_RATE,
) -> DataFrame:
    """The texts of ``transcribe_frames`` for recordings held as arrays (``recording_id``,
    ``sample_rate``, ``pcm``)."""
    return transcribe_frames(framed(recordings), model_fn, window_s, stride_s, rate).texts
