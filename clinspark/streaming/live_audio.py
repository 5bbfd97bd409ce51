"""Live transcription: sample frames become chunks of 5 to 20 seconds per session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from clinspark.fixed_values import MAX_CHUNK_SECONDS, MIN_CHUNK_SECONDS
from clinspark.functions.audio import is_silent, resample
from clinspark.operators.inference import ModelFn, reviewed
from clinspark.functions.signals import is_invented_transcript
from clinspark.functions.text import is_blank, trim_spaces

CHUNKS = "session_id string, chunk_no long, from_sample long, sample_rate int, pcm array<float>"
STATE = "pcm array<float>, cursor long, chunk_no long, sample_rate int, deadline long"


class ChunkCutter(StatefulProcessor):
    """Keeps the unread samples of a session (less than five seconds of them between batches) and gives
    them out when the session ends or has been idle for ``idle_ms``."""

    def __init__(self, keep_short_end: bool, idle_ms: int | None):
        self.keep_short_end = keep_short_end
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.unread = handle.getValueState("unread", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("seq")
        rate = int(frames["sample_rate"].iloc[0])
        held, cursor, number = np.array([], dtype="float32"), 0, 0
        if self.unread.exists():
            stored, cursor, number, _, _ = self.unread.get()
            held = np.asarray(stored, dtype="float32")
        arrived = [np.asarray(pcm, dtype="float32") for pcm in frames["pcm"] if len(pcm)]
        samples = np.concatenate([held, *arrived])
        ended = "is_last" in frames and bool(frames["is_last"].any())
        floor = 1 if ended and self.keep_short_end else rate * MIN_CHUNK_SECONDS
        out = []
        while len(samples) >= floor and len(samples):
            piece, samples = np.split(samples, [min(len(samples), rate * MAX_CHUNK_SECONDS)])
            out.append((key[0], number, cursor, rate, piece.tolist()))
            cursor, number = cursor + len(piece), number + 1
        if ended:
            self.unread.clear()
        else:
            deadline = 0
            if self.idle_ms is not None:
                deadline = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
                self.handle.registerTimer(deadline)
            self.unread.update((samples.tolist(), cursor, number, rate, deadline))
        yield _chunks(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.unread.exists():
            samples, cursor, number, rate, deadline = self.unread.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= deadline:  # no frame came since
                if len(samples) and self.keep_short_end:
                    out.append((key[0], number, cursor, rate, list(samples)))
                self.unread.clear()
        yield _chunks(out)

    def close(self) -> None:
        pass


def _chunks(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session_id", "chunk_no", "from_sample", "sample_rate", "pcm"])


def live_chunks(
    frames: DataFrame, keep_short_end: bool = True, idle_ms: int | None = 5 * 60 * 1000
) -> DataFrame:
    """Chunks of a stream of (session_id, seq, sample_rate, pcm[, is_last]).

    A chunk is cut once at least five seconds are unread and holds at most twenty; a backlog leaves
    as several chunks. The cursor moves on whatever becomes of a chunk later. The rest of a session
    leaves with its last frame, or once no frame has come for ``idle_ms``; ``keep_short_end=False``
    drops it if it is shorter than five seconds. ``idle_ms=None`` sets no timers, for runs over a
    finished input, which would otherwise wait for the sessions that are still open.
    """
    mode = "None" if idle_ms is None else "ProcessingTime"
    return frames.groupBy("session_id").transformWithStateInPandas(
        ChunkCutter(keep_short_end, idle_ms), StructType.fromDDL(CHUNKS), "append", mode
    )


def answered_chunks(chunks: DataFrame, model_fn: ModelFn) -> DataFrame:
    """(session_id, chunk_no, text, error) of the chunks that are not silent, failed ones as well."""
    ready = chunks.withColumn("pcm", resample("pcm", "sample_rate")).filter(~is_silent("pcm"))
    text = trim_spaces(F.coalesce("reply", F.lit("")))
    return reviewed(ready, model_fn).select("session_id", "chunk_no", text.alias("text"), "error")


def transcribed_chunks(chunks: DataFrame, model_fn: ModelFn) -> DataFrame:
    """(session_id, chunk_no, text) of the chunks that hold accepted speech. Where failures matter, take
    ``answered_chunks`` and split it with ``accepted_segments`` and ``failures``."""
    return accepted_segments(answered_chunks(chunks, model_fn))


def accepted_segments(answered: DataFrame) -> DataFrame:
    heard = answered.filter("error IS NULL").select("session_id", "chunk_no", "text")
    return heard.filter(~is_blank("text") & ~is_invented_transcript("text"))


def live_transcript(segments: DataFrame) -> DataFrame:
    """The running transcript per session (update mode): accepted texts in order, joined by spaces."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_no", "text")))
    return segments.groupBy("session_id").agg(
        F.array_join(F.transform(parts, lambda part: part["text"]), " ").alias("transcript")
    )
