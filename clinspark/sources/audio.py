"""PCM frames out of wav files, by byte ranges."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.sources.files import list_files

FRAME_SAMPLES = 65_536
_PCM, _EXTENSIBLE = 1, 0xFFFE
SHAPES = "path string, uri string, sample_rate int, channels int, data_at bigint, total bigint, error string"
FRAMES = (
    "path string, seq bigint, start bigint, total bigint, sample_rate int, pcm array<float>, next_sample float, error string"
)


def wav_shape(opened) -> tuple[int, int, int, int]:
    """(rate, channels, place of the samples, samples per channel) of an open 16-bit wav file. Only the
    heads of its chunks are read."""
    size = opened.size()

    def take(at: int, count: int) -> bytes:
        opened.seek(at)
        data = opened.read(count)
        if len(data) < count:
            raise ValueError("the file ends inside a chunk")
        return data

    if take(0, 4) != b"RIFF" or take(8, 4) != b"WAVE":
        raise ValueError("not a wav file")
    at, form = 12, None
    while True:
        name, length = struct.unpack("<4sI", take(at, 8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", take(at + 8, 16))
        if name == b"data":
            break
        at += 8 + length + length % 2
    if form is None or form[0] not in (_PCM, _EXTENSIBLE) or form[5] != 16 or not form[1]:
        raise ValueError("only 16-bit PCM is supported")
    return form[2], form[1], at + 8, min(length, size - at - 8) // (2 * form[1])


def wav_samples(data: bytes, channels: int) -> np.ndarray:
    """Mono samples between -1 and 1; channels are averaged."""
    samples = np.frombuffer(data, dtype="<i2").reshape(-1, channels)
    return (samples.mean(axis=1) / 32768).astype("float32")


def _open(uri: str):
    address = uri if "://" in uri else "file://" + quote(uri.removeprefix("file:"), safe="/")
    system, place = fs.FileSystem.from_uri(address)
    return system.open_input_file(place)


def _shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, uri in zip(frame["path"], frame["uri"]):
            try:
                with _open(uri) as opened:
                    rows.append((path, uri, *wav_shape(opened), None))
            except Exception as problem:  # noqa: BLE001 - damaged files become error rows
                rows.append((path, uri, None, None, None, None, f"{type(problem).__name__}: {problem}"))
        out = pd.DataFrame(rows, columns=[item.split()[0] for item in SHAPES.split(", ")])
        yield out.astype({name: "Int64" for name in ("sample_rate", "channels", "data_at", "total")})


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            error, pcm, following = row.error, None, None
            if error is None:
                try:
                    width = 2 * int(row.channels)
                    with _open(row.uri) as opened:
                        opened.seek(int(row.data_at) + int(row.start) * width)
                        data = opened.read((int(row.samples) + 1) * width)
                    pcm = wav_samples(data[: len(data) // width * width], int(row.channels))
                    if len(pcm) > row.samples:
                        pcm, following = pcm[: int(row.samples)], (float(pcm[-1]) if row.start + row.samples < row.total else None)
                except Exception as problem:  # noqa: BLE001
                    error = f"{type(problem).__name__}: {problem}"
            columns = ["path", "seq", "start", "total", "sample_rate", "pcm", "next_sample", "error"]
            values = [(row.path, row.seq, row.start, row.total, row.sample_rate, pcm, following, error)]
            yield pd.DataFrame(values, columns=columns).astype({name: "Int64" for name in ("seq", "start", "total", "sample_rate")})


def read_audio_frames(spark: SparkSession, path: str, frame_samples: int = FRAME_SAMPLES) -> DataFrame:
    """(path, seq, start, total, sample_rate, pcm, next_sample, error) of the wav files below ``path``.

    A recording comes in frames of ``frame_samples`` samples, so no row holds more than those. Tasks
    first read the heads of the files' chunks, then frames are dealt over the cluster and each is read
    by its byte range; a long recording is read by many tasks. ``start`` is the frame's first sample of
    ``total``, ``next_sample`` the first one of the next frame, which resampling needs. A file that
    cannot be read is one row with ``error``.
    """
    files = list_files(spark, path).filter(F.lower("name").endswith(".wav")).select("path", "uri")
    shapes = files.mapInPandas(_shapes, SHAPES)
    last = F.greatest(F.ceil(F.col("total") / F.lit(frame_samples)) - 1, F.lit(0))
    numbers = F.when(F.col("error").isNull(), F.sequence(F.lit(0).cast("bigint"), last)).otherwise(F.array(F.lit(None).cast("bigint")))
    ranges = shapes.withColumn("seq", F.explode(numbers)).withColumn("start", F.col("seq") * frame_samples)
    ranges = ranges.withColumn("samples", F.least(F.lit(frame_samples).cast("bigint"), F.col("total") - F.col("start")))
    return ranges.repartition("path", "seq").mapInPandas(_read, FRAMES)
