"""Running pluggable models over request tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspark.operators.detection import map_types
from clinspark.operators.guarding import Batches, ModelFn, guarded

ROWS_AT_ONCE = 500


def infer(
    requests: DataFrame, model_fn: ModelFn, schema: T.StructType | str, batch_size: int = ROWS_AT_ONCE
) -> DataFrame:
    """Run ``model_fn`` over the rows of ``requests`` in Arrow batches.

    ``model_fn`` is called once per partition with an iterator of frames, so a model is built once
    and kept for all batches. Sampling parameters (temperature, token limit) are request columns.
    Frames have at most ``batch_size`` rows: an Arrow batch has as many rows as the session allows, and
    what is asked and answered would be held several times over for all of them.
    """

    def regrouped(frames: Batches) -> Batches:
        def slices() -> Batches:
            for frame in frames:
                for start in range(0, len(frame), batch_size):
                    yield frame.iloc[start : start + batch_size]

        yield from model_fn(slices())

    return requests.mapInPandas(regrouped, schema)


def safe_rows(answer: Callable[[pd.Series], str], out: str = "reply") -> ModelFn:
    """A ``model_fn`` that answers row by row and records exceptions in ``error`` instead of failing
    the job."""

    def run(frames: Batches) -> Batches:
        for frame in frames:
            replies, errors = [], []
            for _, row in frame.iterrows():
                try:
                    reply, error = answer(row), None
                except Exception as problem:  # noqa: BLE001 - every failure becomes a row
                    reply, error = None, f"{type(problem).__name__}: {problem}"
                replies.append(reply)
                errors.append(error)
            yield frame.assign(**{out: replies, "error": errors})

    return run


def with_columns(df: DataFrame, **types: str) -> T.StructType:
    """The schema of ``df`` plus new columns, for ``infer``."""
    new = ", ".join(f"`{name}` {kind}" for name, kind in types.items())
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(new).fields])


SPAN_COLUMNS = {
    "pos": "int", "raw_type": "string", "word": "string", "start": "int", "end": "int",
    "score": "double",
}


class Detector:
    """A span detector: a batch function, the label table of its model and a score threshold.

    ``detect`` gets batches with the columns of the chunk table and yields rows of (keys, ``pos``,
    ``raw_type``, ``word``, ``start``, ``end``, ``score``). ``filter_garbage`` drops obvious nonsense
    before review, as zero-shot detectors need it.
    """

    def __init__(
        self,
        detect: ModelFn,
        model_id: str,
        threshold: float | None = None,
        filter_garbage: bool = False,
        deadline_s: float | None = None,
    ):
        self.detect = detect
        self.model_id = model_id
        self.threshold = threshold
        self.filter_garbage = filter_garbage
        self.deadline_s = deadline_s

    def answers(self, chunks: DataFrame, keys: list[str]) -> DataFrame:
        """Raw spans, and one row with ``error`` for each chunk that the detector failed on."""
        schema = with_columns(chunks.select(*keys), **SPAN_COLUMNS, error="string")
        columns = [*keys, *SPAN_COLUMNS]
        return infer(chunks, guarded(self.detect, keys, columns, self.deadline_s), schema)

    def typed(self, answers: DataFrame) -> DataFrame:
        return map_types(answers.filter("error IS NULL").drop("error"), self.model_id)

    def spans(self, chunks: DataFrame, keys: list[str]) -> DataFrame:
        return self.typed(self.answers(chunks, keys))


def pick_passes(
    requested: str, available: Callable[[str], bool]
) -> tuple[list[str], str]:
    """The detection passes to plan and the label of the run.

    ``requested`` is ``ner``, ``llm`` or ``ner+llm``. If the second model cannot be used the run
    falls back to the first pass and is labelled ``ner``. The probe runs before planning.
    """
    passes = requested.split("+")
    if not set(passes) <= {"ner", "llm"}:
        raise ValueError(f"unknown passes {requested!r}")
    if "llm" in passes and not available("llm"):
        if "ner" not in passes:
            raise RuntimeError("the requested model is not available")
        return ["ner"], "ner"
    return passes, requested


def reviewed(requests: DataFrame, model_fn: ModelFn, deadline_s: float | None = None) -> DataFrame:
    """Request rows with ``reply`` and ``error`` columns. Requests whose answer raises, crashes its
    process or is later than ``deadline_s`` have an error and no reply."""
    schema = with_columns(requests, reply="string", error="string")
    return infer(requests, guarded(model_fn, requests.columns, schema.fieldNames(), deadline_s), schema)


def failures(answered: DataFrame) -> DataFrame:
    return answered.filter(F.col("error").isNotNull())
