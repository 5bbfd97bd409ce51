"""Keeping one bad request from ending a job: failures as rows, time limits, models in child processes."""

from __future__ import annotations

import os
import signal
import time
from collections import deque
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection, Pipe

import pandas as pd

Batches = Iterator[pd.DataFrame]
ModelFn = Callable[[Batches], Batches]


class _Failed(Exception):
    """A batch without an answer; the text goes into the error column."""


def _serve(model_fn: ModelFn, inbox: Connection, outbox: Connection) -> None:
    """The child: answers batches until its inbox closes. ``done`` follows the rows of each batch."""
    asked = False

    def batches() -> Batches:
        nonlocal asked
        while True:
            if asked:
                outbox.send(("done", None))
            try:
                frame = inbox.recv()
            except EOFError:
                return
            asked = True
            yield frame

    try:
        for frame in model_fn(batches()):
            outbox.send(("rows", frame))
    except Exception as problem:  # noqa: BLE001 - told to the parent, which starts a new child
        outbox.send(("failed", f"{type(problem).__name__}: {problem}"))


class _Child:
    """A model in a process of its own, which is killed if it is late."""

    def __init__(self, model_fn: ModelFn, deadline_s: float | None):
        self.model_fn, self.deadline_s, self.process = model_fn, deadline_s, 0

    def start(self) -> None:
        inbox, self.outbox = Pipe(duplex=False)
        self.inbox, outbox = Pipe(duplex=False)
        self.process = os.fork()
        if self.process == 0:
            self.outbox.close()
            self.inbox.close()
            try:
                _serve(self.model_fn, inbox, outbox)
            finally:
                os._exit(0)  # nothing of the worker is cleaned up twice
        inbox.close()
        outbox.close()

    def stop(self) -> None:
        if self.process:
            os.kill(self.process, signal.SIGKILL)
            os.waitpid(self.process, 0)
            self.inbox.close()
            self.outbox.close()
        self.process = 0

    def answer(self, frame: pd.DataFrame) -> list[pd.DataFrame]:
        if not self.process:
            self.start()
        until = None if self.deadline_s is None else time.monotonic() + self.deadline_s
        frames = []
        try:
            self.outbox.send(frame)
            while True:
                if until is not None and not self.inbox.poll(max(0.0, until - time.monotonic())):
                    raise _Failed(f"TimeoutError: no answer within {self.deadline_s:g} s")
                kind, value = self.inbox.recv()
                if kind == "done":
                    return frames
                if kind == "failed":
                    raise _Failed(value)
                frames.append(value)
        except (EOFError, OSError):
            self.stop()
            raise _Failed("ProcessError: the model's process ended") from None
        except _Failed:
            self.stop()
            raise


def guarded(
    model_fn: ModelFn,
    place: list[str],
    columns: list[str],
    deadline_s: float | None = None,
    isolated: bool | None = None,
) -> ModelFn:
    """``model_fn`` with an ``error`` column, under which failed requests become rows.

    A batch that raises, crashes its process or gives no answer within ``deadline_s`` seconds is asked
    again row by row; a row that fails alone gives one row with its ``place`` columns, ``error`` and
    nulls for the other ``columns``. All other rows keep their answers, with ``error`` null unless the
    model filled it.

    A model gives the rows of a batch before it asks for the next one. With a deadline, or if
    ``isolated``, it runs in a child process of the worker, which is ended when a batch hangs or
    crashes; otherwise in the worker itself. Either way it is built once and once more after each
    failure.
    """
    isolated = deadline_s is not None if isolated is None else isolated

    def failed(rows: pd.DataFrame, said: str) -> pd.DataFrame:
        empty = {name: None for name in columns if name not in place}
        return pd.DataFrame({name: rows[name] for name in place} | empty | {"error": said}, index=rows.index)

    def complete(frame: pd.DataFrame) -> pd.DataFrame:
        return frame if "error" in frame.columns else frame.assign(error=None)

    def together(answers: list[pd.DataFrame]) -> Batches:
        """Answers to single rows as few frames: each frame that leaves costs as much as some hundred rows.
        Only frames of the same columns and types are joined, so that no value changes its type."""
        alike: dict[tuple, list[pd.DataFrame]] = {}
        for frame in answers:
            if len(frame):
                alike.setdefault((tuple(frame.columns), tuple(frame.dtypes)), []).append(frame)
        for frames in alike.values():
            yield complete(frames[0] if len(frames) == 1 else pd.concat(frames))

    def single_rows(frame: pd.DataFrame) -> list[pd.DataFrame]:
        return [frame.iloc[at : at + 1] for at in range(len(frame))]

    def in_child(frames: Batches) -> Batches:
        model = _Child(model_fn, deadline_s)
        try:
            for frame in frames:
                try:
                    yield from map(complete, model.answer(frame))
                    continue
                except _Failed as problem:
                    again, said = (single_rows(frame), "") if len(frame) > 1 else ([], str(problem))
                if not again:
                    yield failed(frame, said)
                answers: list[pd.DataFrame] = []
                for row in again:
                    try:
                        answers.extend(model.answer(row))
                    except _Failed as problem:
                        answers.append(failed(row, str(problem)))
                yield from together(answers)
        finally:
            model.stop()

    def in_worker(frames: Batches) -> Batches:
        again: deque[pd.DataFrame] = deque()
        ready: list[pd.DataFrame] = []  # answers of batches that are done
        held: list[pd.DataFrame] = []  # answers of the batch that is being worked on
        current: pd.DataFrame | None = None

        def source() -> Batches:
            while True:
                frame = again.popleft() if again else next(frames, None)
                if frame is None:
                    return
                yield frame

        def fed() -> Batches:
            nonlocal current
            for frame in source():
                ready.extend(held)
                held.clear()
                current = frame
                yield frame

        def leaving() -> Batches:
            """What is ready, joined if it answers single rows of a batch that failed."""
            out, ready[:] = list(ready), []
            return together(out) if len(out) > 1 else map(complete, out)

        ended = False
        while not ended:
            current = None
            answers = model_fn(fed())
            while True:
                try:
                    held.append(next(answers))
                except StopIteration:
                    ready.extend(held)
                    held.clear()
                    ended = True
                except Exception as problem:  # noqa: BLE001 - every failure becomes rows
                    if current is None:
                        raise  # the model cannot even be built
                    held.clear()
                    if len(current) == 1:
                        ready.append(failed(current, f"{type(problem).__name__}: {problem}"))
                    again.extendleft(reversed(single_rows(current) if len(current) > 1 else []))
                    break
                if ended:
                    break
                if not again:
                    yield from leaving()
            if ended or not again:
                yield from leaving()

    return in_child if isolated else in_worker
