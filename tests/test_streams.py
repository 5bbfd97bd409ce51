"""Streams driven by files, batch by batch."""

import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinspark.operators.inference import Detector, safe_rows
from clinspark.plans.anonymize import anonymize
from clinspark.streaming.dictation import EntryPairing, dictation_stream
from clinspark.streaming.live_audio import ChunkCutter, live_chunks, live_transcript, transcribed_chunks
from clinspark.streaming.mappings import SessionMapping, anonymize_stream, session_mapping_stream


def feed(spark, folder, batches, schema):
    """A file stream that delivers one batch per file."""
    for number, rows in enumerate(batches):
        part = spark.createDataFrame(rows, schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, name, tmp_path, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return stream.sparkSession.table(name).collect()


RATE = 10
FRAMES = "session_id string, seq long, sample_rate int, pcm array<float>, is_last boolean"


def frames(session, first, seconds, last=False):
    return [
        (session, first + i, RATE, [float(first + i)] * RATE, last and i == seconds - 1) for i in range(seconds)
    ]


def test_live_chunks(spark, tmp_path):
    batches = [frames("a", 0, 3), frames("a", 3, 3) + frames("b", 0, 47), frames("a", 6, 2, True)]
    rows = run(live_chunks(feed(spark, tmp_path / "in", batches, FRAMES), False, None), "chunks", tmp_path)
    got = sorted((r["session_id"], r["chunk_no"], r["from_sample"], len(r["pcm"])) for r in rows)
    assert got == [("a", 0, 0, 60), ("b", 0, 0, 200), ("b", 1, 200, 200), ("b", 2, 400, 70)]


def test_short_ends_can_be_kept(spark, tmp_path):
    batches = [frames("a", 0, 6), frames("a", 6, 2, True)]
    rows = run(live_chunks(feed(spark, tmp_path / "in", batches, FRAMES), idle_ms=None), "ends", tmp_path)
    assert sorted((r["chunk_no"], len(r["pcm"])) for r in rows) == [(0, 60), (1, 20)]


class Handle:
    """Stands in for the state of one key and its clock."""

    def __init__(self):
        self.timers, self.now, self.ttl = set(), 0, None

    def getValueState(self, *_):
        return Value()

    getListState = getValueState

    def getMapState(self, _name, _key, _value, ttl=None):
        return Counted(self, float("inf")) if ttl is None else Expiring(self, ttl)

    def registerTimer(self, moment):
        self.timers.add(moment)

    def deleteTimer(self, moment):
        self.timers.remove(moment)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return iter(list(self.held or [])) if isinstance(self.held, list) else self.held or iter(())

    def update(self, value):
        self.held = value

    put = update

    def appendList(self, values):
        self.held = [*(self.held or []), *values]

    def clear(self):
        self.held = None


class Expiring:
    def __init__(self, handle, ttl):
        self.handle, self.ttl, self.held = handle, ttl, {}

    def containsKey(self, key):
        return key in self.held and self.handle.now < self.held[key][0]

    def getValue(self, key):
        return self.held[key][1]

    def updateValue(self, key, value):
        self.held[key] = (self.handle.now + self.ttl, value)


def test_idle_session_is_flushed_and_forgotten():
    handle, cutter = Handle(), ChunkCutter(True, 1000)
    cutter.init(handle)
    frame = pd.DataFrame(frames("a", 0, 2), columns=["session_id", "seq", "sample_rate", "pcm", "is_last"])
    assert sum(len(x) for x in cutter.handleInputRows(("a",), iter([frame]), handle)) == 0
    handle.now = 500
    list(cutter.handleInputRows(("a",), iter([frame]), handle))
    handle.now = 1000  # the first timer: frames came since
    assert sum(len(x) for x in cutter.handleExpiredTimer(("a",), handle, handle)) == 0
    handle.now = 1500
    (out,) = cutter.handleExpiredTimer(("a",), handle, handle)
    assert [len(pcm) for pcm in out["pcm"]] == [40] and not cutter.unread.exists()


def test_tags_are_not_given_twice_while_an_entry_lives():
    handle, mapping = Handle(), SessionMapping(30)
    mapping.init(handle)
    assert mapping._replacement("Jan Smit", "PERSON") == ("[PERSON_1]", 1)
    handle.now = 20
    assert mapping._replacement("jan smit", "PERSON") == ("[PERSON_1]", 1)
    handle.now = 35
    assert mapping._replacement("Eva Bos", "PERSON") == ("[PERSON_2]", 2)
    handle.now = 200
    assert mapping._replacement("Eva Bos", "PERSON") == ("[PERSON_1]", 1)


def test_live_transcript(spark):
    """Silent chunks, invented texts and failures leave no trace; the rest joins in order."""
    chunks = spark.createDataFrame(
        [("s", 2, 16000, [0.5] * 4), ("s", 0, 16000, [0.4] * 4), ("s", 1, 16000, [0.0] * 4), ("s", 3, 16000, [0.9] * 4), ("s", 4, 16000, [0.8] * 4)],
        "session_id string, chunk_no long, sample_rate int, pcm array<float>")

    def model(row):
        if row["pcm"][0] > 0.85:
            raise RuntimeError("stuck")
        return "Thanks for watching" if row["pcm"][0] > 0.7 else f" said {row['chunk_no']} "

    rows = live_transcript(transcribed_chunks(chunks, safe_rows(model))).collect()
    assert [tuple(r) for r in rows] == [("s", "said 0 said 2")]


DOCS = [[(1, "mail a@x.nl"), (2, "mail b@x.nl")], [(3, "mail B@x.nl en c@x.nl")], [(4, "niets")]]


def test_mapping_grows_over_batches_and_survives_a_rerun(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", DOCS, "doc_id long, text string")
    paths = [str(tmp_path / name) for name in ("mapping", "out")]
    for attempt in range(2):
        # The second attempt forgets its progress and runs every batch again over the same folders.
        writer = anonymize_stream(stream, *paths, str(tmp_path / f"check{attempt}"))
        assert writer.trigger(availableNow=True).start().awaitTermination(180)
        texts = {r["doc_id"]: r["anonymized_text"] for r in spark.read.parquet(paths[1]).collect()}
        assert texts == {1: "mail [EMAIL_1]", 2: "mail [EMAIL_2]", 3: "mail [EMAIL_2] en [EMAIL_3]", 4: "niets"}
        assert spark.read.parquet(paths[0]).count() == 3
    batch = anonymize(spark.read.parquet(str(tmp_path / "in")), scope="global").texts
    assert {r["doc_id"]: r["anonymized_text"] for r in batch.collect()} == texts


def half_blind(frames):
    for frame in frames:
        if frame["text"].str.contains("poison").any():
            raise ValueError("cannot read")
        rows = [
            (row.doc_id, row.chunk_idx, n, "SURNAME", m[0], m.start(), m.end(), 0.9)
            for row in frame.itertuples()
            for n, m in enumerate(re.finditer("Jansen|Smit", row.text))
        ]
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "pos", "raw_type", "word", "start", "end", "score"])


def test_stream_runs_both_passes_and_withholds_failures(spark, tmp_path):
    batches = [[(1, "Jansen in Ulm"), (2, "poison Smit")], [(3, "Smit met Jansen in Ulm")]]
    stream = feed(spark, tmp_path / "in", batches, "doc_id long, text string")

    def model(row):
        found = "Ulm" in row["user"] and "Detected" not in row["user"]
        return '[{"entity": "Ulm", "type": "LOCATION"}]' if found else "[]"

    writer = anonymize_stream(
        stream, str(tmp_path / "mapping"), str(tmp_path / "out"), str(tmp_path / "check"),
        detector=Detector(half_blind, "multilingual_pii"), passes=("ner", "llm"), model_fn=safe_rows(model),
    )
    assert writer.trigger(availableNow=True).start().awaitTermination(180)
    got = {r["doc_id"]: (r["anonymized_text"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("[PERSON_1] in [LOCATION_1]", None), 2: (None, "detect: ValueError: cannot read"), 3: ("[PERSON_2] met [PERSON_1] in [LOCATION_1]", None)}


def test_session_mappings_are_separate(spark, tmp_path):
    batches = [[("s1", 1, "a@x.nl"), ("s2", 2, "b@x.nl")], [("s1", 3, "b@x.nl A@x.nl")]]
    stream = feed(spark, tmp_path / "in", batches, "session_id string, doc_id long, text string")
    rows = run(session_mapping_stream(stream), "sessions", tmp_path)
    assert {r["doc_id"]: r["anonymized_text"] for r in rows} == {1: "[EMAIL_1]", 2: "[EMAIL_1]", 3: "[EMAIL_2] [EMAIL_1]"}


def test_dictation_pairs(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    at = lambda seconds: start + dt.timedelta(seconds=seconds)
    batches = [
        [("a", at(0), "start"), ("a", at(5), "start"), ("a", at(10.25), "stop"), ("b", at(1), "stop")],
        [("a", at(30), "stop"), ("b", at(3600), "start")],  # this stop comes before its start
        [("a", at(20), "start"), ("b", at(3602), "stop")],  # still in time: lateness counts from the batch before
        [("b", at(8000), "start"), ("c", at(7900), "start")],
        [("b", at(7990), "stop"), ("c", at(7950), "stop"), ("c", at(7920), "stop"), ("c", at(7930), "start")],
        [("d", at(20000), "start")],
    ]
    stream = feed(spark, tmp_path / "in", batches, "session_id string, ts timestamp, kind string")
    rows = run(dictation_stream(stream, "10 minutes"), "entries", tmp_path)
    got = sorted((r["session_id"], r["nr"], r["duration_s"]) for r in rows)
    assert got == [("a", 1, pytest.approx(10.2, abs=0.06)), ("a", 2, 10.0), ("b", 1, 2.0), ("c", 1, 20.0), ("c", 2, 20.0)]


class Counted(Expiring):
    """A map state that counts the events written to it."""

    written = 0

    def updateValue(self, key, value):
        self.written += len(value[0])
        super().updateValue(key, value)

    def removeKey(self, key):
        self.held.pop(key, None)

    def keys(self):
        return iter(list(self.held))

    def exists(self):
        return bool(self.held)

    def clear(self):
        self.held = {}


def test_many_events_of_a_session_need_one_timer_and_linear_writes():
    handle, pairing = Handle(), EntryPairing(10**8)
    pairing.init(handle)
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    events = [(start + dt.timedelta(seconds=n), "start" if n % 2 == 0 else "stop") for n in range(10_000)]
    shuffled = rng.sample(events, len(events))
    frame = pd.DataFrame({"session_id": "a", "ts": [pd.Timestamp(ts) for ts, _ in shuffled], "kind": [kind for _, kind in shuffled]})
    list(pairing.handleInputRows(("a",), iter([frame]), handle))
    assert len(handle.timers) == 1 and pairing.waiting.written == 10_000
    out = []
    for second in (3000.5, 3001.5, 20_000):
        handle.now = int((start + dt.timedelta(seconds=second)).timestamp() * 1000)
        assert min(handle.timers) <= handle.now
        handle.timers.clear()  # Spark drops a timer that has fired
        out += [row for frame in pairing.handleExpiredTimer(("a",), handle, handle) for row in frame.itertuples(index=False)]
        assert len(handle.timers) == 1
    assert [(row.nr, row.duration_s) for row in out] == [(n, 1.0) for n in range(1, 5001)]
    assert [row.start_ts for row in out] == sorted(row.start_ts for row in out)
    assert pairing.waiting.written <= 10_000 + 3 * 60 and not pairing.waiting.exists() and pairing.state.exists()


def test_out_of_order_events_pair_as_in_one_batch():
    handle, pairing = Handle(), EntryPairing(10**6)
    pairing.init(handle)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for second, kind in ((10, "stop"), (0, "start"), (20, "start"), (30, "stop")):
        frame = pd.DataFrame({"session_id": ["a"], "ts": [pd.Timestamp(start) + pd.Timedelta(seconds=second)], "kind": [kind]})
        list(pairing.handleInputRows(("a",), iter([frame]), handle))
    out = []
    while handle.timers:
        handle.now = min(handle.timers)
        handle.timers.clear()
        out += [row for frame in pairing.handleExpiredTimer(("a",), handle, handle) for row in frame["duration_s"]]
    assert out == [10.0, 10.0]
    assert not pairing.state.exists() and not pairing.waiting.exists()
