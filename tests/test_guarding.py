"""Failing, hanging and crashing models; recordings in frames; mappings met by sequences of runs."""

import os
import random
import re
import struct
import time
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinspark.operators import rewriting
from clinspark.operators.framing import framed, resample_frames, window_pieces
from clinspark.operators.guarding import guarded
from clinspark.operators.inference import Detector, reviewed, safe_rows
from clinspark.operators.rewriting import apply_global_mapping, sequence_matches, shortlist
from clinspark.plans.anonymize import anonymize, anonymize_table
from clinspark.plans.speech import transcribe_frames
from clinspark.sources.audio import read_audio_frames


def trouble(kind):
    """A batch model that answers with the doubled number and has trouble with 13."""

    def model(frames):
        for frame in frames:
            if (frame["n"] == 13).any():
                if kind == "raise":
                    raise ValueError("13")
                if kind == "hang":
                    time.sleep(60)
                if kind == "crash":
                    os._exit(3)
            yield frame.assign(twice=frame["n"] * 2)

    return model


@pytest.mark.parametrize("kind, said", [("raise", "ValueError: 13"), ("hang", "TimeoutError: no answer within 2 s"), ("crash", "ProcessError: the model's process ended")])
def test_all_other_rows_are_answered(spark, kind, said):
    """One row of a batch fails; neighbours in the batch, the partition and other partitions do not."""
    numbers = spark.range(0, 40, 1, 2).select(F.col("id").alias("n"))
    guard = guarded(trouble(kind), ["n"], ["n", "twice"], deadline_s=None if kind == "raise" else 2)
    got = {r["n"]: (r["twice"], r["error"]) for r in numbers.mapInPandas(guard, "n long, twice long, error string").collect()}
    assert got == {n: (2 * n, None) for n in range(40) if n != 13} | {13: (None, said)}


def test_models_are_built_once_and_after_failures():
    built = []

    def model(frames):
        built.append(1)
        for frame in frames:
            if (frame["n"] % 10 == 3).any():
                raise KeyError("three")
            yield frame.assign(twice=frame["n"] * 2)

    batches = [pd.DataFrame({"n": range(at, at + 5)}) for at in range(0, 40, 5)]
    out = pd.concat(guarded(model, ["n"], ["n", "twice"])(iter(batches)))
    assert sorted(out["n"]) == list(range(40)) and sorted(out[out["error"].notna()]["n"]) == [3, 13, 23, 33]
    assert len(built) == 1 + 4 + 4  # each failed batch, each failed row
    built.clear()
    assert len(list(guarded(model, ["n"], ["n", "twice"])(iter([batches[1], batches[3]])))) == 2 and len(built) == 1

    def unbuildable(frames):
        raise RuntimeError("no weights")
        yield

    with pytest.raises(RuntimeError):
        list(guarded(unbuildable, ["n"], ["n", "twice"])(iter(batches)))


@pytest.mark.parametrize("deadline", [None, 20])
def test_single_answers_leave_together(deadline):
    """Each frame that leaves a worker costs milliseconds: a failed batch gives a few, not one a row."""

    def model(frames):
        for frame in frames:
            if (frame["n"] % 5 == 0).any():
                raise ValueError("five")
            yield frame.assign(twice=frame["n"] * 2, half=[n / 2 if n % 2 else n // 2 for n in frame["n"]])

    first = 2**60  # would not survive a column of floats
    batches = [pd.DataFrame({"n": range(at, at + 100)}) for at in (first, first + 100)]
    frames = list(guarded(model, ["n"], ["n", "twice", "half"], deadline)(iter(batches)))
    assert len(frames) <= 6 and all(set(frame.columns) == {"n", "twice", "half", "error"} for frame in frames)
    got = {n: (None if pd.isna(twice) else twice, said) for frame in frames for n, twice, said in zip(frame["n"], frame["twice"], frame["error"])}
    assert got == {n: (None, "ValueError: five") if n % 5 == 0 else (2 * n, None) for n in range(first, first + 200)}


def test_late_reviews_are_failures(spark):
    def model(row):
        if row["n"] == 2:
            time.sleep(60)
        return f"reply {row['n']}"

    asked = spark.range(4).select(F.col("id").alias("n"))
    got = {r["n"]: (r["reply"], r["error"]) for r in reviewed(asked, safe_rows(model), deadline_s=2).collect()}
    assert got == {n: (f"reply {n}", None) for n in (0, 1, 3)} | {2: (None, "TimeoutError: no answer within 2 s")}


def brittle(frames):
    for frame in frames:
        rows = []
        for row in frame.itertuples():
            if "poison" in row.text:
                raise ValueError("cannot read")
            rows += [(row.doc_id, row.chunk_idx, n, "SURNAME", m[0], m.start(), m.end(), 0.9) for n, m in enumerate(re.finditer("Jansen|Smit", row.text))]
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "pos", "raw_type", "word", "start", "end", "score"])


def test_a_failing_detector_withholds_only_its_texts(spark):
    docs = spark.createDataFrame([(1, "Jansen came"), (2, "poison for Smit"), (3, "Smit left")], "doc_id long, text string")
    detector = Detector(brittle, "multilingual_pii")
    done = anonymize(docs, detector=detector)
    texts = {r["doc_id"]: (r["anonymized_text"], r["error"]) for r in done.texts.collect()}
    assert texts == {1: ("[PERSON_1] came", None), 2: (None, "detect: ValueError: cannot read"), 3: ("[PERSON_1] left", None)}
    assert [tuple(r) for r in done.failures.collect()] == [(2, 0, "detect", "ValueError: cannot read")]
    released = anonymize(docs, detector=detector, release_failed=True).texts
    assert released.filter("doc_id = 2").first()["anonymized_text"] == "poison for Smit"


def test_table_with_two_passes_and_a_mapping(spark):
    rows = spark.createDataFrame([(1, "Jansen came", "ward A"), (2, "poison", "ward B"), (3, None, "Smit")], "doc_id long, note string, place string")
    known = spark.createDataFrame([("Smit", "PERSON", "[PERSON_4]", 1)], "entity string, type string, replacement string, seq long")

    def model(row):
        found = re.search("ward [AB]", row["user"])
        return '[{"entity": "%s", "type": "LOCATION"}]' % found[0] if found and "Detected" not in row["user"] else "[]"

    done = anonymize_table(rows, "doc_id", ["note", "place"], Detector(brittle, "multilingual_pii"), ("ner", "llm"), safe_rows(model), known)
    got = {r["doc_id"]: tuple(r)[1:] for r in done.texts.collect()}
    assert got == {1: ("[PERSON_5] came", "[LOCATION_1]", None), 2: (None, None, "detect: ValueError: cannot read"), 3: (None, "[PERSON_4]", None)}
    assert done.label == "ner+llm" and done.failures.count() == 1
    assert {r["source"] for r in done.detections.collect()} == {"first", "second"}


# --- frames --------------------------------------------------------------------------------------
def whole_resample(samples, rate, target):
    if rate == target:
        return samples.astype(np.float32)
    ratio = rate / target
    count = int(np.floor(len(samples) / ratio + 0.5))
    position = np.arange(count) * ratio
    low = np.floor(position).astype(int)
    high = np.minimum(low + 1, len(samples) - 1)
    share = position - low
    return (samples[low] * (1 - share) + samples[high] * share).astype(np.float32)


@pytest.mark.parametrize("rate", [8000, 16000, 22050, 44100, 48000])
@pytest.mark.parametrize("size", [0, 1, 2, 999, 1000, 1001, 5003])
def test_frames_resample_like_the_whole(spark, rate, size):
    rng = np.random.default_rng(size + rate)
    samples = rng.uniform(-1, 1, size).astype(np.float32)
    recordings = spark.createDataFrame([("a", rate, samples.tolist()), ("b", rate, samples[::-1].tolist())], "recording_id string, sample_rate int, pcm array<float>")
    rows = resample_frames(framed(recordings, 500), 16000).orderBy("recording_id", "start").collect()
    for name, given in (("a", samples), ("b", samples[::-1])):
        mine = [r for r in rows if r["recording_id"] == name]
        got = np.concatenate([np.array(r["pcm"], dtype=np.float32) for r in mine]) if mine else np.zeros(0, dtype=np.float32)
        want = whole_resample(given.astype(np.float64), rate, 16000)
        assert np.array_equal(got, want)
        assert all(r["total"] == len(want) for r in mine)
        assert [r["start"] for r in mine] == np.cumsum([0, *(len(r["pcm"]) for r in mine)]).tolist()[:-1]


def test_windows_of_frames_hold_what_windows_of_recordings_hold(spark):
    rng = np.random.default_rng(4)
    for size in (0, 5, 300, 301, 777, 1900):
        samples = rng.uniform(-1, 1, size).astype(np.float32)
        one = spark.createDataFrame([("r", 10, samples.tolist())], "recording_id string, sample_rate int, pcm array<float>")
        rows = window_pieces(framed(one, 64), rate=10, window_s=30, stride_s=5).orderBy("window_no", "at").collect()
        numbers = sorted({r["window_no"] for r in rows})
        assert numbers == list(range(max(-(-(size - 300) // 200), 0) + 1))
        for number in numbers:
            mine = [r for r in rows if r["window_no"] == number]
            got = np.concatenate([np.array(r["pcm"], dtype=np.float32) for r in mine])
            assert np.array_equal(got, samples[number * 200 : number * 200 + 300])
            assert {r["is_last"] for r in mine} == {number == numbers[-1]}


def write_wav(path, samples, rate=8000, channels=1, extra=b""):
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes(samples.astype("<i2").tobytes())
    if extra:
        data = path.read_bytes()
        path.write_bytes(data[:12] + b"LIST" + struct.pack("<I", len(extra)) + extra + b"\0" * (len(extra) % 2) + data[12:])


def test_long_recordings_never_fill_a_row(spark, tmp_path):
    """Three minutes at 48 kHz in two channels: every row stays under 1 MB up to the model."""
    rng = np.random.default_rng(1)
    samples = rng.integers(-30000, 30000, 2 * 48_000 * 180)
    write_wav(tmp_path / "long.wav", samples, 48_000, 2, b"a comment")
    write_wav(tmp_path / "none.wav", samples[:0])
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    frames = read_audio_frames(spark, str(tmp_path))
    rows = frames.select("path", "seq", "start", "total", F.size("pcm").alias("n"), "next_sample", "error").collect()
    long = sorted((r for r in rows if r["path"] == "long.wav"), key=lambda r: r["seq"])
    mono = samples.reshape(-1, 2).mean(axis=1) / 32768
    assert sum(r["n"] for r in long) == len(mono) and max(r["n"] for r in long) * 4 < 1 << 20
    assert all(abs(a["next_sample"] - mono[b["start"]]) < 1e-6 for a, b in zip(long, long[1:])) and long[-1]["next_sample"] is None
    assert [r["n"] for r in rows if r["path"] == "none.wav"] == [0]
    assert [r["error"] is not None for r in rows if r["path"] == "bad.wav"] == [True]

    def model(windows):
        for window in windows:
            row = window.iloc[0]
            if row["window_no"] == 3:
                raise RuntimeError("noise")
            yield pd.DataFrame([(row["recording_id"], row["window_no"], row["offset_s"], row["is_last"], 10.0, str(len(row["pcm"])))],
                               columns=["recording_id", "window_no", "offset_s", "is_last", "start_s", "text"])

    good = frames.filter("error IS NULL").withColumnRenamed("path", "recording_id")
    pieces = window_pieces(resample_frames(good))
    assert pieces.agg(F.max(F.size("pcm"))).first()[0] * 4 < 1 << 20
    done = transcribe_frames(good, model)
    assert [tuple(r) for r in done.failures.collect()] == [("long.wav", 3, "RuntimeError: noise")]
    texts = {r["recording_id"]: r["transcript"].split("\n") for r in done.texts.collect()}
    assert texts["none.wav"] == ["[00:10] 0"]
    full = str(30 * 16_000)
    assert texts["long.wav"][:4] == [f"[00:10] {full}", f"[00:30] {full}", f"[00:50] {full}", f"[01:30] {full}"]


# --- mappings ------------------------------------------------------------------------------------
def test_candidates_are_hits_up_to_separators(spark):
    """A thousand first and a thousand last names in one mapping; a text with many of both has two hits."""
    firsts, lasts = ([f"{kind}{chr(97 + n // 100)}{chr(97 + n // 10 % 10)}{chr(97 + n % 10)}" for n in range(1000)] for kind in ("fi", "la"))
    names = [(f"{a} {b}", f"[P_{n}]", n) for n, (a, b) in enumerate((a, b) for a in firsts for b in random.Random(1).sample(lasts, 20))]
    mapping = spark.createDataFrame(names, "entity string, replacement string, seq long")
    pair, other = names[777][0], names[15_000][0].replace(" ", " - ")
    text = " x ".join([*firsts[:300], *lasts[:300], pair.upper(), other])
    texts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r["entity"] for r in sequence_matches(texts, mapping, ["doc_id"]).collect()} == {pair, names[15_000][0]}


def brute_rewrite(text, entries):
    """One after the other, longest first, each over what is left."""
    for entity, tag, _ in sorted(entries, key=lambda e: (-len(e[0]), e[2])):
        before = r"(?<![^\W_])" if entity[0].isalnum() else ""
        after = r"(?![^\W_])" if entity[-1].isalnum() else ""
        text = re.sub(before + re.escape(entity) + after, lambda _: tag, text, flags=re.IGNORECASE)
    return text


@pytest.mark.parametrize("tags", ["words", "signs"])
def test_sequential_rewriting_under_one_mapping(spark, tags):
    for seed in range(3):
        rng = random.Random(seed)
        words = ["ann", "bo", "cy", "person", "other", "1", "2", "x-y", "--", "d.", "person_1", "ann bo", "bo, cy", "other 2"]
        entities = rng.sample(words, 10)
        put = ["[PERSON_1]", "[OTHER_2]", "ann", "(x)", "y cy"] if tags == "words" else ["***", "", "[PERSON_1]", "."]
        mapping = [(entity, rng.choice(put), n) for n, entity in enumerate(entities)]
        texts = [(n, rng.choice([" ", ", ", "--"]).join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for n in range(25)]
        given = spark.createDataFrame(mapping, "entity string, replacement string, seq long")
        done = apply_global_mapping(spark.createDataFrame(texts, "doc_id long, text string"), given, ["doc_id"], mode="sequential")
        got = {r["doc_id"]: r["anonymized_text"] for r in done.collect()}
        assert got == {n: brute_rewrite(text, mapping) for n, text in texts}


def test_longer_than_compared_and_bounded_mask(spark, monkeypatch):
    monkeypatch.setattr(rewriting, "COMPARED", 4)
    monkeypatch.setattr(rewriting, "MIN_MASK_BITS", 64)
    monkeypatch.setattr(rewriting, "MAX_MASK_BITS", 64)
    long = " ".join(f"w{n}" for n in range(12))
    mapping = spark.createDataFrame([(long, "[L]", 0), ("w0 w1 w2 w3 zz", "[Z]", 1), ("w11", "[E]", 2)], "entity string, replacement string, seq long")
    texts = spark.createDataFrame([(1, f"a {long} w11 b"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["anonymized_text"] for r in apply_global_mapping(texts, mapping, ["doc_id"]).collect()}
    assert got == {1: "a [L] [E] b", 2: None, 3: ""}
    assert shortlist(texts, mapping.limit(0), ["doc_id"]).count() == 0


def test_few_places_pass_the_mask_without_an_entity(spark):
    """What passes is shuffled with its runs. One bit a key let one place in 16 to 32 pass, with 16 runs each."""
    from clinspark.operators.rewriting import likely_places, lookup_entities

    names = [(f"a{n}", "[X]", n) for n in range(20_000)] + [(f"b{n} c{n} d{n} e{n}", "[Y]", n) for n in range(20_000)]
    mapping = spark.createDataFrame(names, "entity string, replacement string, seq long")
    words = " ".join(f"w{n}" for n in range(50_000))
    texts = spark.createDataFrame([(1, words), (2, "a7 or b9 c9 d9 e9 f9")], "doc_id long, text string")
    passed = likely_places(texts, lookup_entities(mapping), ["doc_id"]).collect()
    assert sum(r["doc_id"] == 1 for r in passed) < 1000  # of 100,000 places
    assert sorted(r["_next"] for r in passed if r["doc_id"] == 2) == [["a7"], ["b9", "c9", "d9", "e9"]]
    found = sequence_matches(texts, mapping, ["doc_id"]).select("doc_id", "entity").collect()
    assert sorted(map(tuple, found)) == [(2, "a7"), (2, "b9 c9 d9 e9")]
