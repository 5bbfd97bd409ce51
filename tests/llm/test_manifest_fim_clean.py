"""Merkle manifest, fill-in-the-middle and decontamination against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinspark.llm import decontamination, fill_in_middle as fim, merkle_manifest
from clinspark.llm.decontamination import contamination, decontaminate
from clinspark.llm.fill_in_middle import arranged, cut_points, fill_in_middle, restored, streamed
from clinspark.llm.merkle_manifest import build, leaf_digest, merkle_proofs
from tests.llm.cases import awkward_rows, frame, words

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ORDERED = lambda x: tuple((v is None, v) for v in x)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    number, _, lang, source, n_chars = row
    values = (number, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_over(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][at : at + 16])) for at in range(0, len(out[-1]), 16)])
    return out


def climb(levels, at, digest):
    """(siblings, digest at the top) of one node."""
    seen = ""
    for level in levels[:-1]:
        first = at - at % 16
        run = level[first : first + 16]
        seen += "".join(run[: at % 16] + run[at % 16 + 1 :])
        digest = sha("".join(run[: at % 16] + [digest] + run[at % 16 + 1 :]))
        at //= 16
    return seen, digest


def brute_manifest(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[3]].append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        members = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[source] = (members, levels_over([leaf(r, r[1]) for r in members]))
    top = levels_over([trees[source][1][-1][0] for source in order])
    want = []
    for place, source in enumerate(order):
        members, levels = trees[source]
        for at, row in enumerate(members):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            text = row[1].translate(LOWER) if tampered and row[1] is not None else row[1]
            low, digest = climb(levels, at, leaf(row, text))
            high, digest = climb(top, place, digest)
            want.append((row[0], levels[0][at], levels[-1][0], top[-1][0], sha(low + high), digest, digest == top[-1][0]))
    return want


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("keep_every", [1, 2])
def test_manifest(spark, monkeypatch, clashing, keep_every):
    monkeypatch.setattr(merkle_manifest, "KEEP_EVERY", keep_every)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 16**keep_every)
    monkeypatch.setattr(merkle_manifest, "ROWS_PER_RANGE", 40)
    rng = random.Random(3)
    rows = [(row[0], row[1], row[2], row[3], row[4]) for row in awkward_rows()]
    # One hot source with more leaves than two stored levels span, one with a lone leaf.
    rows += [(1000 + n, words(rng, 3).title(), None, "hot", n) for n in range(300)]
    rows += [(5000, "ALONE", "en", "é", None), (5000, "ALONE", "en", "é", None), (5001, "x", None, "", 3), (5002, "É A", None, "z", 0)]
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = [tuple(row) for row in merkle_proofs(frame(spark, rows, clashing), tamper=tamper).collect()]
    want = brute_manifest(rows)
    assert sorted(got, key=ORDERED) == sorted(want, key=ORDERED)
    assert {row[-1] for row in got} == {True, False}


def test_manifest_edges(spark):
    assert merkle_proofs(frame(spark, [])).count() == 0
    rows = [(7, "only", None, None, None)]
    assert [tuple(r) for r in merkle_proofs(frame(spark, rows)).collect()] == [(7, *[leaf(rows[0], "only")] * 3, sha(""), leaf(rows[0], "only"), True)]
    # Copies of one row are leaves of their own.
    assert merkle_proofs(frame(spark, rows * 40)).filter("verified").count() == 40


def test_manifest_stores_few_levels(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"),
        F.lit(1).alias("n_chars"), F.concat(F.lit("t"), "id").alias("text"),
    )
    leaves = docs.select("source", F.col("doc_id").alias("id"), leaf_digest(*map(F.col, FIELDS)).alias("digest"))
    stored = build(leaves).nodes().filter("forest = 'sources'").groupBy("depth").count().collect()
    assert {row["depth"]: row["count"] for row in stored} == {0: 5000, 2: 20, 4: 1}


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(number, text):
    text = text or ""
    units = UNITS.findall(text)
    digits = sha(f"42:{'' if number is None else number}")
    h1, h2, h3, h4 = (int(digits[at : at + 8], 16) for at in range(0, 32, 8))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(mark in text for mark in fim.SENTINELS) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text), text
    form = "spm" if h4 % 100 < 80 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, form, len(prefix), len(middle), sha(output), sha(text), output


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("scan", [7, 1 << 22])
def test_fill_in_middle(spark, monkeypatch, clashing, scan):
    monkeypatch.setattr(fim, "SCAN_BYTES", scan)
    rows = [row for row in awkward_rows() if scan > 100 or len(row[1] or "") < 5000]
    rows += [(100 + n, text, None, None, None) for n in range(40) for text in ("a <P> b", " <S>", "x<M", " é  日本\t\n", "plain words only here ")]
    got = fill_in_middle(frame(spark, rows, clashing))
    assert {"doc_id", "text", "lang"} <= set(got.columns)
    columns = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")
    found = [(row["doc_id"], row["text"], *(row[name] for name in columns)) for row in got.select("doc_id", "text", *columns).collect()]
    want = [(row[0], row[1], *brute_fim(row[0], row[1])) for row in rows]
    assert sorted(found, key=ORDERED) == sorted(want, key=ORDERED)
    assert {row[3] for row in found} == {"plain", "spm", "psm"}
    assert fill_in_middle(frame(spark, [])).count() == 0


def test_fill_in_middle_pieces(spark):
    """The descriptors alone give the output."""
    rows = [(n, f"été {n} one two\tthree  four ", None, None, None) for n in range(30)]
    marks = "".join(fim.SENTINELS).encode()
    for row in fill_in_middle(frame(spark, rows)).collect():
        buffers = (row["text"].encode(), marks)
        assert b"".join(buffers[p["buffer"]][p["start"] : p["start"] + p["length"]] for p in row["pieces"]).decode() == row["output"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="a é\n\t日<P", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from(["psm", "spm", "plain"]))
def test_round_trip(text, first, second, form):
    data = text.encode()
    n, low, high = cut_points(np.frombuffer(data, dtype=np.uint8), first, second)
    assert n == len(UNITS.findall(text))
    if form != "plain" and any(mark in text for mark in fim.SENTINELS):
        return
    marks = "".join(fim.SENTINELS).encode()
    output = b"".join(streamed(arranged(len(data), low, high, form), memoryview(data), marks))
    back = b"".join(streamed(restored(output, form), memoryview(output), marks))
    assert back == data and len(output) == len(data) + (0 if form == "plain" else 9)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_clean(rows, items):
    windows = defaultdict(set)
    for number, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        size = min(len(w), 10)
        for at in range(len(w) - size + 1) if w else ():
            windows[tuple(w[at : at + size])].add(number)
    want = []
    for row in rows:
        w = WORD.findall((row[1] or "").translate(LOWER))
        hit, met = set(), set()
        for size in {len(key) for key in windows}:
            for at in range(len(w) - size + 1):
                if (key := tuple(w[at : at + size])) in windows:
                    hit |= set(range(at, at + size))
                    met |= windows[key]
        listed = sorted(str(item) for item in met if item is not None)
        want.append((row[0], len(w), len(hit), len(listed), sha(",".join(listed)), bool(hit)))
    return want


def clean_cases():
    rng = random.Random(9)
    passages = [words(rng, 14) for _ in range(6)]
    items = [(n, text) for n, text in enumerate(passages)] + [
        (10, "Two Words"), (11, "été"), (12, None), (13, " .,-"), (None, words(rng, 12)), (2, passages[5]), (20, passages[0]), (21, passages[0][:-3]),
    ]
    rows = [row for row in awkward_rows() if len(row[1] or "") < 5000]
    for n in range(60):
        given = rng.choice(passages).split()
        part = given[rng.randint(0, 2) :][: rng.choice([9, 10, 11, 14])]
        text = f"{words(rng, rng.randint(0, 30))} {rng.choice([' ', '; '])}{', '.join(part).upper()}. {words(rng, rng.randint(0, 9))}"
        rows.append((100 + n, text, None, None, None))
    rows += [(200, f"{passages[1]} {passages[1]} TWO-words étÉ ÉTÉ {passages[2]}", None, None, None)] * 2
    rows += [(201, items[10][1], None, None, None), (202, "two\x00words _été_", None, None, None)]
    return rows, items


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("bytes_at_most", [0, 128 << 20])
def test_contamination(spark, monkeypatch, clashing, bytes_at_most):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", bytes_at_most)
    rows, items = clean_cases()
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame(spark, rows, clashing), tests).collect()
    found = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), sha(",".join(r["items"])), r["n_hit"] > 0) for r in got]
    want = brute_clean(rows, items)
    assert sorted(found, key=ORDERED) == sorted(want, key=ORDERED)
    assert 30 < sum(row[-1] for row in want) < len(want) - 20


def test_contamination_empty(spark):
    rows, items = clean_cases()
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(frame(spark, []), tests).count() == 0
    none = contamination(frame(spark, rows), tests.limit(0)).collect()
    assert len(none) == len(rows) and not any(row["n_hit"] or row["items"] or row["spans"] for row in none)


def test_a_shared_hash_is_no_hit(spark):
    """The window's key is found, its words are others."""
    docs = frame(spark, [(1, "aa bb cc", None, None, None), (2, "dd", None, None, None)])
    grams = spark.createDataFrame([(1, "aa bb"), (1, "dd")], "length int, gram string")
    assert [row["gram"] for row in decontamination.scan(docs, grams, "doc_id", "text").filter("at > 0").collect()] == ["dd"]


@pytest.mark.parametrize("clashing", [False, True])
def test_decontaminate(spark, clashing):
    rows, items = clean_cases()
    tests = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows, clashing)
    dirty = [row[-1] for row in brute_clean(rows, items)]
    kept = decontaminate(docs, tests, "documents")
    assert kept.columns == docs.columns
    want = Counter(row[:2] for row, bad in zip(rows, dirty) if not bad)
    assert Counter(map(tuple, kept.select("doc_id", "text").collect())) == want
    cut = decontaminate(docs, tests)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    texts = {(r["doc_id"], r["text"]) for r in cut.select("doc_id", "text").collect()}
    assert {row[:2] for row, bad in zip(rows, dirty) if not bad} <= texts
    assert (202, "") in texts or (202, "_") in texts
    assert [WORD.findall(text.translate(LOWER)) for number, text in texts if number == 200] == [["étÉ", "ÉtÉ"]]
    with pytest.raises(ValueError):
        decontaminate(docs, tests, "all")
