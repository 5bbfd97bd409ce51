"""SimHash groups, near duplicates, repeated windows, packing and language models by brute force."""

import math
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinspark.llm import components as components_module
from clinspark.llm import language_ppm, near_copies, packing, repeated_windows, simhash_tiles
from clinspark.llm.common import small_table
from clinspark.llm.components import components
from clinspark.llm.language_ppm import ORDER, SYMBOLS, build_model, code_lengths, fit, held_out, predict
from clinspark.llm.packing import pack, pack_documents, shortest_pack_first, token_pieces, word_encoder
from clinspark.llm.registered import tokenizer_file
from clinspark.llm.repeated_windows import remove_repeats
from clinspark.llm.near_copies import crossing, near_duplicates
from clinspark.llm.simhash_tiles import linked_in_tile, simhash_groups
from tests.llm.cases import awkward_rows, frame, words

ORDERED = lambda x: tuple((v is None, v) for v in x)


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    return [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))] if found else []


def simhash(text, width):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def closed(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def variants(rng, base, count, changes):
    for _ in range(count):
        text = base.split()
        for _ in range(changes):
            text[rng.randrange(len(text))] = "w" + str(rng.randrange(10**6))
        yield " ".join(text)


@pytest.mark.parametrize("tile", [5, 16_384])
def test_simhash_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash_tiles, "TILE", tile)
    rng = random.Random(4)
    rows = awkward_rows()
    bases = [words(rng, 80) for _ in range(12)]
    texts = [t for base in bases for t in variants(rng, base, 6, 1)] + [bases[0]] * 30
    rows += [(100 + n, text, None, None, None) for n, text in enumerate(texts)]
    got = simhash_groups(frame(spark, rows, True), radius=4).collect()
    marks = {row[1]: simhash(row[1], 4) for row in rows}
    distinct = sorted(set(marks.values()))
    linked = [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 4]
    assert linked
    root = closed(distinct, linked)
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[root[marks[text]]] = min(doc_id, least.get(root[marks[text]], doc_id))
    want = [(row[0], marks[row[1]], least.get(root[marks[row[1]]])) for row in rows]
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=ORDERED) == sorted(want, key=ORDERED)


def test_components(spark):
    rng = random.Random(8)
    chain = [(n, n + 1) for n in range(0, 60)]
    star = [(1000, 1000 + n) for n in range(1, 90)]
    loose = [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(80)]
    links = chain + star + loose
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "left long, right long")).collect()}
    nodes = {x for pair in links for x in pair if pair[0] != pair[1]}
    assert got == closed(nodes, [p for p in links if p[0] != p[1]])
    assert components(spark.createDataFrame([], "left long, right long")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 70), st.integers(1, 70), st.sampled_from([1, 4]))
def test_tile_links_connect(seed, one, two, lanes):
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 2**63, (6, lanes), dtype=np.uint64)
    pick = seeds[rng.integers(0, 6, one + two)]
    flips = np.uint64(1) << rng.integers(0, 64, (one + two, lanes)).astype(np.uint64)
    marks = pick ^ np.where(rng.random((one + two, lanes)) < 0.7, flips, np.uint64(0))
    radius = 2 * lanes
    a, b = linked_in_tile(marks[:one], marks[one:], radius)
    near = [
        (i, one + j) for i in range(one) for j in range(two)
        if sum(int(x).bit_count() for x in marks[i] ^ marks[one + j]) <= radius
    ]
    assert closed(range(one + two), near) == closed(range(one + two), list(zip(a.tolist(), b.tolist())))
    assert len(a) < one + two


def jaccard(one, two):
    a, b = set(shingles(one, 5)), set(shingles(two, 5))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("local", [0, 2_000_000])
def test_near_duplicates(spark, monkeypatch, local):
    monkeypatch.setattr(near_copies, "LOCAL_SHINGLES", local)
    rng = random.Random(6)
    rows, groups = [], []
    for group in range(15):
        base = words(rng, 150)
        texts = [base, *variants(rng, base, 3, 2)]
        ids = [group * 10 + n for n in range(4)]
        rng.shuffle(ids)
        assert all(jaccard(base, text) >= 0.8 for text in texts)
        groups.append((ids, texts))
        rows += [(i, t, None, None, None) for i, t in zip(ids, texts)]
    clean = [(1000 + n, words(rng, 150), None, None, None) for n in range(60)]
    far = list(variants(rng, clean[0][1], 1, 30))[0]  # shares much with a clean text, but under 0.8
    assert jaccard(far, clean[0][1]) < 0.6
    rows += [*clean, (2000, far, None, None, None), (2001, None, None, None, None), (2002, " ", None, None, None)]
    rows += [(None, clean[1][1], None, None, None)]
    got = {r["doc_id"]: r["keep_id"] for r in near_duplicates(frame(spark, rows, True)).collect()}
    want = {i: min(ids) for ids, _ in groups for i in ids} | {2001: 2001, 2002: 2001}
    assert got == want


def test_near_duplicates_none(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    assert near_duplicates(frame(spark, [(1, "a b c d e f", None, None, None)])).count() == 0


@pytest.mark.parametrize("sided", [False, True])
@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_crossing_connects(monkeypatch, sided, similarity):
    """Links and known classes together connect what all pairs connect, at any limit of single tests."""
    for seed in range(12):
        monkeypatch.setattr(near_copies, "SINGLE_TESTS", seed % 3)
        rng = np.random.default_rng(seed)
        ids = rng.permutation(60)
        base = rng.integers(0, 200, 40)
        sets = [np.unique(np.concatenate([base[rng.random(40) < 0.8], rng.integers(0, 200, rng.integers(0, 12))])) for _ in ids]
        sets[3] = sets[7] = np.zeros(0, dtype=np.int64)
        classes, sides = np.where(rng.random(60) < 0.4, ids // 6 * 6, ids + 1000), (ids % 2 if sided else None)

        def wanted(a, b):
            both = len(np.intersect1d(sets[a], sets[b]))
            return both >= similarity * (len(sets[a]) + len(sets[b]) - both) and not (sided and sides[a] == sides[b] and len(sets[a]))

        known = [(int(i), int(c)) for i, c in zip(ids, classes)]
        pairs = [(int(ids[a]), int(ids[b])) for a, b in combinations(range(60), 2) if wanted(a, b)]
        links = crossing(ids, classes, sets, similarity, sides)
        nodes = {x for pair in known for x in pair}
        assert closed(nodes, known + links) == closed(nodes, known + pairs)
        of = dict(zip(ids.tolist(), sets))
        for one, two in links:
            both = len(np.intersect1d(of[one], of[two]))
            assert both >= similarity * (len(of[one]) + len(of[two]) - both)


@pytest.mark.parametrize("local", [20_000, 2_000_000])
def test_near_duplicates_along_a_chain(spark, monkeypatch, local):
    """2000 versions of which only neighbours are similar, and one hot group: few jobs, one group each."""
    monkeypatch.setattr(near_copies, "LOCAL_SHINGLES", local)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 20_000)
    rng = random.Random(77)
    texts = sliding(rng, 2000)
    base = words(rng, 100).split()
    hot = [" ".join([*base[:at], "edit", *base[at + 1 :]]) for at in (rng.randrange(100) for _ in range(500))]
    rows = [(n, text, None, None, None) for n, text in enumerate(texts)] + [(5000 + n, text, None, None, None) for n, text in enumerate(hot)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "near copies along a chain")
    got = {r["doc_id"]: r["keep_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "")
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(texts, texts[1:]))
    assert got == {n: 0 for n in range(2000)} | {5000 + n: 5000 for n in range(500)}
    assert jobs < 600  # with adaptive execution every exchange is a job


def brute_repeats(rows, window):
    first = {}
    texts = [(row[0], (row[1] or "").encode()) for row in rows]
    big = float("inf")
    for doc_id, data in texts:
        for at in range(len(data) - window + 1):
            place = (big if doc_id is None else doc_id, at)
            key = data[at : at + window]
            first[key] = min(first.get(key, place), place)
    out = []
    for doc_id, data in texts:
        gone = bytearray(len(data))
        for at in range(len(data) - window + 1):
            if first[data[at : at + window]] < (big if doc_id is None else doc_id, at):
                gone[at : at + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), kept))
    return out


def repeats_of(df, window=100):
    got = remove_repeats(df, window=window)
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got.collect()]


@pytest.mark.parametrize("batch", [300, 2 << 20])
def test_repeated_windows(spark, monkeypatch, batch):
    monkeypatch.setattr(repeated_windows, "BATCH_BYTES", batch)
    monkeypatch.setattr(repeated_windows, "PART_BYTES", 4_000)
    rng = random.Random(11)
    passages = [words(rng, 40) for _ in range(6)]
    rows = [row for row in awkward_rows() if len(row[1] or "") < 20_000]
    for n in range(60):
        parts = [rng.choice(passages)[rng.randrange(60) :] if rng.random() < 0.6 else words(rng, 15) for _ in range(rng.randint(1, 5))]
        rows.append((100 + rng.randrange(10**6), " ".join(parts), None, None, None))
    rows += [(50, "ab" * 400, None, None, None), (51, "-" * 500, None, None, None), (52, ("line of text, " * 9 + "\n") * 12, None, None, None)]
    rng.shuffle(rows)
    for window in (100, 64, 150):
        got = repeats_of(frame(spark, rows, True).repartition(5), window)
        assert sorted(got, key=ORDERED) == sorted(brute_repeats(rows, window), key=ORDERED)


def test_repeated_windows_edges(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, []), window=50)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = random.Random(9)
    rows = awkward_rows() + [(100 + n, words(rng, rng.randint(0, 900)), None, None, None) for n in range(150)]
    docs = frame(spark, rows, True)
    got = pack_documents(docs, path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in got:
        assert row["length"] * 4 == len(row["ids"]) and 1 <= row["length"] <= 4096
        by_doc[row["doc_id"], row["doc_tokens"], row["start"]].append(bytes(row["ids"]))
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        for start in range(0, len(ids), 4096):
            want[doc_id, len(ids), start, ids[start : start + 4096].tobytes()] += 1
    assert Counter((*key, ids) for key, pieces in by_doc.items() for ids in pieces) == want
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    digests = Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in pack_documents(docs, path, digest=True).collect())
    assert digests == Counter((key[0], key[2], zlib.crc32(key[3])) for key in want.elements())


def test_packing_empty(spark):
    assert pack_documents(frame(spark, []), tokenizer_file("word_bpe_49k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_shortest_pack_first(histogram):
    patterns = shortest_pack_first(histogram, 64)
    placed = Counter()
    for pattern, packs in patterns.items():
        assert sum(pattern) <= 64 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            placed[length] += packs
    assert placed == Counter(histogram)
    assert len(patterns) <= 2 * max(len(histogram), 1)


def test_pack_keeps_columns(spark):
    pieces = spark.range(500).select(F.col("id").alias("n"), (F.col("id") % 60 + 1).alias("length"), F.lit("x").alias("_rank"), F.lit(1).alias("offset"))
    got = pack(pieces, ["n"], most=64)
    assert got.columns == ["n", "length", "_rank", "sequence_id", "offset"] and got.count() == 500


def test_word_encoder_is_exact():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    encode = word_encoder(path)
    for text in ["It's 'tis don't! (word) a_b x1y2 ...", "ÀÉß ſtraße É", "a\x1cb\x85c", "İstanbul ΣΑΣ", "naïve “q” 中文", "<|endoftext|> hi",
                 "é combining", "'Tis the'll we'd", '"Hello," she-said.', "a--b __c__ $5.00 50%", "nb\xa0sp", "\x00\x01", "l'été ŉ ĳ"]:
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encode(text) == want, text


def naive_bits(text, counts, alphabet):
    """PPM-C with exclusion over symbols, recursively."""
    data = [0] * 0
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    data = [alphabet[b] for b in b"\n" * ORDER + text.encode().translate(fold)]

    def spread(context):
        if context is None:
            return [1 / SYMBOLS] * SYMBOLS
        shorter = spread(context[1:] if context else None)
        seen = counts.get(tuple(context), {})
        if not seen:
            return shorter
        n, d = sum(seen.values()), len(seen)
        rest = sum(p for s, p in enumerate(shorter) if s not in seen)
        if rest <= 1e-12:
            return [seen.get(s, 0) / n for s in range(SYMBOLS)]
        return [seen[s] / (n + d) if s in seen else d / (n + d) * shorter[s] / rest for s in range(SYMBOLS)]

    return sum(-math.log2(spread(data[at - ORDER : at])[data[at]]) for at in range(ORDER, len(data)))


def test_ppm_code_lengths():
    rng = random.Random(1)
    texts = {"xx": words(rng, 60) + " Été", "yy": "the cat and the hat sat on the mat. " * 5}
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    grams = Counter()
    for label, text in texts.items():
        data = b"\n" * ORDER + text.encode().translate(fold)
        for at in range(len(data) - ORDER):
            grams[label, int.from_bytes(data[at : at + ORDER + 1], "big")] += 1
    model = build_model([(label, gram, n) for (label, gram), n in grams.items()])
    assert model.languages == ["xx", "yy"]
    asked = ["the hat", "abcde fgh", "Zz9! été", "a"]
    got = code_lengths(asked, model)
    for which, label in enumerate(model.languages):
        counts = defaultdict(Counter)
        for (own, gram), n in grams.items():
            if own == label:
                symbols = [int(model.symbol[b]) for b in gram.to_bytes(ORDER + 1, "big")]
                for depth in range(ORDER + 1):
                    counts[tuple(symbols[ORDER - depth : ORDER])][symbols[-1]] += n
        for text, row in zip(asked, got):
            assert row[which] == pytest.approx(naive_bits(text, counts, model.symbol), rel=1e-4)


def test_language_edges(spark, monkeypatch):
    rows = awkward_rows()
    docs = frame(spark, rows)
    model = fit(docs, "doc_id", "text", "lang")
    got = predict(docs.withColumnRenamed("source", "score"), model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    for row in got:
        if row["text"] is None or not any(map(str.isalpha, row["text"])):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] in ("en", "fr") and 0.5 <= row["score"] <= 1.0
    monkeypatch.setattr(language_ppm, "BYTES_AT_A_TIME", 1000)
    texts = [row[1] or "" for row in rows]
    small = code_lengths(texts, model)
    monkeypatch.setattr(language_ppm, "BYTES_AT_A_TIME", 1 << 21)
    assert np.allclose(small, code_lengths(texts, model), rtol=1e-6)
    empty = frame(spark, [])
    assert fit(empty, "doc_id", "text", "lang") is None
    assert {r["lang_pred"] for r in predict(docs, None).collect()} == {"und"}
    assert predict(empty, model).count() == 0
    ids = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(d).encode() if d is not None else b"") % 4 == 2) for d, h in ids.items())


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.filter(~held_out()), "doc_id", "text", "lang")
    said = predict(docs.filter(held_out()), model)
    assert said.filter("lang_pred = lang").count() / said.count() > 0.99


def sliding(rng, count, width=104, step=8):
    """Versions of which only neighbours reach a similarity of 0.8."""
    text = words(rng, width + step * count).split()
    return [" ".join(text[at * step : at * step + width]) for at in range(count)]


@pytest.mark.parametrize("local", [0, 2_000_000])
def test_near_duplicates_of_large_components(spark, monkeypatch, local):
    monkeypatch.setattr(near_copies, "LOCAL_SHINGLES", local)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 1_000)
    rng = random.Random(21)
    texts = sliding(rng, 40) + list(variants(rng, words(rng, 150), 45, 6))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8]
    assert not any(b - a > 1 for a, b in pairs if b < 40)
    root = closed(ids, [(ids[a], ids[b]) for a, b in pairs])
    rows = [(i, text, None, None, None) for i, text in zip(ids, texts)]
    got = {r["doc_id"]: r["keep_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    shared = Counter(root.values())
    assert got == {i: top for i, top in root.items() if shared[top] > 1}


def test_near_duplicates_with_repeated_lines(spark):
    rng = random.Random(31)
    rows = []
    for group in range(4):
        text, line = words(rng, 300), words(rng, 8)
        texts = [" ".join([text, *[line] * times]) for times in (3, 20, 50, 200)]
        assert all(jaccard(texts[0], other) == 1.0 for other in texts)
        rows += [(group * 10 + n, other, None, None, None) for n, other in enumerate(texts)]
    got = {r["doc_id"]: r["keep_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == {row[0]: row[0] // 10 * 10 for row in rows}


def test_near_duplicates_at_the_threshold(spark):
    """Short texts and texts just above the similarity, whose fingerprints may be far apart."""
    rng = random.Random(41)
    rows, want = [], {}
    for group in range(120):
        size = rng.choice([9, 9, 19, 54, 204])
        text = words(rng, size).split()
        count = len(text) - 4
        cut = text[: 4 + math.ceil(0.8 * count)] if group % 2 else text[: 4 + math.ceil(0.8 * count) - 1]
        rows += [(group * 2, " ".join(text), None, None, None), (group * 2 + 1, " ".join(cut), None, None, None)]
        if jaccard(rows[-1][1], rows[-2][1]) >= 0.8:
            want |= {group * 2: group * 2, group * 2 + 1: group * 2}
    assert len(want) == 120
    got = {r["doc_id"]: r["keep_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def grams_of(texts):
    grams = Counter()
    for label, text in texts.items():
        data = b"\n" * ORDER + text.encode()
        for at in range(len(data) - ORDER):
            grams[label, int.from_bytes(data[at : at + ORDER + 1], "big")] += 1
    return [(label, gram, n) for (label, gram), n in grams.items()]


def test_ppm_keeps_every_context():
    """Fifty languages: none of the contexts of order 3 falls out of the model."""
    rng = random.Random(51)
    grams = grams_of({f"l{n}": words(rng, 400) for n in range(50)})
    model = build_model(grams)
    contexts = {gram >> 8 for _, gram, _ in grams}
    depth = lambda row: 0 if model.suffix[row] < 0 else 1 + depth(model.suffix[row])
    for gram in contexts:
        number = 0
        for byte in gram.to_bytes(ORDER, "big"):
            number = number * model.base + int(model.symbol[byte])
        assert depth(int(model.row_of[number])) == ORDER
    assert len(contexts) > 655


def test_ppm_rare_label_and_script(spark):
    rng = random.Random(52)
    wide = "".join(chr(c) for c in range(0x80, 0x800, 3))
    rows = [(n, words(rng, 60) + " " + "".join(rng.sample(wide, 40)), f"big{n % 2}", None, None) for n in range(200)]
    rows += [(300, "".join(map(chr, range(33, 127))).lower(), "big0", None, None)]
    rows += [(900, "ማንኛውም ሰው በሕይወት የመኖር", "zz", None, None), (901, "မြန်မာ ဘာသာ စကား", "zy", None, None)]
    docs = frame(spark, rows)
    model = fit(docs, "doc_id", "text", "lang")
    assert model.languages == ["big0", "big1", "zy", "zz"]
    used = {byte for row in rows for byte in row[1].encode()}
    assert len({int(model.symbol[byte]) for byte in used}) == len(used) > 127
    asked = frame(spark, [(1, "ሰው በሕይወት", None, None, None), (2, "ဘာသာ", None, None, None)])
    assert {r["doc_id"]: r["lang_pred"] for r in predict(asked, model).collect()} == {1: "zz", 2: "zy"}


def test_repeats_are_not_removed_on_a_made_collision(spark):
    """Two grams that one fixed hash could be made to confuse; and keys that differ from run to run."""
    one, two = "ri5p.UXL mZdMSaU", "GoLj1k7J<0%<ryUI"
    rng = random.Random(61)
    rows = []
    for place in range(6):
        left, right = words(rng, 40)[: 16 * place + 2], words(rng, 40)[: 82 - 16 * place]
        rows += [(10 * place + n, left + middle + right, None, None, None) for n, middle in enumerate((one, two, one[:8] + two[8:], two[:8] + one[8:]))]
    assert all(len(row[1]) == 100 for row in rows)
    got = remove_repeats(frame(spark, rows)).collect()
    assert [(row["n_removed"], len(row["spans"])) for row in got] == [(0, 0)] * len(rows)
    twice = [(row[0] + n * 1000, row[1], None, None, None) for row in rows for n in (0, 1)]
    assert sorted(row["doc_id"] for row in remove_repeats(frame(spark, twice)).collect() if row["n_removed"] == 100) == sorted(row[0] + 1000 for row in rows)
    first, second = repeated_windows.drawn_keys(), repeated_windows.drawn_keys()
    assert first.shape == second.shape and not (first == second).any()


def test_words_of_letters_have_the_tokenizers_ids():
    encode = word_encoder(tokenizer_file("word_bpe_49k.json"))
    whole = sys.__dict__["_word_encoders"][tokenizer_file("word_bpe_49k.json")].encoded
    assert sys.__dict__["_word_encoders"][tokenizer_file("word_bpe_49k.json")].by_bytes
    letters = [chr(c) for c in range(0x180) if packing._PLAIN.fullmatch(chr(c))]
    for char in letters:
        for text in (char, f"a{char}b", f'"{char}x".', char * 3):
            assert encode(text) == whole(text)


def test_words_are_stored_when_they_come_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    monkeypatch.setattr(sys, "_word_encoders", {}, raising=False)
    path = tokenizer_file("word_bpe_49k.json")
    encode = word_encoder(path)
    words = sys.__dict__["_word_encoders"][path]
    once = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    first = [encode(word) for word in once]
    assert len(words) + len(words.old) < 5  # words whose marks fell together
    assert [encode(word) for word in once] == first == [words.encoded(word) for word in once]
    assert len(words) <= 50 and len(words.old) == 50


def test_scored_pieces_are_small():
    rows = [(f"l{k}", a << 24 | b << 16 | c << 8 | d, 1 + k) for k in range(4) for a in range(97, 100) for b in range(97, 100) for c in range(97, 100) for d in range(97, 100)]
    model, text = build_model(rows), "abcab" * 400_000
    tracemalloc.start()
    try:
        code_lengths([text], model)
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()


def test_small_tables_start_no_workers(spark):
    kinds = {"one": pa.int32(), "two": pa.int64()}
    table = small_table(spark, [(1, 2), (3, 4)], kinds)
    assert table.dtypes == [("one", "int"), ("two", "bigint")] and {tuple(row) for row in table.collect()} == {(1, 2), (3, 4)}
    assert small_table(spark, [], kinds).count() == 0
    marks = spark.range(100).select((F.col("id") * 7919).alias("fingerprint"))
    plan = simhash_tiles.near_links(marks, 3)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_first_digits_are_the_anchor_and_the_gram_beside_it():
    """a passage too short for a repeat no longer makes records of all windows around it; stretches hold each window once."""
    random = np.random.default_rng(5)
    keys = repeated_windows.drawn_keys()

    def digits(passage: bytes, seed: int) -> tuple[set, set]:
        text = bytes(np.random.default_rng(seed).integers(97, 123, 400, dtype=np.uint8))
        batch = repeated_windows.Batch([(0, 0, text[:200] + passage + text[200:])], 100, keys)
        found = batch.anchors()
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(found["first"], found["last"])])
        assert sorted(starts.tolist()) == list(range(batch.size - 99))
        before = found["last"] < found["at"] - 36
        low = np.where(before, found["at"] - 32, found["at"])
        assert (low >= found["last"]).all() and (low + 64 <= found["first"] + 100).all()
        return set(batch.digits(found).tolist()), set(batch.grams[found["at"]].tolist())

    short, long = (bytes(random.integers(97, 123, size, dtype=np.uint8)) for size in (60, 150))
    (one, gram), (other, same) = digits(short, 1), digits(short, 2)
    assert gram & same and not one & other
    assert digits(long, 1)[0] & digits(long, 2)[0]
