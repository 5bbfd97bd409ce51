"""Bit-sliced top-k, WARC archives and the loser-tree merge against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinspark.llm import warc_index
from clinspark.llm.bit_sliced_topk import SlicedBlock, top_k
from clinspark.llm.warc_index import LoserTree, capture_histories, merged, parsed, record, url_key

VECTORS = "vec_id long, embedding array<float>, label int, score string, id string, v string, block string"


def brute_top(rows, is_query, k):
    ready = []
    for vec_id, vector in rows:
        if vec_id is None or vector is None or not vector or any(x is None or not np.isfinite(x) for x in vector):
            continue
        ready.append((vec_id, np.floor(256 * np.float32(vector).astype(np.float64)).astype(np.int64)))
    queries = {}
    for vec_id, q in ready:
        if is_query(vec_id):
            queries[vec_id] = min(queries.get(vec_id, q.tolist()), q.tolist())
    want = []
    for vec_id, q in queries.items():
        scored = sorted(
            (-int(np.dot(q, v)), other) for other, v in ready if other != vec_id and len(v) == len(q)
        )[:k]
        want += [(vec_id, rank, other, -score) for rank, (score, other) in enumerate(scored, 1)]
    return sorted(want)


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(n, [rng.uniform(-1, 1) for _ in range(8)]) for n in range(700)]
    rows += [(1000 + n, [0.5] * 8) for n in range(300)]  # a vector that a third of the rows have
    rows += [(5000, None), (5010, [0.1, None] * 4), (5020, [float("nan")] * 8), (5030, [float("inf")] * 8), (5040, [])]
    rows += [(None, [0.5] * 8), (10, [0.25] * 8), (20, rows[20][1]), (6000, [3.0, -2.0]), (6001, [1.0, 0.0])]
    rows += [(7000, [0.0] * 8), (7010, [-200.0] + [0.0] * 7)]
    data = [(*row, None, "x", "x", "x", "x") for row in rows]
    df = spark.createDataFrame(data, VECTORS).repartition(7)
    got = top_k(df, F.col("vec_id") % 10 == 0, k=5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute_top(rows, lambda x: x % 10 == 0, 5)


def test_top_k_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)
    assert sorted(map(tuple, top_k(two, F.lit(True)).collect())) == [(1, 1, 2, 131072), (2, 1, 1, 131072)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 6), st.integers(1, 9), st.integers(0, 2**32 - 1), st.integers(1, 400))
def test_sliced_block(rows, width, k, seed, span):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(rows * 3)[:rows]
    values = rng.integers(-span, span + 1, (rows, width))
    weights = rng.integers(-span, span + 1, width)
    exclude = int(ids[0])
    best, scores = SlicedBlock(ids, values).top(weights, k, exclude)
    want = sorted((-int(v @ weights), int(i)) for i, v in zip(ids, values) if i != exclude)[:k]
    assert sorted(zip((-scores).tolist(), best.tolist())) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), min_size=0, max_size=9))
def test_loser_tree(lists):
    runs = [sorted(items) for items in lists]
    spots = [0] * len(runs)
    tree = LoserTree([run[0] if run else None for run in runs])
    out = []
    while tree.winner != -1 and tree.heads[tree.winner] is not None:
        best = tree.winner
        out.append((runs[best][spots[best]], best))
        spots[best] += 1
        tree.advance(runs[best][spots[best]] if spots[best] < len(runs[best]) else None)
    assert out == sorted((x, n) for n, run in enumerate(runs) for x in run)


def test_merge_in_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(warc_index, "BATCH_ROWS", 7)
    rng = random.Random(5)
    paths, everything = [], []
    for number in range(9):
        keys = sorted(f"{rng.randint(0, 300):04d}" for _ in range(rng.randint(0, 120)))
        everything += keys
        path = str(tmp_path / f"{number}.parquet")
        pq.write_table(pa.table({"key": pa.array(keys, pa.string()), "n": [number] * len(keys)}), path, row_group_size=20)
        paths.append(path)
    bounds = [None, "0100", "0100", "0217", None]
    got = [key for low, high in zip(bounds, bounds[1:]) for batch in merged(paths, low, high) for key in batch["key"].to_pylist()]
    assert got == sorted(everything)


def test_record_round_trip():
    payload = "<p>é</p>\r\n\r\nWARC/1.1\r\n".encode()
    whole = record(7, "http://a.example/x y\r\nEvil: 1", "2024-01-01T00:00:00Z", payload, warc_index.base32_sha1(payload), None)
    row = parsed(whole)
    assert (row["page_id"], row["payload_bytes"], row["record_type"], row["refers_to"]) == (7, len(payload), "response", None)
    assert row["url"] == "http://a.example/x%20y%0D%0AEvil:%201"
    broken = whole.replace("é".encode(), b"ee")
    with pytest.raises(ValueError):
        parsed(broken)


def test_url_key():
    assert url_key("HTTP://www.Example.com:80/A/b?Q=1#top") == "com,example)/a/b?q=1"
    assert url_key("https://m.example.org:8443") == "org,example,m:8443)/"
    assert url_key("") == ")/"


@pytest.mark.parametrize("fan_in", [2, 64])
def test_capture_histories(spark, monkeypatch, fan_in):
    monkeypatch.setattr(warc_index, "FAN_IN", fan_in)
    monkeypatch.setattr(warc_index, "RANGE_ROWS", 40)
    monkeypatch.setattr(warc_index, "ARCHIVE_BYTES", 2_000)
    rng = random.Random(2)
    pages = [(n, f"http://h{rng.randint(0, 9)}.example.com/{rng.randint(0, 3)}", rng.choice(["same", "", None, f"page {n}"])) for n in range(300)]
    pages += [(300 + n, "http://hot.example.com/", "same") for n in range(100)] + [(None, None, "page x"), (5, "http://again", pages[5][2])]
    df = spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id long, url string, html string, key string, digest string").repartition(6)
    result = capture_histories(df, F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))))
    rows = result.select("part", "key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset").collect()
    by_part = sorted(rows, key=lambda r: r["part"])  # stable: the order inside a part stays
    assert [r["key"] for r in by_part] == sorted(r["key"] for r in rows)
    largest = {}
    for page, _, html in pages:
        if page is not None:
            largest[html or ""] = max(largest.get(html or "", page), page)
    want = []
    for page, _, html in pages:
        first = largest.get(html or "")
        again = page != first
        data = (html or "").encode()
        want.append((page, len(data), warc_index.base32_sha1(data), "revisit" if again else "response", first if again else None))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r)[2:7] for r in rows), key=key) == sorted(want, key=key)
    assert len({(r["archive"], r["offset"]) for r in rows}) == len(pages)


def test_capture_histories_empty_and_least(spark):
    schema = "page_id long, url string, html string"
    stamp = F.lit("2024-01-01").cast("timestamp")
    assert capture_histories(spark.createDataFrame([], schema), stamp).count() == 0
    few = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], schema)
    kinds = {r["page_id"]: r["record_type"] for r in capture_histories(few, stamp, least_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_top_k_refuses_components_outside_int32(spark):
    vectors = spark.createDataFrame([(1, [2.0**23, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="outside int32"):
        top_k(vectors, F.lit(True)).collect()
