"""Exact dedup, mixing and sharding against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clinspark.llm.common import utf8
from clinspark.llm.exact_dedup import exact_dedup
from clinspark.llm.license_scan import license_scan
from clinspark.llm.mixing import mix_sources, word_count
from clinspark.llm.sharding import shard_records
from tests.llm.cases import awkward_rows, frame


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_dedup(spark, clashing):
    rows = awkward_rows()
    docs = frame(spark, rows, clashing)
    result = exact_dedup(docs, hash_all=True)
    assert set(docs.columns) <= set(result.columns)
    got = result.select("doc_id", "keep_id", "group_size", "kept", "full_hash").collect()
    groups = defaultdict(list)
    for row in rows:
        groups[norm(row[1])].append(row[0])
    want = []
    for row in rows:
        members = groups[norm(row[1])]
        ids = [x for x in members if x is not None]
        keep = min(ids) if ids else None
        want.append((row[0], keep, len(members), row[0] == keep, hashlib.sha256(norm(row[1]).encode()).hexdigest()))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("hash_all", [False, True])
def test_exact_dedup_without_texts(spark, hash_all):
    docs = frame(spark, awkward_rows(), True)
    columns = ("doc_id", "lang", "keep_id", "group_size", "kept", "full_hash")
    whole = exact_dedup(docs, hash_all=hash_all)
    narrow = exact_dedup(docs, hash_all=hash_all, with_text=False)
    assert set(narrow.columns) == set(whole.columns) - {"text"}
    assert Counter(map(tuple, narrow.select(*columns).collect())) == Counter(map(tuple, whole.select(*columns).collect()))


def test_exact_dedup_hot_group(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("text "), "id")).alias("text")
    )
    got = exact_dedup(docs)
    assert got.filter("kept").count() == 2001
    assert got.filter("keep_id = 0").count() == 1000


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact_dedup(empty).count() == 0
    assert shard_records(empty).count() == 0
    assert mix_sources(empty.withColumn("size", word_count("text")), F.lit(1.0)).count() == 0
    assert license_scan(empty).count() == 0


def water_fill(sizes, weights, share, most):
    target = dict.fromkeys(sizes, 0.0)
    free = share * sum(sizes.values())
    while free > 1e-9:
        open_ = [s for s in sizes if target[s] < most * sizes[s] - 1e-9]
        if not open_:
            break
        unit = free / sum(weights[s] for s in open_)
        free = 0.0
        for s in open_:
            want = target[s] + unit * weights[s]
            target[s] = min(want, most * sizes[s])
            free += want - target[s]
    return target


@pytest.mark.parametrize("clashing", [False, True])
def test_mixing(spark, clashing):
    rows = awkward_rows()
    docs = frame(spark, rows, clashing).drop("size").withColumn("size", word_count("text"))
    mixed = mix_sources(docs, F.lit(1.0))
    got = mixed.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3.0, 1.0, 2.0)[n % 3] for n, s in enumerate(order)}
    targets = water_fill(sizes, weights, 1.5, 2.0)
    taken, largest = Counter(), Counter()
    for row in got:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(targets[row["source"]])
        assert row["taken"] <= 2 * row["size"]
        taken[row["source"]] += row["taken"]
        largest[row["source"]] = max(largest[row["source"]], row["size"])
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= largest[source]
    again = mix_sources(docs.repartition(5), F.lit(1.0)).select("doc_id", "source", "size", "source_size", "target", "taken")
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mixing_prefers_quality(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"),
        F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("quality"),
    )
    # Source a has the larger weight; b gets what is left and is sampled within one epoch.
    got = mix_sources(docs, F.col("quality"), weights=(3.0, 1.0), share=0.8).filter("source = 'b'")
    good, bad = (got.filter(f"quality = {q}").agg(F.avg("copies")).first()[0] for q in (4.0, 1.0))
    assert good > 1.5 * bad > 0


@pytest.mark.parametrize("clashing", [False, True])
def test_sharding(spark, clashing):
    rows = awkward_rows() + [(n, f"t{n}", None, None, None) for n in range(100, 1100)]
    docs = frame(spark, rows, clashing).withColumn("bytes", F.length(utf8("text")))
    got = shard_records(docs, order=["doc_id", "bytes"]).select("doc_id", "shard", "slot", "grown_shard").collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    by_key = {}
    for row in got:
        slots[row["shard"]].append(row["slot"])
        assert by_key.setdefault(row["doc_id"], row["shard"]) == row["shard"]
        assert row["grown_shard"] in (row["shard"], 8)
    assert all(sorted(values) == list(range(len(values))) for values in slots.values())
    moved = sum(row["grown_shard"] == 8 for row in got)
    assert 0.06 < moved / len(got) < 0.17
    counts = Counter(row["shard"] for row in got)
    assert set(counts) == set(range(8)) and max(counts.values()) < 2 * min(counts.values())


def test_sharding_weights(spark):
    docs = spark.range(20000).withColumnRenamed("id", "doc_id")
    counts = {r["shard"]: r["count"] for r in shard_records(docs, weights=[1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and 2.7 < counts[1] / counts[0] < 3.3
    with pytest.raises(ValueError):
        shard_records(docs, weights=[0.0])


def dice(one, two):
    def grams(text):
        w = re.sub(r"[^\w]+|_", " ", text.lower()).split()
        return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)

    a, b = grams(one), grams(two)
    return 2 * sum((a & b).values()) / max(sum(a.values()) + sum(b.values()), 1)


def test_license_scan(spark):
    templates = (("X", "Licensed under the X license, version 2."), ("Y", "a b a b a b a b a c"), ("Z", "Zed"))
    units = ["licensed UNDER the x licence version 2", "Licensed under the X license, version 2!", "a b a b a b a b a b a c", "zed", "nothing here", ""]
    rows = [(n, text, None, None, None) for n, text in enumerate(units)] + [(50, "\n".join(units), None, None, None), (51, None, None, None, None)]
    rows += awkward_rows()
    got = license_scan(frame(spark, rows, True), threshold=0.7, templates=templates).collect()
    want = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        parts = list(enumerate(lines, 1)) + ([(0, text)] if len(lines) > 1 else [])
        for line, unit in parts:
            for number, (name, template) in enumerate(templates):
                score = dice(unit, template)
                if score >= 0.7:
                    want.append((doc_id, line, number, name, round(score, 9)))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(*r[:4], round(r[4], 9)) for r in map(tuple, got)], key=key) == sorted(want, key=key)
    assert len(want) >= 5
