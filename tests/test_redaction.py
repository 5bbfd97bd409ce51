"""Boxes made beside their page against those of the table form, and what the queries shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import redaction as checks
from clinspark.functions.text import running_sums
from clinspark.operators import redaction
from clinspark.plans.redact import redact_boxes

SMALL = "/root/testdata/sf0.001"
ITEMS = "doc_id long, page int, idx long, str string, x double, y double, w double, h double, has_eol boolean"


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", ["redaction_boxes", "redaction_summary"])
def test_items_are_not_shuffled(spark, name):
    """An item table takes some 25 bytes a word in every exchange; texts with their targets take a tenth of it."""
    plan = checks.CHECKS[name].query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Window" in line or "_part" in line or "_stretch" in line]
    assert moved == []


def test_boxes_agree_with_the_table_form(spark):
    odd = [
        (1, 0, 3, "Jan", 0.0, 1.0, 30.0, 10.0, False), (1, 0, 1, None, 0.0, 1.0, 5.0, 10.0, True),
        (1, 0, 2, "jan smit JAN", None, 1.0, 0.0, 10.0, None), (1, 0, 4, "Smit", 9.0, 1.0, None, None, True),
        (1, 0, 5, "", 9.0, 1.0, 1.0, 1.0, False), (1, 0, 6, "é😀jan", float("nan"), 1.0, 7.0, 10.0, True),
        (1, 1, 1, "", 0.0, 0.0, 0.0, 0.0, False), (2, 0, 1, "Jan", 0.0, 0.0, 1.0, 1.0, True), (3, 5, 1, "x" * 30, 1.0, 1.0, 1.0, 1.0, True),
    ]
    long = [(4, 0, n, f"w{n % 7}", 1.0 * n, 2.0, 3.0 if n % 3 else None, 4.0, n % 50 == 0) for n in range(3000)]
    items = spark.createDataFrame(odd + long, ITEMS)
    named = [(1, "jan"), (1, " Jan smit "), (1, "😀J"), (1, "J"), (1, "jan"), (3, "xx"), (4, "w3 W4"), (4, "w1"), (9, "none")]
    targets = spark.createDataFrame(named, "doc_id long, target string")
    done = redact_boxes(items, targets)
    segments, pages = redaction.positioned_segments(items)
    hits = redaction.locate_targets(pages, targets)
    assert rows(done.hits.select(hits.columns)) == rows(hits)
    boxes = redaction.hits_to_boxes(hits, segments)
    assert rows(done.boxes.select(boxes.columns)) == rows(boxes) and done.boxes.count() > 1000
    assert dict(done.boxes.dtypes) == dict(boxes.dtypes)
    summary = {r["doc_id"]: tuple(r)[1:] for r in done.summary.collect()}
    assert summary[2] == (1, 0, 1, 0, 0) and summary[1][3] == 3 and summary[3] == (1, 1, 0, 1, 15) and summary[1][0] == 2


def test_query_pages_are_the_item_table(spark):
    made = checks.page_rows(spark, SMALL).select("doc_id", "page", "items")
    assert rows(made) == rows(redaction.gathered(checks.items(spark, SMALL)))


def test_running_sums(spark):
    sizes = [[], [5], [0, 0, 3], list(range(1000))]
    got = spark.createDataFrame([(s,) for s in sizes], "s array<int>").select(running_sums(F.col("s"))).collect()
    assert [r[0] for r in got] == [[sum(s[:n]) for n in range(len(s))] for s in sizes]
