"""Boxes that cover target texts on pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.operators.redaction import (
    PAGE,
    boxes_on_pages,
    gathered,
    located,
    page_string,
    redaction_summary,
    targets_by_document,
)


@dataclass(frozen=True)
class Redaction:
    boxes: DataFrame
    hits: DataFrame
    summary: DataFrame


def redact_pages(pages: DataFrame) -> Redaction:
    """Boxes, hits and a summary per document for rows (doc_id, page, items, targets): a page with its
    positioned items in order and the distinct targets of its document (``targets_by_document``; NULL if
    it has none). A page is one row and stays where it is; only the counts of the summary are shuffled.
    """
    items, targets = F.col("items"), F.col("targets")
    hits = located(page_string(items), targets)
    boxes = boxes_on_pages(pages.select(*PAGE, "items", hits.alias("hits")))
    texts = pages.select(*PAGE, "targets", page_string(items).alias("text"))
    counted = texts.withColumn("hits", F.array_size(located(F.col("text"), targets)))
    return Redaction(boxes, pages.select(*PAGE, F.inline(hits)), redaction_summary(counted))


def redact_boxes(items: DataFrame, targets: DataFrame) -> Redaction:
    """The same for a table of positioned ``items`` and one of per-document targets."""
    return redact_pages(gathered(items).join(targets_by_document(targets), "doc_id", "left"))
