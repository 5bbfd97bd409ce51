"""Positioned page text: page strings, target hits, and the boxes that cover them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.fixed_values import BOX_PADDING
from clinspark.functions.signals import page_kind
from clinspark.functions.text import let, quoted, running_sums, trim_spaces
from clinspark.operators.ordering import join_ordered

PAGE = ["doc_id", "page"]
OFFSET_BUCKET = 256


def page_text(items: DataFrame) -> DataFrame:
    """(doc_id, page, text) from positioned items (``idx``, ``str``, ``y``, ``has_eol``).

    A vertical move of more than one unit starts a line; otherwise neighbours are separated by one
    space unless one side brings it. What precedes an item is known from the item before it: its
    line-end flag or its last character, so a window over the page's items suffices. An empty item
    passes on the end of what came before it.
    """
    order = Window.partitionBy(*PAGE).orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    text = F.coalesce("str", F.lit(""))
    ending = F.when(F.coalesce("has_eol", F.lit(False)), "\n").otherwise(
        F.when(F.length(text) > 0, F.substring(text, -1, 1))
    )
    marked = (
        items.withColumn("_text", text)
        .withColumn("_moved", F.abs(F.col("y") - F.lag("y").over(order)) > 1)
        .withColumn("_ending", ending)
    )
    # A line break inserted before an empty item also ends what came before the next item.
    marked = marked.withColumn(
        "_tail",
        F.coalesce("_ending", F.when(F.col("_moved"), "\n")),
    ).withColumn("_before", F.last("_tail", ignorenulls=True).over(before))
    gap = (
        F.when(F.coalesce("_moved", F.lit(False)), "\n")
        .when(
            F.col("_before").isNotNull()
            & (F.col("_before") != " ")
            & (F.col("_text") != "")
            & ~F.startswith("_text", F.lit(" ")),
            " ",
        )
        .otherwise("")
    )
    line_end = F.when(F.coalesce("has_eol", F.lit(False)), "\n").otherwise("")
    parts = marked.withColumn("_part", F.concat(gap, F.col("_text"), line_end))
    pages = join_ordered(parts, PAGE, ["idx"], "_part", "", "text")
    return pages.withColumn("text", trim_spaces("text"))


def document_text(pages: DataFrame) -> DataFrame:
    """Pages of a document joined by a blank line."""
    return join_ordered(pages, ["doc_id"], ["page"], "text", "\n\n", "text")


def positioned_segments(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(segments, pages)``: offsets of every non-empty item in the joined page string, and that
    string. Items are followed by a line break at a line end, else by a space; empty items leave only
    their line break. A missing width is estimated from height and length."""
    text = F.coalesce("str", F.lit(""))
    eol = F.coalesce("has_eol", F.lit(False))
    size = F.length(text)
    taken = F.when(size > 0, size + 1).otherwise(F.when(eol, 1).otherwise(0))
    upto = Window.partitionBy(*PAGE).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        items.withColumn("_text", text)
        .withColumn("_size", size)
        .withColumn("start", (F.sum(taken).over(upto) - taken).cast("int"))
        .withColumn("end", F.col("start") + F.col("_size"))
    )
    width = F.coalesce(
        F.nullif(F.col("w"), F.lit(0.0)), F.col("h") * F.col("_size") * F.lit(0.5)
    )
    segments = placed.filter("_size > 0").select(
        *PAGE, F.col("idx").alias("seg_idx"), "start", "end", "x", "y", width.alias("w"), "h"
    )
    part = F.when(size > 0, F.concat(text, F.when(eol, "\n").otherwise(" "))).otherwise(
        F.when(eol, "\n").otherwise("")
    )
    pages = join_ordered(items.withColumn("_part", part), PAGE, ["idx"], "_part", "", "text")
    return segments, pages


def with_page_kind(pages: DataFrame) -> DataFrame:
    return pages.withColumn("kind", page_kind("text"))


def clean_targets(targets: DataFrame) -> DataFrame:
    """Distinct (doc_id, target) with at least two characters after trimming."""
    return (
        targets.select("doc_id", "target").distinct().filter(F.length(trim_spaces("target")) >= 2)
    )


def targets_by_document(targets: DataFrame) -> DataFrame:
    """(doc_id, targets): the distinct targets of a document in one array."""
    return clean_targets(targets).groupBy("doc_id").agg(F.collect_list("target").alias("targets"))


def located(text: Column, targets: Column) -> Column:
    """(target, start, end) of all case-insensitive, non-overlapping occurrences in one page string.

    Unlike the text rewrite there is no word boundary. The text between occurrences comes from one
    ``split`` on the quoted target, so an occurrence ends at a running sum of lengths.
    """

    def occurrences(lowered: Column, item: Column) -> Column:
        size = F.length(item["needle"])
        gaps = F.split(lowered, quoted(item["needle"]), -1)
        upto = running_sums(F.transform(gaps, lambda gap: F.length(gap) + size))
        return let(
            upto,
            lambda ends: F.transform(
                F.slice(ends, F.lit(2), F.size(ends)),
                lambda end: F.struct(item["target"].alias("target"), (end - size).alias("start"), end.alias("end")),
            ),
        )

    needles = F.transform(
        targets, lambda target: F.struct(target.alias("target"), F.lower(trim_spaces(target)).alias("needle"))
    )

    def of_all(lowered: Column) -> Column:
        present = F.filter(needles, lambda item: F.contains(lowered, item["needle"]))
        return F.flatten(F.transform(present, lambda item: occurrences(lowered, item)))

    return let(F.lower(text), of_all)


def locate_targets(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, page, target, start, end) of what ``located`` finds. Pages and targets meet on the
    document; hits are made beside the text and never shuffled."""
    found = pages.join(targets_by_document(targets), "doc_id")
    return found.select(*PAGE, F.inline(located(F.col("text"), F.col("targets"))))


# --- pages as rows with their items beside them ----------------------------------------------------
ITEM = ("idx", "str", "x", "y", "w", "h", "has_eol")


def gathered(items: DataFrame) -> DataFrame:
    """(doc_id, page, items): an item table with a page's items in one array, in order."""
    item = F.struct(*[F.col(name) for name in ITEM])
    return items.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("items"))


def page_string(items: Column) -> Column:
    """The page string of ``positioned_segments``."""

    def part(item: Column) -> Column:
        text = F.coalesce(item["str"], F.lit(""))
        return F.concat(text, F.when(item["has_eol"], "\n").when(item["str"] != "", " ").otherwise(""))

    return F.array_join(F.transform(items, part), "")


def boxes_on_pages(pages: DataFrame, padding: float = BOX_PADDING) -> DataFrame:
    """The boxes of ``hits_to_boxes`` for rows (doc_id, page, items, hits). Pages stay in their partition; in
    a batch of them, offsets are one cumulative sum and hits find their first and last segment by bisection,
    so the work grows with items and boxes however long a page is."""
    kinds = {field.name: field.dataType.simpleString() for field in pages.schema.fields}
    idx = pages.schema["items"].dataType.elementType["idx"].dataType.simpleString()
    schema = (
        f"doc_id {kinds['doc_id']}, page {kinds['page']}, target string, start int, end int, seg_idx {idx}, "
        "x double, y double, w double, h double"
    )

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _boxes_of_batch(batch, padding)

    return pages.select(*PAGE, "items", "hits").mapInArrow(boxes, schema)


def _boxes_of_batch(batch: pa.RecordBatch, padding: float) -> pa.RecordBatch:
    def flat(name: str) -> tuple[dict[str, pa.Array], np.ndarray]:
        """The fields of all elements of a list column, and the page each element belongs to."""
        lists = batch.column(name)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        elements = lists.flatten()
        names = [elements.type.field(at).name for at in range(elements.type.num_fields)]
        return dict(zip(names, elements.flatten())), np.repeat(np.arange(len(batch), dtype=np.int64), counts)

    def numbers(values: pa.Array, missing) -> np.ndarray:
        return pc.fill_null(values, missing).to_numpy(zero_copy_only=False).astype(np.int64)

    items, item_page = flat("items")
    hits, hit_page = flat("hits")
    size = numbers(pc.utf8_length(items["str"]), 0)
    taken = np.where(size > 0, size + 1, numbers(items["has_eol"], False))
    before = np.cumsum(taken) - taken
    # What all pages before a page take is not part of its offsets.
    start = before - before[np.searchsorted(item_page, item_page)]
    rows = np.flatnonzero(size > 0)
    size, start, page = size[rows], start[rows], item_page[rows] << 32
    hit_start, hit_end, at = numbers(hits["start"], 0), numbers(hits["end"], 0), hit_page << 32
    first = np.searchsorted(page + start + size, at + hit_start, side="right")
    count = np.maximum(np.searchsorted(page + start, at + hit_end, side="left") - first, 0)
    hit = np.repeat(np.arange(len(count)), count)
    segment = np.arange(len(hit)) - (np.cumsum(count) - count)[hit] + first[hit]
    size, start, rows = size[segment], start[segment], pa.array(rows[segment])
    low = np.maximum(hit_start[hit], start) - start
    high = np.minimum(hit_end[hit], start + size) - start
    x, y, w, h = (items[name].take(rows).cast(pa.float64()) for name in "xywh")
    estimated = pc.multiply(pc.multiply(h, pa.array(size.astype(float))), 0.5)
    known = pc.if_else(pc.fill_null(pc.equal(w, 0.0), False), pa.scalar(None, pa.float64()), w)
    w, of_page, of_hit = pc.coalesce(known, estimated), pa.array(hit_page[hit]), pa.array(hit)
    columns = {name: batch.column(name).take(of_page) for name in PAGE}
    columns |= {name: hits[name].take(of_hit) for name in ("target", "start", "end")}
    columns["seg_idx"] = items["idx"].take(rows)
    columns["x"] = pc.subtract(pc.add(x, pc.multiply(pa.array(low / size), w)), padding)
    columns["y"] = pc.subtract(y, padding)
    columns["w"] = pc.add(pc.multiply(pa.array((high - low) / size), w), 2 * padding)
    columns["h"] = pc.add(h, 2 * padding)
    return pa.RecordBatch.from_pydict(columns)


def hits_to_boxes(hits: DataFrame, segments: DataFrame, padding: float = BOX_PADDING) -> DataFrame:
    """The boxes that cover each hit: the share of every overlapped segment, padded.

    Hits and segments meet on (document, page, 256-character stretch) instead of on the page alone,
    so a long page does not compare every hit with every segment. A pair that shares several
    stretches is kept in the first common one.
    """

    def stretches(df: DataFrame, out: str) -> DataFrame:
        first = F.floor(F.col("start") / OFFSET_BUCKET)
        last = F.floor((F.greatest("end", F.col("start") + 1) - 1) / OFFSET_BUCKET)
        return df.withColumn(out, first).withColumn("_stretch", F.explode(F.sequence(first, last)))

    left = stretches(hits.select(*PAGE, "target", "start", "end"), "_hit_first").select(
        *PAGE, "target", "_stretch", "_hit_first",
        F.col("start").alias("_from"), F.col("end").alias("_to"),
    )
    right = stretches(segments, "_seg_first")
    pairs = left.join(right, [*PAGE, "_stretch"]).filter(
        (F.col("end") > F.col("_from"))
        & (F.col("start") < F.col("_to"))
        & (F.col("_stretch") == F.greatest("_hit_first", "_seg_first"))
    )
    length = F.greatest(F.lit(1), F.col("end") - F.col("start"))
    low = F.greatest("_from", "start") - F.col("start")
    high = F.least("_to", "end") - F.col("start")
    return pairs.select(
        *PAGE,
        "target",
        F.col("_from").alias("start"),
        F.col("_to").alias("end"),
        "seg_idx",
        (F.col("x") + low / length * F.col("w") - padding).alias("x"),
        (F.col("y") - padding).alias("y"),
        ((high - low) / length * F.col("w") + 2 * padding).alias("w"),
        (F.col("h") + 2 * padding).alias("h"),
    )


def redaction_summary(pages: DataFrame) -> DataFrame:
    """Per document: pages, text pages, scanned pages, targets and hits, from rows (doc_id, page, text, targets,
    hits) of pages with the targets of their document and the number of hits."""
    counted = with_page_kind(pages).groupBy("doc_id").agg(
        F.count("*").cast("bigint").alias("pages"),
        F.count(F.when(F.col("kind") == "text", True)).cast("bigint").alias("text_pages"),
        F.count(F.when(F.col("kind") == "ocr", True)).cast("bigint").alias("ocr_pages"),
        F.max(F.array_size("targets")).cast("bigint").alias("targets"),
        F.sum("hits").cast("bigint").alias("hits"),
    )
    return counted.fillna(0, ["targets", "hits"])


def ocr_language(pages: DataFrame) -> DataFrame:
    """Per document, the language of its first scanned page (by page number); English if unclear."""
    from clinspark.functions.language import detect_language_five

    return (
        with_page_kind(pages)
        .filter("kind = 'ocr'")
        .groupBy("doc_id")
        .agg(F.min_by("ocr_text", "page").alias("_text"))
        .select(
            "doc_id", F.coalesce(detect_language_five("_text"), F.lit("eng")).alias("ocr_lang")
        )
    )
