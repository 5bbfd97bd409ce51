"""Detections: the rule detector, span merging, de-duplication, review and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark import fixed_values as fixed
from clinspark.functions.signals import has_strong_pii_signal
from clinspark.functions.text import (
    NOT_WORD_AFTER,
    NOT_WORD_BEFORE,
    as_column,
    entity_key,
    normalize_entity,
)

# --- the offline rule detector -------------------------------------------------------------------
# One shape per type, most specific first. The shapes mean the same in java.util.regex
# and RE2. A hit may not touch an ASCII word character; a name may start with an accented capital,
# which is no ASCII word character, and ends where its letters end.
_SMALL = "[a-zà-öø-ÿ'-]+"
_CAP = f"[A-ZÀ-ÖØ-Þ]{_SMALL}"
_PARTICLE = "(?:" + "|".join(sorted(fixed.NAME_PARTICLES, key=len, reverse=True)) + ")"
RULES: tuple[tuple[str, str], ...] = (
    ("EMAIL", r"[A-Za-z0-9._%+-]*[A-Za-z0-9_]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ID_NUMBER", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    ("ID_NUMBER", r"[A-Z]{1,3}-?[0-9]{6,}"),
    ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("DATE", r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}"),
    ("DATE", r"[0-9]{1,2} (?:" + "|".join(fixed.DUTCH_MONTHS) + r")(?: [0-9]{4})?"),
    ("AGE", r"[0-9]{1,3} (?:jaar|years old)"),
    ("ADDRESS", r"[0-9]{4} ?[A-Z]{2}"),
    ("ADDRESS", r"[A-Z][a-z]*(?:" + "|".join(fixed.STREET_WORDS) + r") [0-9]+[a-z]?"),
    ("ADDRESS", r"[0-9]+ (?:[A-Z][a-z]+ ){1,2}(?:Drive|Road|Street|Avenue|Lane|Boulevard)"),
    ("ID_NUMBER", r"[0-9]{9}"),
    ("PHONE", r"[0-9][0-9 ().-]{6,}[0-9]"),
    ("ORGANIZATION", r"(?:[A-Z][A-Za-z]+ ){0,2}[A-Z][A-Za-z]+ (?:BV|NV|UMC|Hospital|Clinic)"),
    ("PERSON", rf"{_CAP}(?: {_CAP}){{0,2}} (?:{_PARTICLE} )*{_CAP}"),
)


def detector_regex(before: str, after: str) -> str:
    """All rules as one alternation, with the given notation for the two word edges.

    The left edge is tested once for all rules that start with an ASCII character, so positions
    inside words are given up after a single test.
    """
    inner, others = [], []
    for kind, shape in RULES:
        if kind == "PERSON":
            rest = shape.removeprefix("[A-ZÀ-ÖØ-Þ]")
            inner.append("[A-Z]" + rest)
            others.append("[À-ÖØ-Þ]" + rest)
        else:
            inner.append(shape + after)
            if kind == "PHONE":
                others.append(rf"\+{before}{shape}{after}")
    grouped = "|".join(f"(?:{part})" for part in inner)
    return "|".join([f"{before}(?:{grouped})", *others])


ANY_RULE = detector_regex(NOT_WORD_BEFORE, NOT_WORD_AFTER)
RULE_TESTS = [(kind, rf"^\+?(?:{shape})\z") for kind, shape in RULES]


def rule_matches(text: Column | str) -> Column:
    """Non-overlapping hits of all rules, left to right, as an array of strings (one regex pass)."""
    return F.regexp_extract_all(as_column(text), F.lit(ANY_RULE), F.lit(0))


def rule_type(entity: Column | str) -> Column:
    """The type of a rule hit: the first rule that matches all of it."""
    entity = as_column(entity)
    kind = None
    for name, pattern in RULE_TESTS:
        test = entity.rlike(pattern)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind


def rule_detect(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Detections of the rule detector: ``keep`` columns, ``pos``, ``entity``, ``type``, ``score``."""
    hits = df.select(*keep, F.posexplode(rule_matches(text)).alias("pos", "entity"))
    return hits.withColumn("type", rule_type("entity")).withColumn("score", F.lit(1.0))


def rule_spans(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Rule detections with offsets.

    The text between hits (``split`` by the same regex) and the hits themselves alternate, so the
    start of a hit is a running sum of lengths; only lengths are shuffled, never texts. ``keep`` must
    identify the text.
    """
    pieces = F.arrays_zip(
        F.transform(F.split(F.col(text), ANY_RULE), lambda gap: F.length(gap)).alias("gap"),
        rule_matches(text).alias("entity"),
    )
    exploded = df.select(*keep, F.posexplode(pieces).alias("pos", "piece")).select(
        *keep, "pos", F.col("piece.gap").alias("gap"), F.col("piece.entity").alias("entity")
    )
    before = Window.partitionBy(*keep).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length("entity"), F.lit(0))
    end = F.sum(F.col("gap") + size).over(before)
    return (
        exploded.withColumn("end", end.cast("int"))
        .filter(F.col("entity").isNotNull())
        .withColumn("start", (F.col("end") - F.length("entity")).cast("int"))
        .withColumn("type", rule_type("entity"))
        .select(*keep, "pos", "entity", "type", "start", "end", F.lit(1.0).alias("score"))
    )


# --- spans of token-class models -----------------------------------------------------------------
def map_types(spans: DataFrame, model_id: str, raw: str = "raw_type") -> DataFrame:
    """Canonical ``type`` of a raw label; unknown labels pass through. The label table has at most a
    few dozen rows by construction, so it is broadcast."""
    rows = list(fixed.TYPE_MAPS[model_id].items())
    labels = spans.sparkSession.createDataFrame(rows, "_label string, _type string")
    plain = F.regexp_replace(F.col(raw), "^[BI]-", "")
    return (
        spans.withColumn("_plain", plain)
        .join(F.broadcast(labels), F.col("_plain") == F.col("_label"), "left")
        .withColumn("type", F.coalesce("_type", "_plain"))
        .drop("_plain", "_label", "_type")
    )


def merge_adjacent_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Join neighbouring spans of one type that are at most one character apart.

    Spans without offsets never join. A text is the partition, so groups are as small as texts.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    previous_end = F.lag("end").over(order)
    joins = (F.lag("type").over(order) == F.col("type")) & (F.col("start") - previous_end <= 1)
    broken = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    island = F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = lambda name: F.min_by(name, "pos").alias(name)
    words = F.sort_array(F.collect_list(F.struct("pos", "word")))
    return (
        spans.withColumn("_break", broken)
        .withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(
            F.min("pos").alias("pos"),
            first("type"),
            F.array_join(F.transform(words, lambda item: item["word"]), "").alias("word"),
            first("start"),
            F.max_by("end", "pos").alias("end"),
            F.min("score").alias("score"),
        )
        .drop("_island")
    )


# --- tables of detections ------------------------------------------------------------------------
def dedupe_entities(detections: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First detection per (keys, lower-cased entity, type). ``min_by`` combines before the shuffle."""
    rest = [name for name in detections.columns if name not in {*keys, "type"}]
    return (
        detections.withColumn("_key", entity_key("entity"))
        .groupBy(*keys, "_key", "type")
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
        .select(*keys, "type", "_first.*")
        .select(*detections.columns)
    )


def reject_false_positives(
    detections: DataFrame, rejects: DataFrame, keys: list[str], order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)`` after a review.

    ``rejects`` holds ``keys`` and ``entity``. A rejection is void if the detection it names (the
    last one with that spelling) still looks like personal data.
    """
    named = detections.withColumn("_norm", normalize_entity("entity"))
    last = named.groupBy(*keys, "_norm").agg(
        F.max_by(F.struct("entity", "type"), F.struct(*order)).alias("_last")
    )
    asked = rejects.select(*keys, normalize_entity("entity").alias("_norm")).distinct()
    valid = (
        asked.join(last, [*keys, "_norm"])
        .filter(~has_strong_pii_signal("_last.entity", "_last.type"))
        .select(*keys, "_norm")
    )
    kept = named.join(valid, [*keys, "_norm"], "left_anti").select(*detections.columns)
    removed = named.join(valid, [*keys, "_norm"], "left_semi").select(*detections.columns)
    return kept, removed


def only_in_second(second: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (entity key, type) pairs of ``second`` that ``first`` does not have."""

    def pairs(df: DataFrame) -> DataFrame:
        return df.select(*keys, entity_key("entity").alias("entity_key"), "type").distinct()

    return pairs(second).join(pairs(first), [*keys, "entity_key", "type"], "left_anti")


def combine_detections(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reviewed first-pass detections, then second-pass ones; ``phase`` leads the sort order."""
    return first.withColumn("phase", F.lit(1)).unionByName(second.withColumn("phase", F.lit(2)))


def detection_counts(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct detections per source and status, in one row per ``keys``.

    Pairs are made distinct once, with flags, instead of once per counter.
    """
    source, status = F.col("source"), F.col("status")
    kept = status == "kept"
    flags = {
        "first_pass": (source == "first") & kept,
        "second_pass": (source == "second") & kept,
        "removed": status == "removed",
    }
    pairs = detections.groupBy(*keys, entity_key("entity").alias("_key"), "type").agg(
        *[F.max(condition.cast("int")).alias(name) for name, condition in flags.items()]
    )
    return pairs.groupBy(*keys).agg(
        *[F.sum(name).cast("bigint").alias(name) for name in flags]
    )


def order_detections(detections: DataFrame) -> DataFrame:
    return detections.orderBy("type", "entity")


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
