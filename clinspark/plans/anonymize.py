"""Anonymizing documents and table columns end to end."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark import fixed_values as fixed
from clinspark.functions.chunking import chunk_text, explode_chunks
from clinspark.functions.prompts import DETECTION_LIMITS, detection_prompt, validation_prompt
from clinspark.functions.replies import parse_entity_json, parse_reject_json, surface_from_span
from clinspark.functions.signals import is_obvious_garbage, is_valid_span
from clinspark.functions.text import entity_key, let, trim_spaces
from clinspark.operators.detection import (
    combine_detections,
    dedupe_entities,
    merge_adjacent_spans,
    reject_false_positives,
    rule_detect,
    rule_matches,
    rule_type,
)
from clinspark.operators.inference import Detector, ModelFn, failures, reviewed
from clinspark.operators.mapping import (
    first_sightings,
    mint_replacements,
    new_entities,
    rebuild_counters,
)
from clinspark.operators.ordering import ordinal_within
from clinspark.operators.rewriting import (
    anonymize_text,
    apply_global_mapping,
    apply_scoped_mapping,
    entries_by_key,
    present_entries,
    shortlist,
)
from clinspark.session import cut_lineage

RULE_TYPES = ("EMAIL", "ID_NUMBER", "DATE", "AGE", "ADDRESS", "PHONE", "ORGANIZATION", "PERSON")


# --- one row at a time: document scope, rule detector --------------------------------------------
def document_entries(chunks: Column) -> Column:
    """Numbered entries (entity, type, replacement, seq) of one document's chunks, inside the row.

    Entities are taken in reading order, ignoring case after the first spelling, and numbered per
    type. Everything is an array expression, so a document never leaves its partition.
    """
    hits = F.flatten(F.transform(chunks, lambda chunk: rule_matches(chunk)))

    def first_spellings(entities: Column) -> Column:
        lowered = F.transform(entities, entity_key)
        return let(
            lowered,
            lambda keys: F.transform(
                F.array_distinct(keys),
                lambda key: F.element_at(entities, F.array_position(keys, key).cast("int")),
            ),
        )

    def numbered(entities: Column) -> Column:
        typed = F.transform(
            entities,
            lambda entity, seq: F.struct(
                entity.alias("entity"), rule_type(entity).alias("type"), seq.alias("seq")
            ),
        )

        def of_type(items: Column, kind: str) -> Column:
            return F.transform(
                F.filter(items, lambda item: item["type"] == kind),
                lambda item, index: F.struct(
                    item["entity"].alias("entity"),
                    item["type"].alias("type"),
                    F.concat(
                        F.lit(f"[{kind}_"), (index + 1).cast("string"), F.lit("]")
                    ).alias("replacement"),
                    item["seq"].alias("seq"),
                ),
            )

        def tagged(items: Column) -> Column:
            return F.concat(*[of_type(items, kind) for kind in RULE_TYPES])

        return let(typed, tagged)

    return let(let(hits, first_spellings), numbered)


def anonymize_rows(
    docs: DataFrame,
    text: str = "text",
    out: str = "anonymized_text",
    chunk_size: tuple[int, int] | None = fixed.CHUNK_DEFAULT,
    mode: str = "sequential",
) -> DataFrame:
    """Every document anonymized with its own numbering; a projection without any shuffle.

    Adds ``entries`` and ``out``. ``chunk_size=None`` detects on whole texts, which keeps the plan
    entirely inside the JVM; chunking only matters to detectors with a limited input.
    """
    chunks = F.array(F.col(text)) if chunk_size is None else chunk_text(text, *chunk_size)
    if chunk_size is not None:
        docs = docs.withColumn("_chunks", chunks)
        chunks = F.col("_chunks")
    found = docs.withColumn("entries", document_entries(chunks)).drop("_chunks")
    rewritten = anonymize_text(F.col(text), F.col("entries"), mode)
    return found.withColumn(
        out, F.when(F.size("entries") > 0, rewritten).otherwise(F.col(text))
    )


# --- tables: any detector, any scope -------------------------------------------------------------
@dataclass(frozen=True)
class Anonymized:
    """``failures`` has a row (keys, chunk_idx, pass, error) for each request that failed, None if no
    model was asked."""

    texts: DataFrame
    mapping: DataFrame
    detections: DataFrame
    label: str
    failures: DataFrame | None = None


def first_pass(
    chunks: DataFrame, keys: list[str], detector: Detector | None = None, filter_garbage: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """``(found, failed)``: (keys, chunk_idx, pos, entity, type, score), once per entity and type in a
    chunk, and the chunks a detector failed on (None for the rules, which cannot fail). The detector's
    answers are stored, so it runs once for both."""
    place = [*keys, "chunk_idx"]
    failed = None
    if detector is None:
        found = rule_detect(chunks, place)
    else:
        answers = cut_lineage(detector.answers(chunks, place))
        failed = _failed(answers, place, "detect")
        merged = merge_adjacent_spans(detector.typed(answers), place)
        surface = surface_from_span("text", "start", "end", "word")
        found = merged.join(chunks, place).select(
            *place, "pos", surface.alias("entity"), "type", "score"
        )
        found = found.filter(is_valid_span("entity", "type", "score", detector.threshold))
    if filter_garbage or (detector is not None and detector.filter_garbage):
        found = found.filter(~is_obvious_garbage("entity", "type"))
    return dedupe_entities(found, place, ["pos"]), failed


def detect_first_pass(
    chunks: DataFrame, keys: list[str], detector: Detector | None = None, filter_garbage: bool = False
) -> DataFrame:
    """The detections of ``first_pass`` alone."""
    return first_pass(chunks, keys, detector, filter_garbage)[0]


def _requests(df: DataFrame, prompt: Column, keys: list[str]) -> DataFrame:
    tokens, temperature = DETECTION_LIMITS
    return df.select(
        *keys,
        prompt["system"].alias("system"),
        prompt["user"].alias("user"),
        F.lit(tokens).alias("max_tokens"),
        F.lit(temperature).alias("temperature"),
    )


def _failed(answered: DataFrame, place: list[str], name: str) -> DataFrame:
    return failures(answered).select(*place, F.lit(name).alias("pass"), "error")


def review_detections(
    detections: DataFrame,
    chunks: DataFrame,
    keys: list[str],
    model_fn: ModelFn,
    deadline_s: float | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(kept, removed, failed)`` after a model has named the false positives of each chunk. A failed
    review removes nothing."""
    place = [*keys, "chunk_idx"]
    listed = detections.groupBy(*place).agg(
        F.sort_array(F.collect_list(F.struct("pos", "entity", "type"))).alias("_entities")
    )
    prompt = validation_prompt("text", "_entities")
    requests = _requests(chunks.join(listed, place), prompt, place)
    replies = cut_lineage(reviewed(requests, model_fn, deadline_s).select(*place, "reply", "error"))
    rejects = replies.select(*place, F.explode(parse_reject_json("reply")).alias("entity"))
    kept, removed = reject_false_positives(detections, rejects, place, ["pos"])
    return kept, removed, _failed(replies, place, "review")


def detect_second_pass(
    chunks: DataFrame, keys: list[str], model_fn: ModelFn, deadline_s: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(found, failed)``: entities a language model lists per chunk, and the chunks it could not
    read."""
    place = [*keys, "chunk_idx"]
    asked = _requests(chunks, detection_prompt("text"), place)
    replies = cut_lineage(reviewed(asked, model_fn, deadline_s).select(*place, "reply", "error"))
    found = replies.select(
        *place, F.posexplode(parse_entity_json("reply")).alias("pos", "item")
    ).select(
        *place,
        "pos",
        trim_spaces("item.entity").alias("entity"),
        F.col("item.type").alias("type"),
        F.lit(1.0).alias("score"),
    )
    return found, _failed(replies, place, "discover")


def withheld(texts: DataFrame, failed: DataFrame, keys: list[str], out: str = "anonymized_text") -> DataFrame:
    """``texts`` with ``error``; ``out`` is NULL where a request of the text failed, since what that
    request would have found is still in it."""
    said = failed.groupBy(*keys).agg(F.min(F.concat("pass", F.lit(": "), "error")).alias("error"))
    joined = texts.join(said, keys, "left")
    return joined.withColumn(out, F.when(F.col("error").isNull(), F.col(out)))


def extend_mapping(
    detections: DataFrame,
    scope: list[str],
    order: list[str],
    mapping: DataFrame | None = None,
    small_scopes: bool = False,
) -> DataFrame:
    """The mapping (scope, entity, type, replacement, seq) after all detections were seen in
    ``order``; known entities keep their replacement, numbers continue."""
    columns = [*scope, "entity", "type", "replacement", "seq"]
    counters = offset = None
    if mapping is not None:
        detections = new_entities(detections, mapping, scope)
        counters = rebuild_counters(mapping, scope)
        offset = mapping.groupBy(*scope).agg(F.max("seq").alias("_offset"))
    sightings = first_sightings(detections, scope, order)
    if small_scopes:
        window = Window.partitionBy(*scope).orderBy(*order)
        placed = sightings.withColumn("seq", F.row_number().over(window).cast("bigint"))
    else:
        placed = ordinal_within(sightings, scope, order, "seq")
    minted = mint_replacements(placed, scope, ["seq"], counters, small_scopes)
    if mapping is None:
        return minted.select(*columns)
    if scope:
        minted = minted.join(offset, scope, "left")
    else:
        minted = minted.withColumn("_one", F.lit(1)).join(
            F.broadcast(offset.withColumn("_one", F.lit(1))), "_one", "left"
        )
    minted = minted.withColumn("seq", F.col("seq") + F.coalesce("_offset", F.lit(0)))
    return mapping.select(*columns).unionByName(minted.select(*columns))


@dataclass(frozen=True)
class _Passes:
    """What the passes over all chunks found: detections with ``phase``, those removed by the review,
    and the failed requests."""

    found: DataFrame
    removed: DataFrame | None
    failed: DataFrame | None


def run_passes(
    chunks: DataFrame,
    keys: list[str],
    passes: tuple[str, ...],
    detector: Detector | None = None,
    model_fn: ModelFn | None = None,
    filter_garbage: bool = False,
    deadline_s: float | None = None,
) -> _Passes:
    """First pass, its review and the second pass, each over all chunks before the next begins."""
    kept = removed = second = None
    failed: list[DataFrame] = []
    if "ner" in passes:
        kept, missed = first_pass(chunks, keys, detector, filter_garbage)
        if missed is not None:
            failed.append(missed)
        if missed is not None or "llm" in passes:
            # A review reads what was found three times: rules and joins run once.
            kept = cut_lineage(kept)
        if "llm" in passes:
            kept, removed, missed = review_detections(kept, chunks, keys, model_fn, deadline_s)
            failed.append(missed)
    if "llm" in passes:
        second, missed = detect_second_pass(chunks, keys, model_fn, deadline_s)
        failed.append(missed)
    if kept is not None and second is not None:
        found = combine_detections(kept, second)
    else:
        found = (kept if kept is not None else second).withColumn("phase", F.lit(1))
    return _Passes(found, removed, reduce(DataFrame.unionByName, failed) if failed else None)


def listed_detections(done: _Passes, found: DataFrame) -> DataFrame:
    """``found`` and the removed detections with ``source`` and ``status``."""
    source = F.when(F.col("phase") == 2, "second").otherwise("first")
    detections = found.withColumn("source", source).withColumn("status", F.lit("kept"))
    if done.removed is None:
        return detections
    gone = done.removed.withColumn("phase", F.lit(1)).withColumn("source", F.lit("first"))
    return detections.unionByName(gone.withColumn("status", F.lit("removed")))


def anonymize(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    passes: tuple[str, ...] = ("ner",),
    detector: Detector | None = None,
    model_fn: ModelFn | None = None,
    scope: str = "document",
    mapping: DataFrame | None = None,
    chunk_size: tuple[int, int] = fixed.CHUNK_DEFAULT,
    label: str | None = None,
    filter_garbage: bool = False,
    release_failed: bool = False,
    deadline_s: float | None = None,
    mode: str | None = None,
) -> Anonymized:
    """Detect, review, discover, number and rewrite.

    ``passes`` are those ``pick_passes`` settled on. Each model pass runs over all chunks before the
    next begins and ends in a checkpoint, so a model is loaded once per worker and pass and is never
    run again by a later action or after a lost executor. ``scope`` is ``document`` (own numbers per
    document) or ``global`` (one mapping for all). Rewriting uses the whole text, not the chunks.
    ``filter_garbage`` drops obvious nonsense of zero-shot detectors. A text of which a request to a
    detector or model failed is withheld (``anonymized_text`` NULL, ``error`` set) unless
    ``release_failed``; with ``deadline_s`` language models run in child processes and late answers
    are failures too. ``mode`` is that of ``anonymize_text``: sequential for a document's own mapping and
    single pass for a shared one unless it says otherwise.
    """
    keys = [key]
    chunks = explode_chunks(docs, chunk_text(text, *chunk_size), keys)
    if detector is not None or model_fn is not None:
        # Spread the chunks: lengths are heavy-tailed and a long document would pin one task.
        chunks = cut_lineage(chunks.repartition(key, "chunk_idx"))
    done = run_passes(chunks, keys, passes, detector, model_fn, filter_garbage, deadline_s)
    found = done.found
    scope_keys = keys if scope == "document" else []
    order = ["phase", *([] if scope_keys else keys), "chunk_idx", "pos"]
    if scope == "global":
        # A global numbering is computed in several jobs; all of them must see the same rows.
        found = cut_lineage(found)
    extended = extend_mapping(found, scope_keys, order, mapping, small_scopes=bool(scope_keys))
    if scope == "document":
        texts = apply_scoped_mapping(docs, extended, keys, text, mode=mode or "sequential")
    else:
        extended = cut_lineage(extended)
        texts = apply_global_mapping(docs, extended, keys, text, mode=mode or "single_pass")
    if done.failed is not None and not release_failed:
        texts = withheld(texts, done.failed, keys)
    return Anonymized(texts, extended, listed_detections(done, found), label or "+".join(passes), done.failed)


def anonymize_table(
    df: DataFrame,
    row: str,
    columns: list[str],
    detector: Detector | None = None,
    passes: tuple[str, ...] = ("ner",),
    model_fn: ModelFn | None = None,
    mapping: DataFrame | None = None,
    label: str | None = None,
    filter_garbage: bool = False,
    release_failed: bool = False,
    deadline_s: float | None = None,
    mode: str = "single_pass",
) -> Anonymized:
    """Anonymize text columns of a table with one mapping for all of them.

    The cells of a row are detected together, separated by a rule line; rows are never gathered. The
    passes are those of ``anonymize``, and so are ``mapping`` (entities that have a replacement already
    keep it, numbers continue) and the failures. The mapping is applied to each selected column in
    place, so the header and all other columns stay; of a row with a failed request all selected
    columns are NULL and ``error`` says why, unless ``release_failed``.
    """
    separator = "\n---\n"
    cells = F.filter(
        F.array(*[F.col(name) for name in columns]),
        lambda cell: cell.isNotNull() & (trim_spaces(cell) != ""),
    )
    joined = df.select(row, F.array_join(cells, separator).alias("text")).filter("text <> ''")
    chunks = explode_chunks(joined, chunk_text("text"), [row])
    if detector is not None or model_fn is not None:
        chunks = cut_lineage(chunks.repartition(row, "chunk_idx"))
    done = run_passes(chunks, [row], passes, detector, model_fn, filter_garbage, deadline_s)
    found = cut_lineage(done.found)
    extended = cut_lineage(extend_mapping(found, [], ["phase", row, "chunk_idx", "pos"], mapping))
    entries = entries_by_key(shortlist(joined, extended, [row], mode=mode), [row])
    with_entries = df.join(entries, row, "left")
    rewritten = {
        name: F.when(F.col("entries").isNull(), F.col(name)).otherwise(
            anonymize_text(
                F.col(name),
                F.col("entries") if mode == "sequential" else present_entries(F.col(name), F.col("entries")),
                mode,
            )
        )
        for name in columns
    }
    texts = with_entries.withColumns(rewritten).select(*df.columns)
    if done.failed is not None and not release_failed:
        for name in columns[1:]:
            texts = withheld(texts, done.failed, [row], name).drop("error")
        texts = withheld(texts, done.failed, [row], columns[0])
    return Anonymized(texts, extended, listed_detections(done, found), label or "+".join(passes), done.failed)
