"""Rule detection, span merging, review and comparison of detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import SPACES, Check, quoted, sql_trim, table
from checks.texts import TYPES, TYPE_SQL, conversations, documents
from clinspark import fixed_values as fixed
from clinspark.functions.text import normalize_entity
from clinspark.operators import detection

SP = SPACES
RULE_REGEX = quoted(detection.detector_regex("\\b", "\\b"))
RULE_TYPE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(entity, {quoted(pattern)}) THEN '{kind}'"
    for kind, pattern in detection.RULE_TESTS
) + " END"
RULE_CTE = f"""hits AS (SELECT doc_id, text, regexp_extract_all(text, {RULE_REGEX}) AS found FROM documents),
detected AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, found[i] AS entity FROM hits, unnest(range(1, len(found) + 1)) AS r(i)),
typed AS (SELECT *, {RULE_TYPE_SQL} AS type FROM detected)"""


def rule_detect(spark, folder):
    return detection.rule_detect(documents(spark, folder), ["doc_id"]).drop("score")


RULE_DETECT_SQL = f"WITH {RULE_CTE} SELECT doc_id, pos, entity, type FROM typed"


def rule_spans(spark, folder):
    return detection.rule_spans(documents(spark, folder), ["doc_id"]).drop("score")


RULE_SPANS_SQL = f"""
WITH {RULE_CTE}, gaps AS (SELECT doc_id, found, regexp_split_to_array(text, {RULE_REGEX}) AS gap FROM hits)
SELECT t.doc_id, t.pos, t.entity, t.type, CAST(e AS INTEGER) AS "end", CAST(e - length(t.entity) AS INTEGER) AS "start"
FROM (SELECT t.*, list_sum(list_transform(gap[1:pos + 1], lambda g: length(g)))
    + list_sum(list_transform(found[1:pos + 1], lambda g: length(g))) AS e
  FROM typed t JOIN gaps USING (doc_id)) t"""


# --- words of conversation turns stand in for model output ---------------------------------------
def _words(spark, folder):
    turns = conversations(spark, folder).select(
        "conv_id", "turn",
        F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "entity"),
    )
    kinds = F.array(*map(F.lit, TYPES))
    return turns.withColumn("type", F.get(kinds, F.length("entity") % 10))


WORDS_CTE = f"""words AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, w[i] AS entity, ({TYPE_SQL})[length(w[i]) % 10 + 1] AS type
  FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations), unnest(range(1, len(w) + 1)) AS r(i))"""


def _second(words):
    """A second pass over the same words that types those starting with a vowel differently."""
    vowel = F.lower("entity").rlike("^[aeiou]")
    return words.withColumn("type", F.when(vowel, "OTHER").otherwise(F.col("type"))).withColumn(
        "entity", F.upper("entity")
    )


SECOND_SQL = "SELECT conv_id, turn, pos, upper(entity) AS entity, CASE WHEN regexp_matches(lower(entity), '^[aeiou]') THEN 'OTHER' ELSE type END AS type FROM words"


def map_types(spark, folder):
    labels = [label for names in fixed.TYPE_MAPS.values() for label in names] + ["B-PER", "I-LOC", "XYZ"]
    choice = F.array(*map(F.lit, labels))
    events = table(spark, folder, "events").select(
        "event_id", F.get(choice, (F.col("event_id") % len(labels)).cast("int")).alias("raw_type")
    )
    mapped = None
    for model in fixed.TYPE_MAPS:
        part = detection.map_types(events, model).withColumn("model", F.lit(model))
        mapped = part if mapped is None else mapped.unionByName(part)
    return mapped.select("model", "event_id", "raw_type", "type")


def _map_types_sql() -> str:
    labels = [label for names in fixed.TYPE_MAPS.values() for label in names] + ["B-PER", "I-LOC", "XYZ"]
    values = ", ".join(
        f"({quoted(model)}, {quoted(label)}, {quoted(kind)})"
        for model, names in fixed.TYPE_MAPS.items()
        for label, kind in names.items()
    )
    models = ", ".join(f"({quoted(model)})" for model in fixed.TYPE_MAPS)
    return f"""
WITH m(model, label, kind) AS (VALUES {values}), models(model) AS (VALUES {models}),
e AS (SELECT model, event_id, ([{", ".join(map(quoted, labels))}])[event_id % {len(labels)} + 1] AS raw_type FROM events, models)
SELECT e.model, event_id, raw_type, coalesce(kind, regexp_replace(raw_type, '^[BI]-', '')) AS type
FROM e LEFT JOIN m ON m.model = e.model AND m.label = regexp_replace(raw_type, '^[BI]-', '')"""


def _token_spans(spark, folder):
    """Words of every turn as token spans; words of six letters have lost their offsets."""
    pieces = conversations(spark, folder).select(
        "conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word")
    )
    from pyspark.sql import Window

    upto = Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = (F.sum(F.length("word") + 1).over(upto) - 1).cast("int")
    known = F.length("word") != 6
    kinds = F.array(*map(F.lit, TYPES[:3]))
    return pieces.withColumn("_end", end).select(
        "conv_id", "turn", "pos", "word", F.get(kinds, F.length("word") % 3).alias("type"),
        F.when(known, F.col("_end") - F.length("word")).alias("start"),
        F.when(known, F.col("_end")).alias("end"),
        F.round(1.0 / (F.length("word") + 1), 6).alias("score"),
    )


def merge_adjacent_spans(spark, folder):
    return detection.merge_adjacent_spans(_token_spans(spark, folder), ["conv_id", "turn"])


MERGE_SQL = f"""
WITH p AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word FROM
  (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), unnest(range(1, len(w) + 1)) AS r(i)),
o AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS e FROM p),
s AS (SELECT conv_id, turn, pos, word, ({TYPE_SQL})[length(word) % 3 + 1] AS type,
  CASE WHEN length(word) <> 6 THEN e - length(word) END AS s, CASE WHEN length(word) <> 6 THEN e END AS e,
  round(1.0::DOUBLE / (length(word) + 1), 6) AS score FROM o),
b AS (SELECT *, CASE WHEN coalesce(lag(type) OVER w = type AND s - lag(e) OVER w <= 1, false) THEN 0 ELSE 1 END AS br
  FROM s WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
g AS (SELECT *, sum(br) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS island FROM b)
SELECT conv_id, turn, min(pos) AS pos, first(type ORDER BY pos) AS type, string_agg(word, '' ORDER BY pos) AS word,
  CAST(first(s ORDER BY pos) AS INTEGER) AS "start", CAST(last(e ORDER BY pos) AS INTEGER) AS "end", min(score) AS score
FROM g GROUP BY conv_id, turn, island"""


def normalize_lines(spark, folder):
    lines = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", "n", normalize_entity("line").alias("normalized"))


NORMALIZE_SQL = f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, regexp_replace({sql_trim('lower(parts[i])')}, '{SP}+', ' ', 'g') AS normalized
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(i)"""


def dedupe_entities(spark, folder):
    return detection.dedupe_entities(_words(spark, folder), ["conv_id"], ["turn", "pos"])


DEDUPE_SQL = f"""
WITH {WORDS_CTE} SELECT conv_id, turn, pos, entity, type FROM words
QUALIFY row_number() OVER (PARTITION BY conv_id, lower(entity), type ORDER BY turn, pos) = 1"""


def _review(spark, folder):
    """Words of five letters are called false positives (upper case, as a model may write them)."""
    words = _words(spark, folder)
    rejects = words.filter(F.length("entity") == 5).select(
        "conv_id", "turn", F.concat(F.lit(" "), F.upper("entity")).alias("entity")
    )
    return detection.reject_false_positives(words, rejects, ["conv_id", "turn"], ["pos"])


def reject_false_positives(spark, folder):
    kept, removed = _review(spark, folder)
    return kept.withColumn("status", F.lit("kept")).unionByName(
        removed.withColumn("status", F.lit("removed"))
    )


# Words of five letters have type ADDRESS, which always counts as personal data, so nothing goes by
# type; the check below moves them to OTHER first to see both outcomes.
def reject_with_signal(spark, folder):
    words = _words(spark, folder).withColumn(
        "type", F.when(F.col("type") == "ADDRESS", F.when(F.col("entity").rlike("^[A-Z]"), "LOCATION").otherwise("OTHER")).otherwise(F.col("type"))
    )
    rejects = words.filter(F.length("entity").isin(4, 5, 7)).select("conv_id", "turn", "entity")
    kept, removed = detection.reject_false_positives(words, rejects, ["conv_id", "turn"], ["pos"])
    return kept.withColumn("status", F.lit("kept")).unionByName(
        removed.withColumn("status", F.lit("removed"))
    )


def _signal_sql() -> str:
    """Strong signals that letter-only words can show."""
    words = [*(t.removesuffix("\\.?") for t in fixed.CARE_TITLES), *fixed.MEDICAL_ORGANISATIONS]
    listed = ", ".join(quoted(word) for word in words)
    months = ", ".join(quoted(word) for word in fixed.DUTCH_MONTHS)
    return f"""(type IN ('EMAIL', 'PHONE', 'ADDRESS') OR lower(entity) IN ({listed})
  OR (type = 'DATE' AND lower(entity) IN ({months}))
  OR (type IN ('LOCATION', 'ORGANIZATION') AND regexp_matches(entity, '[A-Z][a-z]{{2,}}')))"""


def _reject_sql(words: str, rejected: str) -> str:
    return f"""
WITH {WORDS_CTE}, d AS ({words}),
last AS (SELECT conv_id, turn, lower(entity) AS k, arg_max(entity, pos) AS entity, arg_max(type, pos) AS type FROM d GROUP BY ALL),
out AS (SELECT conv_id, turn, k FROM last WHERE {rejected} AND NOT {_signal_sql()})
SELECT d.*, CASE WHEN out.k IS NULL THEN 'kept' ELSE 'removed' END AS status
FROM d LEFT JOIN out ON out.conv_id = d.conv_id AND out.turn = d.turn AND out.k = lower(d.entity)"""


RETYPED = """SELECT conv_id, turn, pos, entity, CASE WHEN type = 'ADDRESS' THEN
  CASE WHEN regexp_matches(entity, '^[A-Z]') THEN 'LOCATION' ELSE 'OTHER' END ELSE type END AS type FROM words"""


def only_in_second(spark, folder):
    words = _words(spark, folder)
    return detection.only_in_second(_second(words), words, ["conv_id"])


ONLY_SECOND_SQL = f"""
WITH {WORDS_CTE}, second AS ({SECOND_SQL})
SELECT DISTINCT conv_id, lower(entity) AS entity_key, type FROM second
EXCEPT SELECT DISTINCT conv_id, lower(entity), type FROM words"""


def combined(spark, folder):
    words = _words(spark, folder)
    both = detection.combine_detections(words, _second(words))
    return detection.dedupe_entities(both, ["conv_id"], ["phase", "turn", "pos"])


COMBINED_SQL = f"""
WITH {WORDS_CTE}, both_passes AS (SELECT *, 1 AS phase FROM words UNION ALL SELECT *, 2 FROM ({SECOND_SQL}))
SELECT conv_id, turn, pos, entity, type, phase FROM both_passes
QUALIFY row_number() OVER (PARTITION BY conv_id, lower(entity), type ORDER BY phase, turn, pos) = 1"""


def detection_counts(spark, folder):
    words = _words(spark, folder)
    status = F.when(F.length("entity") == 5, "removed").otherwise("kept")
    every = words.withColumn("source", F.lit("first")).withColumn("status", status).unionByName(
        _second(words).withColumn("source", F.lit("second")).withColumn("status", F.lit("kept"))
    )
    return detection.detection_counts(every, ["conv_id"])


COUNTS_SQL = f"""
WITH {WORDS_CTE}, e AS (SELECT conv_id, lower(entity) AS k, type, 'first' AS source,
    CASE WHEN length(entity) = 5 THEN 'removed' ELSE 'kept' END AS status FROM words
  UNION ALL SELECT conv_id, lower(entity), type, 'second', 'kept' FROM ({SECOND_SQL}))
SELECT conv_id, count(DISTINCT (k, type)) FILTER (source = 'first' AND status = 'kept') AS first_pass,
  count(DISTINCT (k, type)) FILTER (source = 'second' AND status = 'kept') AS second_pass,
  count(DISTINCT (k, type)) FILTER (status = 'removed') AS removed FROM e GROUP BY conv_id"""


def order_detections(spark, folder):
    first = detection.dedupe_entities(_words(spark, folder), ["conv_id"], ["turn", "pos"])
    return detection.order_detections(first.select("type", "entity").distinct())


ORDER_SQL = f"""
WITH {WORDS_CTE}, f AS (SELECT entity, type FROM words
 QUALIFY row_number() OVER (PARTITION BY conv_id, lower(entity), type ORDER BY turn, pos) = 1)
SELECT DISTINCT type, entity FROM f ORDER BY type, entity"""


CHECKS = {
    "rule_detect": Check(rule_detect, RULE_DETECT_SQL),
    "rule_spans": Check(rule_spans, RULE_SPANS_SQL),
    "map_types": Check(map_types, _map_types_sql()),
    "merge_adjacent_spans": Check(merge_adjacent_spans, MERGE_SQL),
    "normalize_entity": Check(normalize_lines, NORMALIZE_SQL),
    "dedupe_entities": Check(dedupe_entities, DEDUPE_SQL),
    "reject_false_positives": Check(
        reject_false_positives, _reject_sql("SELECT * FROM words", "length(k) = 5")
    ),
    "reject_with_signal": Check(reject_with_signal, _reject_sql(RETYPED, "length(k) IN (4, 5, 7)")),
    "llm_added": Check(only_in_second, ONLY_SECOND_SQL),
    "combine_detections": Check(combined, COMBINED_SQL),
    "detection_counts": Check(detection_counts, COUNTS_SQL),
    "order_detections": Check(order_detections, ORDER_SQL),
}
