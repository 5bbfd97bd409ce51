"""Sheets, reports, translation, summaries, speech logs and windows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.base import Check, rounded, sql_trim, table
from checks.texts import FIXED_CTE, NL_EN_SQL, QUALITY_SQL, conversations, documents
from clinspark.functions.text import split_paragraphs
from clinspark.operators import reports, sheets, speech
from clinspark.operators.inference import safe_rows
from clinspark.operators.framing import framed, resample_frames
from clinspark.plans.speech import log_table, transcribe_frames, transcribe_long, transcript_log
from clinspark.plans.summarize import fact_groups, fact_requests, routed, summarize
from clinspark.plans.translate import translate, translate_columns

# --- sheets --------------------------------------------------------------------------------------
def _sheet(spark, folder):
    """Orders as a sheet with two text columns, some cells blank."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("row"),
        F.when(key % 5 == 0, "  ").when(key % 7 == 0, None).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("status "), "o_orderstatus")).alias("status"),
        F.col("o_totalprice").alias("price"),
    )


SHEET_CTE = """sheet AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'status ' || o_orderstatus END AS status, o_totalprice AS price FROM orders)"""


def text_cells(spark, folder):
    return sheets.text_cells(_sheet(spark, folder), "row", ["priority", "status"])


CELLS_SQL = f"""
WITH {SHEET_CTE} SELECT * FROM (SELECT row, 0 AS col_no, 'priority' AS col, priority AS value FROM sheet UNION ALL SELECT row, 1, 'status', status FROM sheet)
WHERE {sql_trim("coalesce(value, '')")} <> ''"""


def sheet_text(spark, folder):
    """One book per customer: its orders are the rows, the text cells the columns."""
    cells = text_cells(spark, folder).join(
        table(spark, folder, "orders").select(F.col("o_orderkey").alias("row"), "o_custkey"), "row"
    )
    long_cells = cells.select(
        F.concat(F.lit("book"), "o_custkey").alias("book"), (F.col("row") % 2).cast("int").alias("sheet_no"),
        "row", F.col("col_no").alias("col"), "value", F.lit(True).alias("is_text"),
    )
    return sheets.sheet_text(long_cells)


SHEET_TEXT_SQL = f"""
WITH {SHEET_CTE}, c AS ({CELLS_SQL.split(SHEET_CTE)[1]}), r AS (SELECT 'book' || o_custkey AS book, row % 2 AS sheet_no, row, string_agg(value, ' ' ORDER BY col_no) AS line
  FROM c JOIN orders ON o_orderkey = row GROUP BY ALL)
SELECT book, string_agg(line, chr(10) ORDER BY sheet_no, row) AS text FROM r GROUP BY book"""


def preview_rows(spark, folder):
    return sheets.preview_rows(_sheet(spark, folder), "row", ["priority", "status"])


PREVIEW_SQL = f"WITH {SHEET_CTE} SELECT row, coalesce(priority, '') AS priority, coalesce(status, '') AS status FROM sheet ORDER BY row LIMIT 5"


def sheet_stats(spark, folder):
    return sheets.sheet_stats(_sheet(spark, folder), ["priority", "status"])


STATS_SQL = f"""
WITH {SHEET_CTE} SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns, true AS has_headers, count(*) = 0 AS is_empty,
  CAST(sum(CASE WHEN trim(coalesce(priority, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(status, '')) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS text_cells FROM sheet"""


# --- reports -------------------------------------------------------------------------------------
def comparison_report(spark, folder):
    pairs = conversations(spark, folder).select("conv_id", "turn", F.col("text").alias("original"), F.reverse("text").alias("translated"))
    return reports.comparison_report(pairs, ["conv_id"], ["turn"])


COMPARISON_SQL = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, 'Original → Translated' || chr(10) || repeat('=', 80) || chr(10) || chr(10) || string_agg('Paragraph ' || i || ':' || chr(10) || 'ORIGINAL: ' || text
  || chr(10) || chr(10) || 'TRANSLATED: ' || reverse(text) || chr(10) || chr(10) || repeat('-', 80) || chr(10) || chr(10), '' ORDER BY i) AS report FROM n GROUP BY conv_id"""


def markdown_report(spark, folder):
    docs = documents(spark, folder)
    report = reports.markdown_report(
        split_paragraphs("text"),
        F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("Document "), F.col("doc_id").cast("string"))),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")),
        F.when(F.col("doc_id") % 5 == 0, "nl"),
        F.when(F.col("doc_id") % 7 == 0, "2024-01-01"),
    )
    return docs.select("doc_id", report.alias("markdown"))


MARKDOWN_SQL = f"""
WITH p AS (SELECT *, chr(10) || chr(10) AS b FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN '# Document ' || doc_id || b ELSE '' END
  || CASE WHEN doc_id % 2 = 0 OR doc_id % 5 = 0 THEN '**Translation**: ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Unknown' END || ' → '
     || CASE WHEN doc_id % 5 = 0 THEN 'nl' ELSE 'Unknown' END || b ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN '**Date**: 2024-01-01' || b ELSE '' END || '---' || b
  || array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: {sql_trim('x')}), lambda x: x <> ''), chr(10) || chr(10)) AS markdown FROM p"""


# --- dictation -----------------------------------------------------------------------------------
def _entries(spark, folder):
    """A dictation entry per event: users are sessions, the value is the length in seconds."""
    events = table(spark, folder, "events")
    start = F.col("ts").cast("timestamp")
    length = F.make_dt_interval(secs=F.round("value", 2).cast("decimal(18,6)"))
    text = F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 3 == 0, F.concat_ws(" ", "event_type", "event_type")).otherwise(F.col("props")))
    return events.select(
        F.col("user_id").cast("string").alias("session_id"), start.alias("start_ts"), (start + length).alias("end_ts"),
        F.when(F.col("event_id") % 13 == 0, " ").otherwise(text).alias("text"),
        (F.col("event_id") % 10 == 0).alias("silent"),
        F.when(F.col("event_id") % 17 == 0, "timeout").alias("error"),
    )


def dictation_log(spark, folder):
    log = log_table(_entries(spark, folder))
    return log.select("session_id", "nr", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_ts"), F.col("duration_s").cast("double").alias("duration_s"), "text")


ENTRIES_CTE = """e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts, event_id, round(value, 2) AS v,
  CASE WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 3 = 0 THEN event_type || ' ' || event_type || ' ' || event_type ELSE event_type || ' ' || props END AS text FROM events),
log AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS nr, ts, v,
  CASE WHEN event_id % 10 = 0 THEN '(no speech detected)' WHEN event_id % 17 = 0 THEN '(transcription failed)'
    WHEN event_id % 13 = 0 OR event_id % 3 = 0 THEN '(no speech detected)' ELSE text END AS text FROM e)"""
LOG_SQL = f"""
WITH {ENTRIES_CTE} SELECT session_id, nr, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS start_ts,
  CAST(floor(CAST(round(v * 100) AS BIGINT) / 10.0::DOUBLE + 0.5) / 10 AS DOUBLE) AS duration_s, text FROM log"""


def dictation_sheet(spark, folder):
    return reports.dictation_sheet(log_table(_entries(spark, folder))).select("session_id", "#", "Start", "Transcription")


DICTATION_SHEET_SQL = f"""
WITH {ENTRIES_CTE} SELECT session_id, nr AS "#", strftime(ts, '%H:%M:%S') AS "Start", text AS "Transcription" FROM log"""


def _echo(row):
    return f"samples {len(row['pcm'])} first {row['pcm'][0]:.3f}"


def transcript_log_of_vectors(spark, folder):
    """Vectors stand in for recordings; the model reports what it was given."""
    vectors = table(spark, folder, "embeddings")
    start = F.timestamp_seconds(F.col("vec_id") * 60)
    entries = vectors.select(
        F.col("label").cast("string").alias("session_id"), start.alias("start_ts"),
        F.timestamp_seconds(F.col("vec_id") * 60 + 4).alias("end_ts"), F.lit(8000).alias("sample_rate"),
        F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * F.lit(0.01).cast("float"))).otherwise(F.col("embedding")).alias("pcm"),
    )
    log = transcript_log(entries, safe_rows(_echo))
    return log.select("session_id", "nr", F.unix_seconds("start_ts").alias("start_s"), F.regexp_replace("text", "first .*", "").alias("text"))


TRANSCRIPT_LOG_SQL = """
SELECT CAST(label AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nr, vec_id * 60 AS start_s,
  CASE WHEN vec_id % 9 = 0 THEN '(no speech detected)' ELSE 'samples ' || (2 * len(embedding)) || ' ' END AS text FROM embeddings"""


def live_transcript(spark, folder):
    return speech.live_transcript(conversations(spark, folder), ["conv_id"], ["turn"])


LIVE_SQL = f"""
WITH RECURSIVE q AS ({QUALITY_SQL.replace("turn % 3", "3")})
SELECT c.conv_id, string_agg({sql_trim('text')}, ' ' ORDER BY c.turn) AS transcript
FROM conversations c JOIN q ON q.conv_id = c.conv_id AND q.turn = c.turn AND q.n = -1 AND q.quality WHERE {sql_trim('text')} <> '' GROUP BY c.conv_id"""


def audio_windows(spark, folder):
    recordings = table(spark, folder, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10).cast("bigint").alias("samples"))
    return speech.audio_windows(recordings)


WINDOWS_SQL = """
WITH r AS (SELECT o_orderkey, CAST(floor(o_totalprice * 10) AS BIGINT) AS samples FROM orders)
SELECT o_orderkey, samples, w AS window_no, w * 320000 AS from_sample, least(w * 320000 + 480000, samples) AS to_sample
FROM r, unnest(range(0, greatest(CAST(ceil((samples - 480000) / 320000.0) AS BIGINT), 0) + 1)) AS q(w)"""


def _clock(frames):
    """Reports every second of a window as one segment."""
    import pandas as pd

    for frame in frames:
        rows = [
            (row.recording_id, row.window_no, row.offset_s, row.is_last, float(second), f"second {row.offset_s + second:.0f}")
            for row in frame.itertuples()
            for second in range(0, len(row.pcm))
        ]
        yield pd.DataFrame(rows, columns=["recording_id", "window_no", "offset_s", "is_last", "start_s", "text"])


def transcribe_long_vectors(spark, folder):
    """Vectors at one sample a second stand in for recordings of a minute."""
    recordings = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("recording_id"), F.lit(1).alias("sample_rate"), F.col("embedding").alias("pcm")
    )
    return transcribe_long(recordings, _clock, rate=1)


TRANSCRIBE_SQL = """
SELECT CAST(vec_id AS VARCHAR) AS recording_id, string_agg(printf('[%02d:%02d] second %d', s // 60, s % 60, s), chr(10) ORDER BY s) AS transcript
FROM embeddings, unnest(range(0, len(embedding))) AS r(s) GROUP BY vec_id"""


def _clock_with_gaps(frames):
    """The clock, but the second window of every third recording is beyond it."""
    for frame in frames:
        if int(frame["recording_id"].iloc[0]) % 3 == 0 and frame["window_no"].iloc[0] == 1:
            raise RuntimeError("cannot hear")
        yield from _clock([frame])


def _recordings(spark, folder):
    return framed(
        table(spark, folder, "embeddings").select(
            F.col("vec_id").cast("string").alias("recording_id"), F.lit(1).alias("sample_rate"), F.col("embedding").alias("pcm")
        ),
        frame_samples=7,
    )


def transcribe_failures(spark, folder):
    return transcribe_frames(_recordings(spark, folder), _clock_with_gaps, rate=1).failures


TRANSCRIBE_FAILURES_SQL = """
SELECT CAST(vec_id AS VARCHAR) AS recording_id, 1::BIGINT AS window_no, 'RuntimeError: cannot hear' AS error
FROM embeddings WHERE vec_id % 3 = 0 AND len(embedding) > 30"""


def transcribe_with_gaps(spark, folder):
    """What is left of recordings one of whose windows failed."""
    return transcribe_frames(_recordings(spark, folder), _clock_with_gaps, rate=1).texts


TRANSCRIBE_GAPS_SQL = """
SELECT CAST(vec_id AS VARCHAR) AS recording_id, string_agg(printf('[%02d:%02d] second %d', s // 60, s % 60, s), chr(10) ORDER BY s) AS transcript
FROM embeddings, unnest(range(0, len(embedding))) AS r(s)
WHERE vec_id % 3 <> 0 OR len(embedding) <= 30 OR s < 25 OR (s >= 45 AND len(embedding) > 50) GROUP BY vec_id"""


def resample_framed(spark, folder):
    """Vectors at 40 units a second as recordings in frames of 7 samples, brought to 16; whole again."""
    frames = _recordings(spark, folder).withColumn("sample_rate", F.lit(40))
    done = resample_frames(frames, 16)
    parts = done.groupBy("recording_id", "total").agg(F.array_sort(F.collect_list(F.struct("start", "pcm"))).alias("parts"))
    samples = F.flatten(F.transform("parts", lambda part: part["pcm"]))
    return parts.select("recording_id", "total", F.posexplode(samples).alias("at", "sample")).withColumn("sample", rounded(F.col("sample").cast("double"), 4))


RESAMPLE_FRAMED_SQL = """
WITH r AS (SELECT vec_id, embedding AS e, len(embedding) AS n, CAST(floor(len(embedding) / 2.5 + 0.5) AS BIGINT) AS total FROM embeddings),
p AS (SELECT *, i * 2.5 - floor(i * 2.5) AS share, CAST(floor(i * 2.5) AS BIGINT) AS low FROM r, unnest(range(0, total)) AS q(i))
SELECT CAST(vec_id AS VARCHAR) AS recording_id, total, i::INT AS at,
  round(CAST(e[low + 1]::FLOAT::DOUBLE * (1 - share) + e[least(low + 1, n - 1) + 1]::FLOAT::DOUBLE * share AS FLOAT)::DOUBLE, 4) + 0.0 AS sample
FROM p"""


# --- translation ---------------------------------------------------------------------------------
GLOSSARY = {"the": "de", "and": "en", "is": "is", "of": "van", "in": "in"}


def _glossary_line(row):
    line = re.sub(r"\b(the|and|is|of|in)\b", lambda m: GLOSSARY[m[0]], row["line"], flags=re.ASCII)
    return "" if row["line"].startswith("Th ") else line


def _sql_glossary(value: str) -> str:
    for word, other in GLOSSARY.items():
        value = f"regexp_replace({value}, '\\b{word}\\b', '{other}', 'g')"
    return value


_LINE = f"CASE WHEN {sql_trim('line')} = '' OR starts_with(line, 'Th ') THEN line ELSE {sql_trim(_sql_glossary('line'))} END"


def translate_documents(spark, folder):
    done, _ = translate(documents(spark, folder), "eng_Latn", "nld_Latn", safe_rows(_glossary_line))
    return done


TRANSLATE_SQL = f"""
SELECT doc_id, string_agg({_LINE}, chr(10) ORDER BY i) AS translated
FROM (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(i)) GROUP BY doc_id"""


def translate_paragraphs(spark, folder):
    """The form for word processor files: blank paragraphs go, blank lines separate the rest."""
    done, _ = translate(documents(spark, folder), "eng_Latn", "nld_Latn", safe_rows(_glossary_line), paragraphs_only=True)
    return done


TRANSLATE_PARAGRAPHS_SQL = TRANSLATE_SQL.replace("chr(10) ORDER", "chr(10) || chr(10) ORDER").replace(
    ") GROUP BY doc_id", f") WHERE {sql_trim('line')} <> '' GROUP BY doc_id"
)


def translation_failures(spark, folder):
    _, bad = translate(documents(spark, folder), "eng_Latn", "nld_Latn", safe_rows(_glossary_line))
    return bad


FAILURES_SQL = """
SELECT DISTINCT sha256(line) AS line_id, 'the model returned an empty text' AS error
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE starts_with(line, 'Th ')"""


def translate_sheet(spark, folder):
    def upper(row):
        return row["line"].upper()

    done, _ = translate_columns(_sheet(spark, folder), "row", ["priority", "status"], "eng_Latn", "nld_Latn", safe_rows(upper))
    return done


TRANSLATE_SHEET_SQL = f"""
WITH {SHEET_CTE} SELECT *, CASE WHEN trim(coalesce(priority, '')) = '' THEN '' ELSE upper(priority) END AS "priority (Translated)",
  CASE WHEN trim(status) = '' THEN '' ELSE upper(status) END AS "status (Translated)" FROM sheet"""


# --- summaries -----------------------------------------------------------------------------------
def _brief(row):
    user = row["user"]
    return f"<think>{len(user)}</think> {len(user)} chars"


def summarize_documents(spark, folder):
    return summarize(documents(spark, folder), safe_rows(_brief))


SUMMARIZE_SQL = f"""
WITH RECURSIVE {FIXED_CTE},
long AS (SELECT doc_id, string_agg(length('Part ' || (chunk_idx + 1) || ' of ' || parts || ':' || chr(10) || chr(10) || text) || ' chars',
    chr(10) || chr(10) ORDER BY chunk_idx) AS facts FROM windows GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(d.text) <= 6000 THEN 'single' ELSE 'multi' END AS route, false AS truncated,
  CASE WHEN length(d.text) <= 6000 THEN length(d.text) + 24 ELSE length(facts) + length('Collected facts:' || chr(10) || chr(10)) END || ' chars' AS summary,
  NULL::VARCHAR AS error
FROM documents d LEFT JOIN long USING (doc_id) WHERE {sql_trim("coalesce(d.text, '')")} <> ''"""


def summary_failures(spark, folder):
    """A model that fails on every second part and on the single request of every fifth document."""

    def model(row):
        if row["user"].startswith("Part 2 of"):
            raise ValueError("part")
        if row["user"].startswith("Document") and row["doc_id"] % 5 == 0:
            raise ValueError("whole")
        return "fine"

    return summarize(documents(spark, folder), safe_rows(model)).select("doc_id", "route", "summary", "error")


SUMMARY_FAILURES_SQL = f"""
SELECT doc_id, CASE WHEN length(text) <= 6000 THEN 'single' ELSE 'multi' END AS route,
  CASE WHEN length(text) > 6000 OR doc_id % 5 <> 0 THEN 'fine' END AS summary,
  CASE WHEN length(text) > 6000 THEN 'part 2: ValueError: part' WHEN doc_id % 5 = 0 THEN 'ValueError: whole' END AS error
FROM documents WHERE {sql_trim("coalesce(text, '')")} <> ''"""


def merge_rounds(spark, folder):
    """One round of merging with the windows of long documents as their facts."""
    asked = fact_requests(routed(documents(spark, folder)), "doc_id", "text")
    facts = asked.select("doc_id", "language", "chunk_idx", F.col("user").alias("fact"), F.lit(None).cast("string").alias("part_error"))
    groups = fact_groups(facts, "doc_id", 3500)
    return groups.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "groups", "facts")


MERGE_ROUNDS_SQL = f"""
WITH RECURSIVE {FIXED_CTE},
f AS (SELECT w.doc_id, w.chunk_idx, 'Part ' || (w.chunk_idx + 1) || ' of ' || parts || ':' || chr(10) || chr(10) || w.text AS fact
  FROM windows w JOIN documents d ON d.doc_id = w.doc_id WHERE length(d.text) > 6000),
p AS (SELECT *, coalesce(sum(length(fact) + 2) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
g AS (SELECT doc_id, least(CAST(floor(before / 3500) AS BIGINT), chunk_idx // 2) AS g, string_agg(fact, chr(10) || chr(10) ORDER BY chunk_idx) AS facts FROM p GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS chunk_idx, count(*) OVER (PARTITION BY doc_id) AS groups, facts FROM g"""


def single_pass_summaries(spark, folder):
    """Documents that fit one prompt: the model reports the length of its prompt. The route is chosen
    before any model runs, so long documents cost nothing here."""
    short = documents(spark, folder).filter(F.length("text") <= 6000)
    return summarize(short, safe_rows(_brief)).select("doc_id", "summary", "truncated")


SINGLE_SQL = """
SELECT doc_id, (length(text) + 24) || ' chars' AS summary, false AS truncated FROM documents WHERE length(text) <= 6000 AND text <> ''"""


def routed_documents(spark, folder):
    return routed(documents(spark, folder)).select("doc_id", "language", "route")


ROUTED_SQL = f"""
WITH q AS ({NL_EN_SQL}) SELECT q.doc_id, language, CASE WHEN length(text) <= 6000 THEN 'single' ELSE 'multi' END AS route
FROM q JOIN documents d ON d.doc_id = q.doc_id WHERE text <> ''"""


def fact_request_table(spark, folder):
    asked = fact_requests(routed(documents(spark, folder)), "doc_id", "text")
    return asked.select("doc_id", "language", "chunk_idx", "user", "max_tokens", "temperature")


FACTS_SQL = f"""
WITH RECURSIVE {FIXED_CTE}, q AS ({NL_EN_SQL})
SELECT d.doc_id, language, chunk_idx, 'Part ' || (chunk_idx + 1) || ' of ' || parts || ':' || chr(10) || chr(10) || w.text AS "user",
  1500 AS max_tokens, 0.1::DOUBLE AS temperature
FROM documents d JOIN q ON q.doc_id = d.doc_id LEFT JOIN windows w ON w.doc_id = d.doc_id WHERE length(d.text) > 6000"""


CHECKS = {
    "text_cells": Check(text_cells, CELLS_SQL),
    "sheet_text": Check(sheet_text, SHEET_TEXT_SQL),
    "preview_rows": Check(preview_rows, PREVIEW_SQL),
    "sheet_stats": Check(sheet_stats, STATS_SQL),
    "comparison_report": Check(comparison_report, COMPARISON_SQL),
    "markdown_report": Check(markdown_report, MARKDOWN_SQL),
    "dictation_log": Check(dictation_log, LOG_SQL),
    "dictation_sheet": Check(dictation_sheet, DICTATION_SHEET_SQL),
    "transcript_log": Check(transcript_log_of_vectors, TRANSCRIPT_LOG_SQL),
    "live_transcript": Check(live_transcript, LIVE_SQL),
    "audio_windows": Check(audio_windows, WINDOWS_SQL),
    "transcribe_long": Check(transcribe_long_vectors, TRANSCRIBE_SQL),
    "transcribe_failures": Check(transcribe_failures, TRANSCRIBE_FAILURES_SQL),
    "transcribe_with_gaps": Check(transcribe_with_gaps, TRANSCRIBE_GAPS_SQL),
    "resample_framed": Check(resample_framed, RESAMPLE_FRAMED_SQL),
    "translate_documents": Check(translate_documents, TRANSLATE_SQL),
    "translate_paragraphs": Check(translate_paragraphs, TRANSLATE_PARAGRAPHS_SQL),
    "translation_failures": Check(translation_failures, FAILURES_SQL),
    "translate_sheet": Check(translate_sheet, TRANSLATE_SHEET_SQL),
    "summarize_documents": Check(summarize_documents, SUMMARIZE_SQL),
    "summary_failures": Check(summary_failures, SUMMARY_FAILURES_SQL),
    "merge_rounds": Check(merge_rounds, MERGE_ROUNDS_SQL),
    "single_pass_summaries": Check(single_pass_summaries, SINGLE_SQL),
    "routed_documents": Check(routed_documents, ROUTED_SQL),
    "fact_requests": Check(fact_request_table, FACTS_SQL),
}
