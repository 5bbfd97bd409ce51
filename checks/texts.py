"""Text functions over documents, conversations, pages, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import SPACES, Check, joined, quoted, rounded, sql_trim, sql_words, table
from clinspark import fixed_values as fixed
from clinspark.functions import audio, chunking, language, prompts, replies, signals
from clinspark.functions import text as text_functions
from clinspark.operators import speech
from clinspark.operators.ordering import join_ordered
from clinspark.session import spread

SP = SPACES


def documents(spark, folder):
    return spread(table(spark, folder, "documents"))


def conversations(spark, folder):
    return table(spark, folder, "conversations")


# --- counts and pieces ---------------------------------------------------------------------------
def doc_stats(spark, folder):
    stats = text_functions.document_stats("text")
    return documents(spark, folder).select(
        "doc_id", *[value.alias(name) for name, value in stats.items()]
    )


DOC_STATS_SQL = f"""
SELECT doc_id,
  len(list_filter(regexp_split_to_array(text, '\\n+'), lambda p: {sql_trim('p')} <> '')) AS paragraphs,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda p: {sql_trim('p')} <> '')) AS sentences,
  len(list_filter(regexp_split_to_array(text, '{SP}+'), lambda p: p <> '')) AS words,
  length(text) AS characters,
  length(regexp_replace(text, '{SP}', '', 'g')) AS characters_no_spaces
FROM documents"""


def paragraphs(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.posexplode(text_functions.split_paragraphs("text")).alias("n", "paragraph")
    )


def sentences(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.posexplode(text_functions.split_sentences("text")).alias("n", "sentence")
    )


def pieces_sql(pattern: str, name: str) -> str:
    return f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{pattern}'),
    lambda x: {sql_trim('x')}), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, parts[i] AS {name}
FROM p, unnest(range(1, len(parts) + 1)) AS r(i)"""


def clean_text(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text_functions.clean_text("text").alias("cleaned")
    )


CLEAN_SQL = f"""
SELECT doc_id, {sql_trim(f"regexp_replace(text, '{SP}+', ' ', 'g')")} AS cleaned FROM documents"""


def preview_text(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text_functions.preview_text("text").alias("preview")
    )


PREVIEW_SQL = """
SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview
FROM documents"""


def route_by_length(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text_functions.route_by_length("text", fixed.SINGLE_PASS_LIMIT).alias("route")
    )


ROUTE_SQL = """
SELECT doc_id, CASE WHEN length(text) <= 6000 THEN 'single' ELSE 'multi' END AS route FROM documents"""


def translatable(spark, folder):
    lines = documents(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.when(text_functions.translatable("line", "eng_Latn", "nld_Latn"), 1)).alias("to_translate"),
        F.count(F.when(text_functions.translatable("line", "nld_Latn", "nld_Latn"), 1)).alias("same_language"),
    )


TRANSLATABLE_SQL = f"""
SELECT doc_id, CAST(count(*) FILTER ({sql_trim('line')} <> '') AS BIGINT) AS to_translate,
       CAST(0 AS BIGINT) AS same_language
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id"""


# --- language ------------------------------------------------------------------------------------
def detect_language_nl_en(spark, folder):
    return documents(spark, folder).select(
        "doc_id", language.detect_language_nl_en("text").alias("language")
    )


NL_EN_SQL = f"""
WITH s AS (SELECT doc_id, lower(text) AS t FROM documents),
c AS (SELECT doc_id, t,
  len(regexp_extract_all(t, '\\b(?:{sql_words(fixed.DUTCH_WORDS)})\\b'))
    + 2 * len(regexp_extract_all(t, '\\bwordt\\b')) AS nl,
  len(regexp_extract_all(t, '\\b(?:{sql_words(fixed.ENGLISH_WORDS)})\\b')) AS en FROM s)
SELECT doc_id, CASE WHEN nl > en * 1.2 THEN 'Dutch' WHEN en > nl * 1.2 THEN 'English'
  WHEN regexp_matches(t, 'ij|oe|ui|aa|ee|oo|uu') THEN 'Dutch'
  ELSE 'the same language as the source text' END AS language FROM c"""


def detect_language_five(spark, folder):
    return documents(spark, folder).select(
        "doc_id", language.detect_language_five("text").alias("language")
    )


def _five_counts() -> str:
    counts = []
    for code, words in fixed.FIVE_LANGUAGE_WORDS.items():
        one_each = " + ".join(f"len(regexp_extract_all(t, '\\b{word}\\b'))" for word in words)
        counts.append(f"{one_each} AS {code}")
    return ", ".join(counts)


FIVE_SQL = f"""
WITH s AS (SELECT doc_id, length(text) AS n, lower(text) AS t FROM documents),
c AS (SELECT doc_id, n, {_five_counts()} FROM s),
b AS (SELECT *, greatest(eng, nld, deu, fra, spa) AS top,
  CASE greatest(eng, nld, deu, fra, spa) WHEN eng THEN 'eng' WHEN nld THEN 'nld' WHEN deu THEN 'deu'
    WHEN fra THEN 'fra' ELSE 'spa' END AS best FROM c)
SELECT doc_id, CASE WHEN n < 40 THEN NULL WHEN best <> 'eng' AND top < eng * 1.3 THEN 'eng'
  WHEN top < 3 THEN NULL ELSE best END AS language FROM b"""


# --- names of files, dates, sizes, times ---------------------------------------------------------
def sanitize_path(spark, folder):
    urls = table(spark, folder, "pages").select("page_id", F.col("url").alias("raw"))
    first_line = table(spark, folder, "documents").select(
        (-F.col("doc_id") - 1).alias("page_id"), F.col("text").alias("raw")
    )
    return urls.unionByName(first_line).select(
        "page_id",
        text_functions.sanitize_path("raw").alias("folder"),
        text_functions.sanitize_pdf_name("raw").alias("pdf"),
    )


SANITIZE_SQL = f"""
WITH r AS (SELECT page_id, url AS raw FROM pages UNION ALL SELECT -doc_id - 1, text FROM documents),
s AS (SELECT page_id, raw,
  {sql_trim('''regexp_replace(regexp_replace(raw, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '_+', '_', 'g')''')} AS f,
  regexp_replace(CASE WHEN {sql_trim('raw')} = '' THEN 'merged.pdf' ELSE {sql_trim('raw')} END,
                 '[\\\\/:*?"<>|]', '_', 'g') AS p FROM r)
SELECT page_id, CASE WHEN f = '' THEN 'unknown' ELSE f END AS folder,
  CASE WHEN lower(right(p, 4)) = '.pdf' THEN p ELSE p || '.pdf' END AS pdf FROM s"""


def format_dicom_date(spark, folder):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(
        F.date_format("o_orderdate", "yyyyMMddHH")
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", text_functions.format_dicom_date(raw).alias("shown")
    )


DICOM_DATE_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y%m')
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown FROM orders"""


def human_size(spark, folder):
    size = (F.col("l_quantity") * F.pow(F.lit(7.0), F.col("l_linenumber").cast("double") * 1.7)).cast("bigint")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        text_functions.human_size(size).alias("size"),
        text_functions.human_size(size, with_gigabytes=False).alias("pdf_size"),
    )


HUMAN_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey,
  CAST(trunc(l_quantity * pow(7.0, CAST(l_linenumber AS DOUBLE) * 1.7)) AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10)
    WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10)
    ELSE printf('%.2f GB', floor(b / 1073741824.0::DOUBLE * 100 + 0.5) / 100) END AS size,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10)
    ELSE printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS pdf_size FROM s"""


def format_seconds(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", text_functions.format_seconds(F.col("value") * 60).alias("shown")
    )


SECONDS_SQL = """
WITH s AS (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS t FROM events)
SELECT event_id, CASE WHEN t >= 3600 THEN printf('%02d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60)
  ELSE printf('%02d:%02d', t // 60, t % 60) END AS shown FROM s"""


def timestamped_text(spark, folder):
    spoken = conversations(spark, folder).select(
        "conv_id", "turn", "text", (F.col("turn") * 17.5).alias("start_s")
    )
    return speech.timestamped_text(spoken, ["conv_id"], ["turn"])


TIMESTAMPED_SQL = f"""
SELECT conv_id, string_agg('[' || CASE WHEN t >= 3600
    THEN printf('%02d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60)
    ELSE printf('%02d:%02d', t // 60, t % 60) END || '] ' || {sql_trim('text')}, chr(10) ORDER BY turn) AS transcript
FROM (SELECT *, CAST(floor(turn * 17.5) AS BIGINT) AS t FROM conversations) GROUP BY conv_id"""


def join_in_order(spark, folder):
    return join_ordered(conversations(spark, folder), ["conv_id"], ["turn"], "text", "\n\n", "joined")


JOIN_SQL = """
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS joined FROM conversations GROUP BY conv_id"""


# --- signals -------------------------------------------------------------------------------------
TYPES = ("PERSON", "LOCATION", "DATE", "PHONE", "EMAIL", "ADDRESS", "ORGANIZATION", "ID_NUMBER", "AGE", "OTHER")
TYPE_SQL = "[" + ", ".join(f"'{name}'" for name in TYPES) + "]"


def _typed_lines(spark, folder):
    """Every line of every document with a type that rotates over the lines."""
    lines = documents(spark, folder).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "entity")
    )
    kinds = F.array(*map(F.lit, TYPES))
    return lines.withColumn("type", F.get(kinds, F.pmod(F.col("n") + F.col("doc_id"), F.lit(10)).cast("int")))


LINES_CTE = f"""lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, parts[i] AS entity,
    ({TYPE_SQL})[(i - 1 + doc_id) % 10 + 1] AS type
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(i))"""


def strong_pii_signal(spark, folder):
    return _typed_lines(spark, folder).select(
        "doc_id", "n", "type", signals.has_strong_pii_signal("entity", "type").alias("strong")
    )


_NS = f"[^{fixed.SPACE_CLASS}@]"
_ORGS = sql_words(fixed.MEDICAL_ORGANISATIONS)
_TITLES = sql_words(fixed.CARE_TITLES)
STRONG_SQL = f"""
WITH {LINES_CTE}, t AS (SELECT doc_id, n, type, {sql_trim('entity')} AS e FROM lines)
SELECT doc_id, n, type, e <> '' AND (type IN ('EMAIL', 'PHONE', 'ADDRESS')
  OR regexp_matches(e, '{_NS}+@{_NS}+\\.{_NS}+')
  OR regexp_matches(e, '\\+?\\d[\\d{fixed.SPACE_CLASS}().-]{{6,}}\\d')
  OR (type IN ('ID_NUMBER', 'DATE', 'AGE') AND regexp_matches(e, '\\d'))
  OR (type = 'DATE' AND regexp_matches(e, '(?i)\\b(?:{sql_words(fixed.DUTCH_MONTHS)})\\b'))
  OR regexp_matches(e, '(?i)\\b\\d{{4}}{SP}?[A-Z]{{2}}\\b')
  OR (regexp_matches(e, '(?i)\\b(?:{sql_words(fixed.STREET_WORDS)})\\b') AND regexp_matches(e, '(?i)\\b\\d+[a-z]?\\b'))
  OR regexp_matches(e, '(?i)\\b(?:{_TITLES})\\b') OR regexp_matches(e, '(?i)\\b(?:{_ORGS})\\b')
  OR (type = 'PERSON' AND regexp_matches(e, {quoted(signals.NAME_SHAPE)}))
  OR (type IN ('LOCATION', 'ORGANIZATION') AND regexp_matches(e, {quoted(signals.PLACE_SHAPE)}))) AS strong
FROM t"""


def obvious_garbage(spark, folder):
    return _typed_lines(spark, folder).select(
        "doc_id", "n", "type", signals.is_obvious_garbage("entity", "type").alias("garbage")
    )


_STOP = ", ".join(quoted(phrase) for phrase in fixed.STOP_PHRASES)
GARBAGE_SQL = f"""
WITH {LINES_CTE}, t AS (SELECT *, {sql_trim(f"regexp_replace(lower(entity), '{SP}+', ' ', 'g')")} AS plain,
  regexp_split_to_array(entity, '{SP}+') AS parts FROM lines)
SELECT doc_id, n, type, plain IN ({_STOP})
  OR (type = 'ID_NUMBER' AND NOT regexp_matches(entity, '\\d'))
  OR (type = 'LOCATION' AND length(entity) < 3 AND NOT regexp_matches(entity, '\\d'))
  OR regexp_matches(plain, '^(?:{sql_words(fixed.CONVERSATION_OPENINGS)})\\b')
  OR (type IN ('PERSON', 'ORGANIZATION') AND len(parts) > 1
      AND len(list_filter(parts, lambda w: regexp_matches(w, '^[A-ZÀ-ɏ]'))) = 0) AS garbage FROM t"""


def quality_transcript(spark, folder):
    looped = conversations(spark, folder).withColumn(
        "text",
        F.when(F.col("turn") % 3 == 1, F.repeat(F.concat(F.substring_index("text", " ", 2), F.lit(" ")), 3))
        .when(F.col("turn") % 3 == 2, F.concat(F.substring_index("text", " ", 1), F.lit(" "), F.substring_index("text", " ", 1), F.lit(" "), F.substring_index("text", " ", 3)))
        .otherwise(F.col("text")),
    )
    lines = looped.select("conv_id", "turn", F.lit(-1).alias("n"), "text").unionByName(
        looped.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    )
    return lines.select(
        "conv_id", "turn", "n", signals.is_quality_transcript("text").alias("quality")
    )


_INVENTED = sql_words(
    f"(?:{pattern.replace('SPACE', SP)})" for pattern in fixed.INVENTED_TRANSCRIPTS
)
QUALITY_SQL = f"""
WITH base AS (SELECT conv_id, turn, CASE turn % 3
    WHEN 1 THEN repeat(array_to_string(string_split(text, ' ')[1:2], ' ') || ' ', 3)
    WHEN 2 THEN string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[1] || ' ' || array_to_string(string_split(text, ' ')[1:3], ' ')
    ELSE text END AS text FROM conversations),
lines AS (SELECT conv_id, turn, -1 AS n, text FROM base UNION ALL
  SELECT conv_id, turn, CAST(i - 1 AS INTEGER), parts[i] FROM
   (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM base), unnest(range(1, len(parts) + 1)) AS r(i)),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '{SP}+'), lambda x: x <> '') AS words FROM lines)
SELECT conv_id, turn, n, NOT (length(text) < 2 OR regexp_matches(text, '(?i){_INVENTED}')
  OR (len(words) >= 3 AND coalesce(list_max(list_transform(list_distinct(words),
        lambda x: len(list_filter(words, lambda y: y = x)))), 0) / len(words) > 0.6)
  OR (len(words) >= 4 AND ({" OR ".join(f"len(list_filter(range(1, len(words) + 1), lambda i: words[i] <> words[(i - 1) % {k} + 1])) = 0" for k in (1, 2, 3))}))) AS quality
FROM w"""


def page_kind(spark, folder):
    lines = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return lines.select("doc_id", "page", signals.page_kind("text").alias("kind"))


PAGE_KIND_SQL = f"""
WITH {LINES_CTE} SELECT doc_id, n AS page,
  CASE WHEN length({sql_trim('entity')}) < 20 THEN 'ocr' ELSE 'text' END AS kind FROM lines"""


def valid_spans(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id",
        F.substring(F.col("event_type"), F.lit(1), (F.col("event_id") % 4).cast("int")).alias("entity"),
        F.when(F.col("user_id") % 7 == 0, F.lit("")).otherwise(F.upper("event_type")).alias("type"),
        (F.pmod(F.col("value"), F.lit(1.0))).alias("score"),
    )
    return events.select(
        "event_id",
        signals.is_valid_span("entity", "type", "score").alias("valid"),
        signals.is_valid_span("entity", "type", "score", fixed.ZERO_SHOT_THRESHOLD).alias("zero_shot_valid"),
    )


VALID_SQL = """
WITH s AS (SELECT event_id, length(event_type[1:event_id % 4]) AS n, user_id % 7 <> 0 AS typed, value % 1.0 AS score FROM events)
SELECT event_id, n >= 2 AND typed AND score > 0.1 AS valid,
  n >= 2 AND typed AND score > 0.1 AND score >= 0.3 AS zero_shot_valid FROM s"""


# --- replies -------------------------------------------------------------------------------------
def _replies(spark, folder):
    """Model-like replies built from every conversation turn; some are damaged."""
    number = F.col("turn") % 6
    words = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) > 0)
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    first, second = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    good = F.format_string('[{"entity": "%s", "type": "PERSON"}, {"entity": "%s", "type": "DATE", "x": 1}]', first, second)
    reply = (
        F.when(number == 0, good)
        .when(number == 1, F.concat(F.lit("<think>[1]\n</think> Sure:\n"), good, F.lit(" done ]")))
        .when(number == 2, F.format_string('[{"entity": "%s"', first))
        .when(number == 3, F.format_string('[{"entity": "", "text": "%s"}, {"value": "%s", "type": "AGE"}, {"name": "  "}]', first, second))
        .when(number == 4, F.lit("No entities found."))
        .otherwise(F.format_string('[{"entity": "%s]x", "type": "OTHER"}]', first))
    )
    return conversations(spark, folder).select("conv_id", "turn", reply.alias("reply"))


REPLIES_CTE = """r AS (SELECT conv_id, turn, CASE turn % 6
  WHEN 0 THEN good WHEN 1 THEN '<think>[1]' || chr(10) || '</think> Sure:' || chr(10) || good || ' done ]'
  WHEN 2 THEN '[{"entity": "' || a || '"'
  WHEN 3 THEN '[{"entity": "", "text": "' || a || '"}, {"value": "' || b || '", "type": "AGE"}, {"name": "  "}]'
  WHEN 4 THEN 'No entities found.' ELSE '[{"entity": "' || a || ']x", "type": "OTHER"}]' END AS reply
 FROM (SELECT *, '[{"entity": "' || a || '", "type": "PERSON"}, {"entity": "' || b || '", "type": "DATE", "x": 1}]' AS good
  FROM (SELECT conv_id, turn, coalesce(regexp_extract_all(text, '[A-Za-z]+')[1], '') AS a,
   coalesce(regexp_extract_all(text, '[A-Za-z]+')[2], '') AS b FROM conversations))),
j AS (SELECT conv_id, turn, regexp_extract(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), '(?s)\\[.*?\\]') AS js FROM r),
items AS (SELECT conv_id, turn, i, json_extract(js, '$[' || (i - 1) || ']') AS item
 FROM (SELECT * FROM j WHERE js <> '' AND json_valid(js)), unnest(range(1, CAST(json_array_length(js) AS BIGINT) + 1)) AS q(i))"""


def parse_entities(spark, folder):
    parsed = _replies(spark, folder).withColumn("items", replies.parse_entity_json("reply"))
    return parsed.select("conv_id", "turn", F.explode("items").alias("item")).select(
        "conv_id", "turn", "item.entity", "item.type"
    )


PARSE_ENTITY_SQL = f"""
WITH {REPLIES_CTE} SELECT conv_id, turn, item->>'entity' AS entity, item->>'type' AS type FROM items
WHERE item->>'entity' IS NOT NULL AND item->>'type' IS NOT NULL AND {sql_trim("(item->>'entity')")} <> ''"""


def parse_rejects(spark, folder):
    return _replies(spark, folder).select(
        "conv_id", "turn", F.explode(replies.parse_reject_json("reply")).alias("entity")
    )


PARSE_REJECT_SQL = f"""
WITH {REPLIES_CTE}, n AS (SELECT conv_id, turn, coalesce(nullif(item->>'entity', ''), nullif(item->>'text', ''),
  nullif(item->>'value', ''), nullif(item->>'name', '')) AS entity FROM items)
SELECT * FROM n WHERE entity IS NOT NULL AND {sql_trim('entity')} <> ''"""


def _spans(spark, folder):
    """Word-piece-like spans: start and length vary with the document, every fourth has no offsets."""
    starts = documents(spark, folder).select(
        "doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(97))).alias("place")
    )
    start = F.when(F.col("place") % 4 != 3, F.col("place"))
    word = F.concat(F.lit("▁"), F.substring(F.col("text"), F.col("place") + 1, F.lit(5)), F.lit(" ##ing"))
    return starts.select(
        "doc_id", "place", "text", start.alias("start"), (start + F.col("doc_id") % 9).cast("int").alias("end"),
        F.when(F.col("place") % 5 == 0, F.lit("")).otherwise(word).alias("word"),
    )


def surface_from_span(spark, folder):
    return _spans(spark, folder).select(
        "doc_id", "place", replies.surface_from_span("text", "start", "end", "word").alias("surface")
    )


SURFACE_SQL = f"""
WITH s AS (SELECT doc_id, CAST(a AS INTEGER) AS place, text, CASE WHEN a % 4 <> 3 THEN a END AS b, doc_id % 9 AS n,
  CASE WHEN a % 5 = 0 THEN '' ELSE chr(9601) || substr(text, a + 1, 5) || ' ##ing' END AS word
 FROM documents, unnest(range(0, length(text) + 1, 97)) AS r(a)),
c AS (SELECT *, b IS NOT NULL AND n > 0 AS has, CASE WHEN b IS NOT NULL AND n > 0 THEN {sql_trim('substr(text, b + 1, n)')} ELSE '' END AS o,
  {sql_trim(f"regexp_replace(replace(regexp_replace(word, '[Ġ▁]', ' ', 'g'), '##', ''), '{SP}+', ' ', 'g')")} AS w FROM s),
f AS (SELECT *, regexp_matches(o, '[\\p{{L}}@]') AS oa, regexp_matches(w, '[\\p{{L}}@]') AS wa,
  regexp_matches(o, '^[\\d{fixed.SPACE_CLASS}.,:/+-]+$') AS num FROM c)
SELECT doc_id, place, CASE WHEN w = '' THEN o WHEN has AND oa AND NOT num THEN o WHEN num AND wa THEN w
  WHEN NOT oa AND wa THEN w WHEN has THEN o ELSE w END AS surface FROM f"""


# --- prompts -------------------------------------------------------------------------------------
def summary_prompts(spark, folder):
    ready = documents(spark, folder).withColumn("language", F.lit("Dutch"))
    ready = ready.withColumn("p", prompts.summary_prompt("text", "language", "soap")).withColumn(
        "m", prompts.merge_prompt("text", "language", None)
    ).withColumn("f", prompts.fact_prompt("text", F.col("doc_id") % 3, F.lit(3), "language"))
    return ready.select(
        "doc_id", F.col("p.system").alias("summary_system"), F.col("p.user").alias("summary_user"),
        F.col("m.user").alias("merge_user"), F.col("m.truncated").alias("truncated"),
        F.col("f.user").alias("fact_user"),
    )


SUMMARY_PROMPT_SQL = """
SELECT doc_id, concat_ws(chr(10) || chr(10), 'You summarise clinical documents.',
    'Write everything, headings included, in Dutch.',
    'Use these sections and mark each heading with ##. Use short bullet points. State nothing that the text does not state; say so when a section has no content. Give the report only.',
    '## Subjective' || chr(10) || 'What the text states on this subject.', '## Objective' || chr(10) || 'What the text states on this subject.',
    '## Assessment' || chr(10) || 'What the text states on this subject.', '## Plan' || chr(10) || 'What the text states on this subject.') AS summary_system,
  'Document to report on:' || chr(10) || chr(10) || text AS summary_user,
  'Collected facts:' || chr(10) || chr(10) || text AS merge_user, false AS truncated,
  'Part ' || (doc_id % 3 + 1) || ' of 3:' || chr(10) || chr(10) || text AS fact_user
FROM documents"""


def detection_prompts(spark, folder):
    turns = conversations(spark, folder).withColumn(
        "entities", F.array(F.struct(F.col("role").alias("entity"), F.lit("PERSON").alias("type")),
                            F.struct(F.col("turn").cast("string").alias("entity"), F.lit("AGE").alias("type")))
    )
    turns = turns.withColumn("d", prompts.detection_prompt("text")).withColumn(
        "v", prompts.validation_prompt("text", "entities")
    )
    return turns.select("conv_id", "turn", F.col("d.user").alias("detect_user"), F.col("v.user").alias("review_user"))


DETECTION_PROMPT_SQL = """
SELECT conv_id, turn, 'Text:' || chr(10) || chr(10) || text AS detect_user,
  'Text:' || chr(10) || text || chr(10) || chr(10) || 'Detected:' || chr(10) || '- "' || role || '" → PERSON'
  || chr(10) || '- "' || turn || '" → AGE' || chr(10) || chr(10) || 'List the mistakes.' AS review_user
FROM conversations"""


# --- audio ---------------------------------------------------------------------------------------
def rms(spark, folder):
    return table(spark, folder, "embeddings").select(
        "vec_id", rounded(audio.rms("embedding")).alias("rms"),
        audio.is_silent("embedding").alias("silent"),
        audio.is_silent("embedding", 0.125).alias("quiet"),
    )


RMS_SQL = """
WITH s AS (SELECT vec_id, sqrt(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS r FROM embeddings)
SELECT vec_id, round(r, 6) AS rms, r < 0.01 AS silent, r < 0.125 AS quiet FROM s"""


def resample(spark, folder):
    rate = F.when(F.col("vec_id") % 3 == 0, 44100).when(F.col("vec_id") % 3 == 1, 8000).otherwise(16000)
    made = table(spark, folder, "embeddings").select("vec_id", audio.resample("embedding", rate).alias("pcm"))
    return made.select("vec_id", F.posexplode("pcm").alias("i", "x")).select("vec_id", "i", (rounded(F.col("x").cast("double"), 5) + F.lit(0.0)).alias("x"))


RESAMPLE_SQL = """
WITH s AS (SELECT vec_id, embedding AS e, CASE vec_id % 3 WHEN 0 THEN 44100 WHEN 1 THEN 8000 ELSE 16000 END / 16000.0::DOUBLE AS ratio FROM embeddings),
i AS (SELECT *, CAST(i AS INTEGER) AS i, i * ratio AS p, CAST(floor(i * ratio) AS BIGINT) AS lo
  FROM s, unnest(range(0, CAST(floor(len(e) / ratio + 0.5) AS BIGINT))) AS r(i))
SELECT vec_id, i, round(CAST(CAST(CAST(e[lo + 1] AS DOUBLE) * (1 - (p - lo))
  + CAST(e[least(lo + 1, len(e) - 1) + 1] AS DOUBLE) * (p - lo) AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS x FROM i"""


# --- chunks --------------------------------------------------------------------------------------
def chunk_text(spark, folder):
    return chunking.explode_chunks(documents(spark, folder), chunking.chunk_text("text"), ["doc_id"])


def _last_of(value: str, marks: tuple[str, ...]) -> str:
    """The last place (from 0) of one of the two-character ``marks`` in ``value``, -1 if there is none."""
    places = (f"CASE WHEN contains({value}, '{mark}') THEN length({value}) - strpos(reverse({value}), '{mark[::-1]}') - 1 ELSE -1 END" for mark in marks)
    return f"greatest({', '.join(places)})"


def chunk_cte(size: int = 2400, overlap: int = 240) -> str:
    """Paragraph chunks as a state machine: a row per step, with the chunk it closes in ``made``.

    ``held`` is the chunk under way, ``rest`` what is left of a paragraph longer than a chunk.
    """
    marks = (". ", "! ", "? ", "; ")
    window = f"substr(rest, 1, {size + 1})"
    space = f"CASE WHEN contains({window}, ' ') THEN length({window}) - strpos(reverse({window}), ' ') ELSE -1 END"
    sentence = _last_of(window, marks)
    best = f"greatest({space}, CASE WHEN {sentence} > {size} * 0.45 THEN {sentence} + 1 ELSE -1 END)"
    tail = f"right(closed, {overlap})"
    line = f"CASE WHEN contains({tail}, chr(10)) THEN length({tail}) - strpos(reverse({tail}), chr(10)) ELSE -1 END"
    turn = f"""CASE WHEN {_last_of(tail, marks)} > {overlap} * 0.35 THEN {_last_of(tail, marks)}
      WHEN {line} > {overlap} * 0.35 THEN {line} ELSE greatest(strpos({tail}, ' ') - 1, 0) END"""
    context = f"CASE WHEN length(closed) <= {overlap} THEN '' ELSE {sql_trim(f'substr({tail}, CASE WHEN {turn} > 0 THEN {turn} + 2 ELSE 1 END)')} END"
    return f"""steps(doc_id, step, ps, i, held, rest, made) AS (
  SELECT doc_id, 0, list_filter(regexp_split_to_array(text, '\n+'), lambda p: {sql_trim('p')} <> ''), 1, '', NULL::VARCHAR, NULL::VARCHAR
  FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, step + 1, ps, CASE WHEN rest IS NULL THEN i + 1 ELSE i END,
    CASE WHEN rest IS NOT NULL OR alone THEN '' WHEN before = '' THEN p ELSE before || chr(10) || p END,
    CASE WHEN rest IS NOT NULL THEN CASE WHEN length(rest) > {size} THEN {sql_trim(f'substr(rest, cut - {min(overlap, size // 5)} + 1)')} END
      WHEN alone THEN {sql_trim('p')} END,
    CASE WHEN rest IS NOT NULL THEN CASE WHEN length(rest) > {size} THEN {sql_trim('substr(rest, 1, cut)')} ELSE rest END WHEN flush THEN closed END
  FROM (
    SELECT *, CASE WHEN NOT flush THEN held WHEN alone THEN '' ELSE {context} END AS before,
      CASE WHEN rest IS NOT NULL AND length(rest) > {size} THEN CASE WHEN {best} < {size} * 0.35 THEN {size} ELSE {best} END END AS cut
    FROM (
      SELECT *, {sql_trim('held')} AS closed, coalesce(alone_, FALSE) AS alone,
        rest IS NULL AND (p IS NULL OR alone_ OR (held <> '' AND length(held) + 1 + length(p) > {size})) AS flush
      FROM (SELECT *, length(p) > {size} AS alone_ FROM (
        SELECT *, CASE WHEN rest IS NULL AND i <= len(ps) THEN ps[i] END AS p FROM steps WHERE rest IS NOT NULL OR i <= len(ps) + 1)))
  )
), chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS chunk_idx, made AS text FROM steps WHERE made <> ''
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM steps WHERE made <> '')
)"""


CHUNK_TEXT_SQL = f"WITH RECURSIVE {chunk_cte()} SELECT doc_id, chunk_idx, text FROM chunks"


def chunk_fixed(spark, folder):
    return chunking.explode_chunks(documents(spark, folder), chunking.chunk_fixed("text"), ["doc_id"])


_SLICE = "substr(text, st + 1, 3000)"
_LAST = "greatest(" + ", ".join(
    f"CASE WHEN contains({_SLICE}, {mark}) THEN length({_SLICE}) - strpos(reverse({_SLICE}), reverse({mark})) - 1 ELSE -1 END"
    for mark in ("'.' || chr(10)", "'. '", "'?' || chr(10)", "'? '")
) + ")"
FIXED_CTE = f"""starts AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS st FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, text, CASE WHEN {_LAST} > 1500 THEN st + {_LAST} + 1 ELSE st + 3000 END - 200 FROM starts WHERE st + 3000 < length(text)),
ends AS (SELECT doc_id, st, {sql_trim(f"substr(text, st + 1, CASE WHEN st + 3000 >= length(text) THEN 3000 WHEN {_LAST} > 1500 THEN {_LAST} + 1 ELSE 3000 END)")} AS piece FROM starts),
windows AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS INTEGER) AS chunk_idx, piece AS text,
  count(*) OVER (PARTITION BY doc_id) AS parts FROM ends WHERE length(piece) > 0)"""
CHUNK_FIXED_SQL = f"WITH RECURSIVE {FIXED_CTE} SELECT doc_id, chunk_idx, text FROM windows"


def chunk_sentences(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.posexplode(chunking.chunk_sentences("text")).alias("chunk_idx", "chunk")
    )


CHUNK_SENTENCES_SQL = f"""
WITH RECURSIVE s AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'),
    lambda x: {sql_trim('x')}), lambda x: x <> '') AS parts FROM documents WHERE length(text) > 500),
one AS (SELECT doc_id, parts[i] AS sentence, i FROM s, unnest(range(1, len(parts) + 1)) AS r(i)),
walk AS (
  SELECT doc_id, i, 0 AS chunk_idx, sentence || '.' AS cur FROM one WHERE i = 1
  UNION ALL
  SELECT w.doc_id, o.i, CASE WHEN length(w.cur) + 1 + length(o.sentence) <= 500 THEN w.chunk_idx ELSE w.chunk_idx + 1 END,
    CASE WHEN length(w.cur) + 1 + length(o.sentence) <= 500 THEN w.cur || ' ' || o.sentence || '.' ELSE o.sentence || '.' END
  FROM walk w JOIN one o ON o.doc_id = w.doc_id AND o.i = w.i + 1)
SELECT doc_id, chunk_idx, arg_max(cur, i) AS chunk FROM walk GROUP BY ALL
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 500"""


CHECKS = {
    "doc_stats": Check(doc_stats, DOC_STATS_SQL),
    "split_paragraphs": Check(paragraphs, pieces_sql("\\n+", "paragraph")),
    "split_sentences": Check(sentences, pieces_sql("[.!?]+", "sentence")),
    "clean_text": Check(clean_text, CLEAN_SQL),
    "preview_text": Check(preview_text, PREVIEW_SQL),
    "route_by_length": Check(route_by_length, ROUTE_SQL),
    "translatable_lines": Check(translatable, TRANSLATABLE_SQL),
    "detect_language_nl_en": Check(detect_language_nl_en, NL_EN_SQL),
    "detect_language_five": Check(detect_language_five, FIVE_SQL),
    "sanitize_path": Check(sanitize_path, SANITIZE_SQL),
    "format_dicom_date": Check(format_dicom_date, DICOM_DATE_SQL),
    "human_size": Check(human_size, HUMAN_SQL),
    "format_seconds": Check(format_seconds, SECONDS_SQL),
    "timestamped_text": Check(timestamped_text, TIMESTAMPED_SQL),
    "join_ordered": Check(join_in_order, JOIN_SQL),
    "has_strong_pii_signal": Check(strong_pii_signal, STRONG_SQL),
    "drop_obvious_garbage": Check(obvious_garbage, GARBAGE_SQL),
    "keep_valid_spans": Check(valid_spans, VALID_SQL),
    "is_quality_transcript": Check(quality_transcript, QUALITY_SQL),
    "page_kind": Check(page_kind, PAGE_KIND_SQL),
    "parse_entity_json": Check(parse_entities, PARSE_ENTITY_SQL),
    "parse_reject_json": Check(parse_rejects, PARSE_REJECT_SQL),
    "surface_from_span": Check(surface_from_span, SURFACE_SQL),
    "summary_prompts": Check(summary_prompts, SUMMARY_PROMPT_SQL),
    "detection_prompts": Check(detection_prompts, DETECTION_PROMPT_SQL),
    "rms_and_silence": Check(rms, RMS_SQL),
    "resample_16k": Check(resample, RESAMPLE_SQL),
    "chunk_text": Check(chunk_text, CHUNK_TEXT_SQL),
    "chunk_fixed": Check(chunk_fixed, CHUNK_FIXED_SQL),
    "chunk_sentences": Check(chunk_sentences, CHUNK_SENTENCES_SQL),
}
