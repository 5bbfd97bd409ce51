"""Rewriting texts, end to end."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from checks.base import Check, table
from checks.detections import RULE_CTE
from checks.texts import chunk_cte, conversations, documents
from clinspark.functions.prompts import DETECTION_SYSTEM
from clinspark.operators.inference import SPAN_COLUMNS, Detector, safe_rows
from clinspark.operators.rewriting import apply_global_mapping, apply_scoped_mapping
from clinspark.plans import anonymize as plan

def _marked(value: str) -> str:
    """``value`` with every letter/digit run between chr(2) and chr(3). Whole-run matching then needs
    no lookaround, which RE2 does not have."""
    return f"regexp_replace({value}, '([\\p{{L}}\\p{{N}}]+)', chr(2) || '\\1' || chr(3), 'g')"


def _rewrite_sql(text: str, pairs: str) -> str:
    """Apply a list of 'entity<1>tag' strings, longest first."""
    entity, tag = _marked("split_part(p, chr(1), 1)"), _marked("split_part(p, chr(1), 2)")
    once = f"regexp_replace(acc, '(?i)' || regexp_escape({entity}), {tag}, 'g')"
    marked = _marked(text)
    done = f"list_reduce(list_prepend({marked}, {pairs}), lambda acc, p: {once})"
    return f"replace(replace({done}, chr(2), ''), chr(3), '')"


FIRST_CTE = f"""{RULE_CTE}, firsts AS (SELECT doc_id, pos, entity, type FROM typed
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(entity) ORDER BY pos) = 1),
numbered AS (SELECT *, '[' || type || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY pos) || ']' AS tag FROM firsts),
entries AS (SELECT doc_id, count(*) AS n, list(entity || chr(1) || tag ORDER BY length(entity) DESC, pos) AS pairs FROM numbered GROUP BY doc_id)"""


def anonymize_documents(spark, folder):
    done = plan.anonymize_rows(documents(spark, folder), chunk_size=None)
    return done.select("doc_id", "lang", F.size("entries").cast("bigint").alias("n_entities"), "anonymized_text")


ANONYMIZE_SQL = f"""
WITH {FIRST_CTE} SELECT d.doc_id, d.lang, coalesce(n, 0) AS n_entities,
  CASE WHEN n IS NULL THEN d.text ELSE {_rewrite_sql('d.text', 'pairs')} END AS anonymized_text
FROM documents d LEFT JOIN entries USING (doc_id)"""


def document_mapping(spark, folder):
    done = plan.anonymize_rows(documents(spark, folder), chunk_size=None)
    return done.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.entity", "e.type", "e.replacement")


DOCUMENT_MAPPING_SQL = f"WITH {FIRST_CTE} SELECT doc_id, entity, type, tag AS replacement FROM numbered"


def anonymize_chunked(spark, folder):
    """The same, detected on overlapping 2400-character chunks as models need them."""
    done = plan.anonymize_rows(documents(spark, folder))
    return done.select("doc_id", F.size("entries").cast("bigint").alias("n_entities"), "anonymized_text")


def anonymize_tables(spark, folder):
    """The table form with document scope (chunks, joins and windows instead of arrays)."""
    return plan.anonymize(documents(spark, folder)).texts.select("doc_id", "anonymized_text")


# Rules over chunks: an entity counts where it is seen first, by chunk and place.
CHUNK_FIRST_CTE = f"""{chunk_cte()}, {RULE_CTE.replace('FROM documents)', 'FROM chunks)').replace('doc_id, text', 'doc_id, chunk_idx, text').replace('doc_id, CAST', 'doc_id, chunk_idx, CAST')},
firsts AS (SELECT doc_id, chunk_idx, pos, entity, type FROM typed
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(entity) ORDER BY chunk_idx, pos) = 1),
numbered AS (SELECT *, '[' || type || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY chunk_idx, pos) || ']' AS tag,
  row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx, pos) AS seq FROM firsts),
entries AS (SELECT doc_id, count(*) AS n, list(entity || chr(1) || tag ORDER BY length(entity) DESC, seq) AS pairs FROM numbered GROUP BY doc_id)"""
_CHUNKED_TEXT = f"CASE WHEN n IS NULL THEN d.text ELSE {_rewrite_sql('d.text', 'pairs')} END AS anonymized_text FROM documents d LEFT JOIN entries USING (doc_id)"
ANONYMIZE_CHUNKED_SQL = f"WITH RECURSIVE {CHUNK_FIRST_CTE} SELECT d.doc_id, coalesce(n, 0) AS n_entities, {_CHUNKED_TEXT}"
ANONYMIZE_TABLES_SQL = f"WITH RECURSIVE {CHUNK_FIRST_CTE} SELECT d.doc_id, {_CHUNKED_TEXT}"


def anonymize_failures(spark, folder):
    """Two passes with a model that is down for every seventh document: those texts are withheld."""

    def model(row):
        if row["doc_id"] % 7 == 0:
            raise RuntimeError("down")
        return "[]"

    done = plan.anonymize(documents(spark, folder), passes=("ner", "llm"), model_fn=safe_rows(model))
    return done.texts.select("doc_id", F.col("anonymized_text").isNull().alias("withheld"), "error")


ANONYMIZE_FAILURES_SQL = """
SELECT doc_id, doc_id % 7 = 0 AS withheld, CASE WHEN doc_id % 7 = 0 THEN 'discover: RuntimeError: down' END AS error
FROM documents"""

WHOLE = (10**9, 0)
GLOBAL_CTE = f"""{RULE_CTE}, firsts AS (SELECT doc_id, pos, entity, type FROM typed
  QUALIFY row_number() OVER (PARTITION BY lower(entity) ORDER BY doc_id, pos) = 1),
numbered AS (SELECT *, '[' || type || '_' || row_number() OVER (PARTITION BY type ORDER BY doc_id, pos) || ']' AS tag,
  row_number() OVER (ORDER BY doc_id, pos) AS seq FROM firsts),
entries AS (SELECT d.doc_id, list(entity || chr(1) || tag ORDER BY length(entity) DESC, seq) AS pairs
  FROM documents d JOIN numbered n ON contains(lower(d.text), lower(n.entity)) GROUP BY d.doc_id)"""


def anonymize_global(spark, folder):
    """One mapping for all documents, numbers in reading order over the whole corpus."""
    done = plan.anonymize(documents(spark, folder), scope="global", chunk_size=WHOLE)
    return done.texts.select("doc_id", "anonymized_text")


ANONYMIZE_GLOBAL_SQL = f"""
WITH {GLOBAL_CTE} SELECT d.doc_id, CASE WHEN pairs IS NULL THEN d.text ELSE {_rewrite_sql('d.text', 'pairs')} END AS anonymized_text
FROM documents d LEFT JOIN entries USING (doc_id)"""


def anonymize_table(spark, folder):
    """Two text columns of a table, one mapping for both."""
    sheet = documents(spark, folder).select("doc_id", "text", "source", "lang")
    return plan.anonymize_table(sheet, "doc_id", ["text", "source"]).texts


ANONYMIZE_TABLE_SQL = f"""
WITH {GLOBAL_CTE} SELECT d.doc_id, CASE WHEN pairs IS NULL THEN d.text ELSE {_rewrite_sql('d.text', 'pairs')} END AS text,
  d.source, d.lang FROM documents d LEFT JOIN entries USING (doc_id)"""


ORGANIZATION = re.compile(r"\bsrc\d+\b")


def _sheet_model(row):
    """Reviews reject nothing; the second pass lists the source cell as an organization."""
    found = ORGANIZATION.search(row["user"]) if row["system"] == DETECTION_SYSTEM else None
    return json.dumps([{"entity": found[0], "type": "ORGANIZATION"}]) if found else "[]"


def anonymize_table_models(spark, folder):
    """Two passes over two columns under a mapping that knows one source already."""
    sheet = documents(spark, folder).select("doc_id", "text", "source", "lang")
    known = spark.createDataFrame([("src0", "ORGANIZATION", "[ORGANIZATION_7]", 1)], "entity string, type string, replacement string, seq long")
    done = plan.anonymize_table(sheet, "doc_id", ["text", "source"], passes=("ner", "llm"), model_fn=safe_rows(_sheet_model), mapping=known)
    return done.texts


ANONYMIZE_TABLE_MODELS_SQL = f"""
WITH {GLOBAL_CTE}, orgs AS (SELECT source, '[ORGANIZATION_' || CASE WHEN source = 'src0' THEN 7
    ELSE 7 + row_number() OVER (PARTITION BY source = 'src0' ORDER BY min(doc_id)) END || ']' AS tag
  FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT d.doc_id, CASE WHEN pairs IS NULL THEN d.text ELSE {_rewrite_sql('d.text', 'pairs')} END AS text,
  coalesce(orgs.tag, d.source) AS source, d.lang, NULL::VARCHAR AS error
FROM documents d LEFT JOIN entries USING (doc_id) LEFT JOIN orgs ON orgs.source = d.source"""


def _brittle_spans(frames):
    """Finds each number of four digits; cannot read every fifth document."""
    for frame in frames:
        if any(doc % 5 == 0 for doc in frame["doc_id"].tolist()):
            raise ValueError("unreadable")
        rows = [
            (doc, chunk, number, "IDCARDNUM", hit[0], hit.start(), hit.end(), 0.9)
            for doc, chunk, text in zip(frame["doc_id"].tolist(), frame["chunk_idx"].tolist(), frame["text"].tolist())
            for number, hit in enumerate(re.finditer(r"(?<![0-9A-Za-z])[0-9]{4}(?![0-9A-Za-z])", text))
        ]
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", *SPAN_COLUMNS])


def anonymize_table_failures(spark, folder):
    """A detector that fails on every fifth row: both columns of those rows are withheld."""
    sheet = documents(spark, folder).select("doc_id", "text", "source", "lang")
    done = plan.anonymize_table(sheet, "doc_id", ["text", "source"], Detector(_brittle_spans, "multilingual_pii"))
    failed = done.failures.groupBy("doc_id").agg(F.count("*").alias("requests"), F.max("pass").alias("pass"))
    shown = done.texts.select("doc_id", F.col("text").isNull().alias("text_withheld"), F.col("source").isNull().alias("source_withheld"), "lang", "error")
    return shown.join(failed, "doc_id", "left").withColumn("asked", F.col("requests") > 0).drop("requests")


ANONYMIZE_TABLE_FAILURES_SQL = """
SELECT doc_id, doc_id % 5 = 0 OR text IS NULL AS text_withheld, doc_id % 5 = 0 OR source IS NULL AS source_withheld, lang,
  CASE WHEN doc_id % 5 = 0 THEN 'detect: ValueError: unreadable' END AS error,
  CASE WHEN doc_id % 5 = 0 THEN 'detect' END AS pass, CASE WHEN doc_id % 5 = 0 THEN TRUE END AS asked
FROM documents"""


# --- rewriting with given mappings ---------------------------------------------------------------
def _turn_words(spark, folder):
    """Per turn, the distinct words of more than six letters with tags by alphabet."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))))
    return conversations(spark, folder).select("conv_id", "turn", F.posexplode(words).alias("seq", "entity")).withColumn(
        "replacement", F.concat(F.lit("<"), F.col("seq").cast("string"), F.lit("$>"))
    )


def apply_scoped(spark, folder):
    texts = conversations(spark, folder).select("conv_id", "turn", "text")
    done = apply_scoped_mapping(texts, _turn_words(spark, folder), ["conv_id", "turn"])
    return done.select("conv_id", "turn", "anonymized_text")


APPLY_SCOPED_SQL = f"""
WITH w AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z]{{7,}}'))) AS ws FROM conversations),
e AS (SELECT conv_id, turn, list(ws[i] || chr(1) || '<' || (i - 1) || '$>' ORDER BY length(ws[i]) DESC, i) AS pairs
  FROM w, unnest(range(1, len(ws) + 1)) AS r(i) GROUP BY ALL)
SELECT c.conv_id, c.turn, CASE WHEN pairs IS NULL THEN text ELSE {_rewrite_sql('text', 'pairs')} END AS anonymized_text
FROM conversations c LEFT JOIN e USING (conv_id, turn)"""


def apply_shared(spark, folder):
    """Every customer name and every order priority word as one large mapping over all texts."""
    texts = documents(spark, folder).select(
        "doc_id", F.concat(F.lit("customer#00000"), F.lpad((F.col("doc_id") % 5000).cast("string"), 4, "0"), F.lit(" wrote: "), "text", F.lit(" 4-not specified")).alias("text")
    )
    names = table(spark, folder, "customer").select(
        F.concat(F.lit("Customer#00000"), F.lpad("c_custkey", 4, "0")).alias("entity"),
        F.concat(F.lit("[PERSON_"), "c_custkey", F.lit("]")).alias("replacement"), F.col("c_custkey").alias("seq"),
    )
    words = table(spark, folder, "orders").select("o_orderpriority").distinct().select(
        F.col("o_orderpriority").alias("entity"), F.lit("[OTHER_1]").alias("replacement"), F.lit(-1).cast("bigint").alias("seq")
    )
    return apply_global_mapping(texts, names.unionByName(words), ["doc_id"])


APPLY_SHARED_SQL = f"""
WITH t AS (SELECT doc_id, 'customer#00000' || lpad(CAST(doc_id % 5000 AS VARCHAR), 4, '0') || ' wrote: ' || text || ' 4-not specified' AS text FROM documents),
m AS (SELECT 'Customer#00000' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS entity, '[PERSON_' || c_custkey || ']' AS tag, c_custkey AS seq FROM customer
  UNION ALL SELECT DISTINCT o_orderpriority, '[OTHER_1]', -1 FROM orders),
e AS (SELECT doc_id, list(entity || chr(1) || tag ORDER BY length(entity) DESC, seq) AS pairs FROM t JOIN m ON contains(lower(t.text), lower(m.entity)) GROUP BY doc_id)
SELECT t.doc_id, t.text, {_rewrite_sql('t.text', "coalesce(pairs, [])")} AS anonymized_text FROM t LEFT JOIN e USING (doc_id)"""

def apply_sequential(spark, folder):
    """Names first, then words that only the names' tags hold: tags are rewritten too."""
    texts = documents(spark, folder).select(
        "doc_id", F.concat(F.lit("customer#00000"), F.lpad((F.col("doc_id") % 5000).cast("string"), 4, "0"), F.lit(" wrote: "), "text").alias("text")
    )
    names = table(spark, folder, "customer").select(
        F.concat(F.lit("Customer#00000"), F.lpad("c_custkey", 4, "0")).alias("entity"),
        F.concat(F.lit("[PERSON_"), "c_custkey", F.lit("]")).alias("replacement"), F.col("c_custkey").alias("seq"),
    )
    words = spark.createDataFrame([("person", "<WHO>", 10**9), ("who", "[SOMEBODY]", 10**9 + 1), ("nobody", "[X]", 10**9 + 2)], names.schema)
    return apply_global_mapping(texts, names.unionByName(words), ["doc_id"], mode="sequential")


APPLY_SEQUENTIAL_SQL = f"""
WITH t AS (SELECT doc_id, 'customer#00000' || lpad(CAST(doc_id % 5000 AS VARCHAR), 4, '0') || ' wrote: ' || text AS text FROM documents),
m AS (SELECT 'Customer#00000' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS entity, '[PERSON_' || c_custkey || ']' AS tag, c_custkey AS seq FROM customer),
w AS (SELECT * FROM (VALUES ('person', '<WHO>', 1000000000), ('who', '[SOMEBODY]', 1000000001), ('nobody', '[X]', 1000000002)) AS v(entity, tag, seq)),
n AS (SELECT doc_id, entity, tag, seq FROM t JOIN m ON contains(lower(t.text), lower(m.entity)) UNION ALL SELECT doc_id, entity, tag, seq FROM t, w),
e AS (SELECT doc_id, list(entity || chr(1) || tag ORDER BY length(entity) DESC, seq) AS pairs FROM n GROUP BY doc_id)
SELECT t.doc_id, t.text, {_rewrite_sql('t.text', "coalesce(pairs, [])")} AS anonymized_text FROM t LEFT JOIN e USING (doc_id)"""

CHECKS = {
    "apply_global_sequential": Check(apply_sequential, APPLY_SEQUENTIAL_SQL),
    "anonymize_table_models": Check(anonymize_table_models, ANONYMIZE_TABLE_MODELS_SQL),
    "anonymize_table_failures": Check(anonymize_table_failures, ANONYMIZE_TABLE_FAILURES_SQL),
    "anonymize_documents": Check(anonymize_documents, ANONYMIZE_SQL),
    "document_mapping": Check(document_mapping, DOCUMENT_MAPPING_SQL),
    "anonymize_chunked": Check(anonymize_chunked, ANONYMIZE_CHUNKED_SQL),
    "anonymize_tables": Check(anonymize_tables, ANONYMIZE_TABLES_SQL),
    "anonymize_failures": Check(anonymize_failures, ANONYMIZE_FAILURES_SQL),
    "anonymize_global": Check(anonymize_global, ANONYMIZE_GLOBAL_SQL),
    "anonymize_table": Check(anonymize_table, ANONYMIZE_TABLE_SQL),
    "apply_scoped_mapping": Check(apply_scoped, APPLY_SCOPED_SQL),
    "apply_global_mapping": Check(apply_shared, APPLY_SHARED_SQL),
}
