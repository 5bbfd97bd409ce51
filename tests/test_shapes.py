"""Plan shapes that matter at scale."""

import pytest
from pyspark.sql import functions as F

from checks import anonymizing, imaging, texts
from clinspark.functions import language, signals
from clinspark.operators import detection, persons
from clinspark.operators.filing import sort_plan
from clinspark.plans.anonymize import anonymize_rows

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_document_anonymizing_has_no_shuffle_and_no_python(documents):
    plan = plan_of(anonymize_rows(documents, chunk_size=None))
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_stay_in_the_jvm(documents):
    frame = documents.select(
        language.detect_language_five("text"), language.detect_language_nl_en("text"),
        signals.has_strong_pii_signal("text", F.lit("PERSON")), signals.is_quality_transcript("text"))
    assert "Python" not in plan_of(frame) and "Exchange" not in plan_of(frame)


def test_only_needed_columns_are_read(documents):
    plan = plan_of(detection.rule_detect(documents, ["doc_id"]))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_first_wins_aggregates_combine_before_the_shuffle(spark, documents):
    found = detection.rule_detect(documents, ["doc_id"])
    plan = plan_of(detection.dedupe_entities(found, ["doc_id"], ["pos"]))
    assert plan.count("partial_min_by") == 1 and plan.count("Exchange") == 1


def test_no_query_plans_a_cartesian_product(spark):
    for name in ("redaction_boxes", "apply_global_mapping"):
        from checks import redaction

        query = (redaction.CHECKS | anonymizing.CHECKS)[name].query
        plan = plan_of(query(spark, SMALL))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_links_join_on_keys(spark):
    df = spark.createDataFrame([("s", "Jan Smit", 1)], "scope string, entity string, seq long")
    plan = plan_of(persons.namesake_links(df, ["scope"]))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_plan_goes_through_files_once(spark):
    plan = plan_of(sort_plan(imaging.index(spark, SMALL), "nested"))
    assert plan.count("lineitem.parquet") == 1


def test_chunking_is_arrow_batched(documents):
    assert "ArrowEvalPython" in plan_of(texts.chunk_text(documents.sparkSession, SMALL))


def test_row_and_table_forms_agree(spark):
    """The array form of document anonymizing and the join form give the same texts."""
    rows = {r["doc_id"]: r["anonymized_text"] for r in anonymizing.anonymize_chunked(spark, SMALL).collect()}
    tables = {r["doc_id"]: r["anonymized_text"] for r in anonymizing.anonymize_tables(spark, SMALL).collect()}
    assert rows == tables and len(rows) == 200
