"""Plans that call models, with small deterministic stand-ins."""

import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinspark.operators.inference import Detector, pick_passes, safe_rows
from clinspark.plans.anonymize import anonymize, anonymize_table
from clinspark.plans.summarize import summarize
from clinspark.plans.translate import translate, translate_columns


def token_model(frames):
    """Tags capitalised words as given names or surnames, and 'huisarts' as a name by mistake."""
    for frame in frames:
        rows = []
        for doc_id, chunk_idx, text in zip(frame["doc_id"], frame["chunk_idx"], frame["text"]):
            hits = [m for m in re.finditer(r"[A-Z][a-z]+|huisarts", text)]
            for pos, hit in enumerate(hits):
                label = "B-GIVENNAME" if pos % 2 == 0 else "SURNAME"
                rows.append((doc_id, chunk_idx, pos, label, hit[0], hit.start(), hit.end(), 0.9))
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "pos", "raw_type", "word", "start", "end", "score"])


def reviewer(row):
    if row["system"].startswith("You review"):
        return "<think>hm</think>" + json.dumps([{"text": "huisarts", "reason": "role"}, {"entity": "Jan Smit"}])
    return json.dumps([{"entity": "kamer 12", "type": "ADDRESS"}, {"entity": "jan smit", "type": "PERSON"}])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "gesprek: Jan Smit en huisarts zijn in kamer 12"), (2, "niets")], "doc_id long, text string")


def test_two_passes(spark, docs):
    passes, label = pick_passes("ner+llm", lambda name: True)
    result = anonymize(docs, passes=tuple(passes), detector=Detector(token_model, "multilingual_pii"),
                       model_fn=safe_rows(reviewer), label=label)
    mapping = {(r["doc_id"], r["entity"]): r["replacement"] for r in result.mapping.collect()}
    # "huisarts" counts as a care title, so the reviewer may not remove it.
    assert mapping[(1, "Jan Smit")] == "[PERSON_1]"
    assert mapping[(1, "huisarts")] == "[PERSON_2]"
    assert mapping[(1, "kamer 12")] == "[ADDRESS_1]"
    texts = {r["doc_id"]: r["anonymized_text"] for r in result.texts.collect()}
    assert texts[1] == "gesprek: [PERSON_1] en [PERSON_2] zijn in [ADDRESS_1]"
    assert result.label == "ner+llm"


def test_review_removes_plain_words(spark):
    docs = spark.createDataFrame([(1, "de Tafel staat hier")], "doc_id long, text string")

    def remove_table(row):
        return '[{"entity": "TAFEL"}]' if row["system"].startswith("You review") else "[]"

    result = anonymize(docs, passes=("ner", "llm"), detector=Detector(token_model, "multilingual_pii"), model_fn=safe_rows(remove_table))
    assert result.mapping.count() == 0
    assert [r["status"] for r in result.detections.collect()] == ["removed"]


def test_failing_model_releases_nothing(spark, docs):
    def broken(row):
        raise RuntimeError("no memory")

    detector = Detector(token_model, "multilingual_pii")
    for passes in (("ner", "llm"), ("llm",)):
        result = anonymize(docs, passes=passes, detector=detector, model_fn=safe_rows(broken))
        rows = {r["doc_id"]: (r["anonymized_text"], r["error"]) for r in result.texts.collect()}
        assert rows == {1: (None, "discover: RuntimeError: no memory"), 2: (None, "discover: RuntimeError: no memory")}
        failed = {(r["doc_id"], r["pass"]) for r in result.failures.collect()}
        assert failed == {(1, "discover"), (2, "discover")} | ({(1, "review")} if "ner" in passes else set())
    kept = anonymize(docs, passes=("ner", "llm"), detector=detector, model_fn=safe_rows(broken), release_failed=True)
    assert {r["entity"] for r in kept.mapping.collect()} == {"Jan Smit", "huisarts"}
    assert {r["doc_id"] for r in kept.texts.filter("anonymized_text is not null").collect()} == {1, 2}


def test_only_failed_documents_are_withheld(spark, docs):
    def half(row):
        if row["doc_id"] == 2:
            raise RuntimeError("late")
        return reviewer(row)

    result = anonymize(docs, passes=("ner", "llm"), detector=Detector(token_model, "multilingual_pii"), model_fn=safe_rows(half))
    rows = {r["doc_id"]: r for r in result.texts.collect()}
    assert rows[2]["anonymized_text"] is None and rows[2]["error"]
    assert rows[1]["anonymized_text"].startswith("gesprek: [PERSON_1]") and rows[1]["error"] is None


def test_fallback():
    assert pick_passes("ner+llm", lambda name: False) == (["ner"], "ner")
    with pytest.raises(RuntimeError):
        pick_passes("llm", lambda name: False)
    with pytest.raises(ValueError):
        pick_passes("magic", lambda name: True)


def test_global_scope_shares_numbers(spark):
    docs = spark.createDataFrame([(2, "mail b@x.nl en a@x.nl"), (1, "mail A@X.nl")], "doc_id long, text string")
    texts = anonymize(docs, scope="global").texts
    assert {r["doc_id"]: r["anonymized_text"] for r in texts.collect()} == {1: "mail [EMAIL_1]", 2: "mail [EMAIL_2] en [EMAIL_1]"}


def test_known_mapping_is_extended(spark):
    docs = spark.createDataFrame([(1, "mail a@x.nl of b@x.nl")], "doc_id long, text string")
    known = spark.createDataFrame([("B@x.nl", "EMAIL", "[EMAIL_9]", 1)], "entity string, type string, replacement string, seq long")
    result = anonymize(docs, scope="global", mapping=known)
    assert result.texts.first()["anonymized_text"] == "mail [EMAIL_10] of [EMAIL_9]"


def test_table_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a@x.nl", "zie a@x.nl", 5), (2, None, "", 6)], "id long, who string, note string, n int")
    rows = [tuple(r) for r in anonymize_table(df, "id", ["who", "note"]).texts.orderBy("id").collect()]
    assert rows == [(1, "[EMAIL_1]", "zie [EMAIL_1]", 5), (2, None, "", 6)]


def test_summaries_of_long_documents_keep_part_order(spark):
    long_text = " ".join(f"zin {i} is hier." for i in range(900))
    docs = spark.createDataFrame([(1, "kort"), (2, long_text), (3, "")], "doc_id long, text string")

    def model(row):
        part = re.match(r"Part (\d+) of (\d+)", row["user"])
        if part:
            return "" if part[1] == "2" else f"<think>x</think>fact {part[1]}"
        return row["user"]

    rows = {r["doc_id"]: r for r in summarize(docs, safe_rows(model)).collect()}
    assert set(rows) == {1, 2}
    facts = re.findall(r"fact (\d+)", rows[2]["summary"])
    assert facts == sorted(facts, key=int) and "2" not in facts and len(facts) > 2
    assert rows[1]["summary"].endswith("kort") and rows[1]["route"] == "single"


def test_failed_parts_are_named(spark):
    long_text = " ".join(f"zin {i} is hier." for i in range(900))
    docs = spark.createDataFrame([(1, "kort"), (2, long_text), (3, " \n")], "doc_id long, text string")

    def model(row):
        if row["user"].startswith("Part 2"):
            raise RuntimeError("stuck")
        return "fact" if row["user"].startswith("Part") else row["user"]

    rows = {r["doc_id"]: r for r in summarize(docs, safe_rows(model)).collect()}
    assert set(rows) == {1, 2}
    assert rows[2]["error"] == "part 2: RuntimeError: stuck" and rows[2]["summary"]
    assert rows[1]["error"] is None


def test_facts_are_merged_in_rounds(spark):
    """Facts of 1000 characters do not fit one request of 3500: they are condensed until they do."""
    text = " ".join(f"zin {i} is hier." for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")

    def model(row):
        if row["user"].startswith("Part"):
            return re.match(r"Part (\d+)", row["user"])[0] + "." * 990
        if row["user"].startswith("Lists"):
            return " ".join(re.findall(r"Part \d+", row["user"]))
        return row["user"]

    done = summarize(docs, safe_rows(model)).first()
    parts = [int(x) for x in re.findall(r"Part (\d+)", done["summary"])]
    assert parts == list(range(1, len(parts) + 1)) and len(parts) > 8
    assert not done["truncated"] and done["error"] is None


def test_translation_counts_and_failures(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(row):
        calls.add(1)
        if row["line"] == "bad":
            raise ValueError("no")
        return row["line"].upper()

    docs = spark.createDataFrame([(1, "one\n\ntwo\nbad"), (2, "one\none")], "doc_id long, text string")
    done, failed = translate(docs, "a", "b", safe_rows(model))
    assert {r["doc_id"]: r["translated"] for r in done.collect()} == {1: "ONE\n\nTWO\nbad", 2: "ONE\nONE"}
    assert failed.count() == 1
    assert calls.value == 3
    same, _ = translate(docs, "a", "a", safe_rows(model))
    assert same.filter("doc_id = 2").first()["translated"] == "one\none"


def test_translated_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (2, " ", "b")], "id long, x string, y string")
    done, _ = translate_columns(df, "id", ["x", "y"], "a", "b", safe_rows(lambda row: row["line"].upper()))
    assert [tuple(r) for r in done.orderBy("id").select("x (Translated)", "y (Translated)").collect()] == [("A", ""), ("", "B")]
    assert done.columns == ["id", "x", "y", "x (Translated)", "y (Translated)"]
    assert done.filter(F.col("id") == 2).first()["y"] == "b"
