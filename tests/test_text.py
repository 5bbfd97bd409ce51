"""Hand-read goldens of the text rules, and chunkers against slow, literal restatements."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinspark.functions import chunking, language, names, replies, signals, text
from clinspark.operators.rewriting import anonymize_text


def column(spark, build, *rows):
    """One value per row of ``build()`` over columns a, b, c."""
    width = max(len(row) for row in rows)
    schema = ", ".join(f"{name} string" for name in "abcd"[:width])
    frame = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema + ", i int")
    return [row[0] for row in frame.orderBy("i").select(build()).collect()]


def test_trim_strips_unicode_spaces_only_at_the_ends(spark):
    out = column(spark, lambda: text.trim_spaces("a"), ("\n\t a b  ",), ("﻿x\x85",))
    assert out == ["a b", "x\x85"]


def test_word_edges_are_ascii(spark):
    hits = column(spark, lambda: F.regexp_count("a", F.lit(text.whole_word("la"))), ("préla la",))
    assert hits == [2]


@pytest.mark.parametrize(
    "entity, kind, strong",
    [
        ("", "EMAIL", False), ("mijn huis", "PERSON", False), ("Jan de Vries", "PERSON", True),
        ("jan de vries", "PERSON", False), ("12 maart", "DATE", True), ("maart", "DATE", True),
        ("maart", "PERSON", False), ("6221 BN", "OTHER", True), ("Kerk straat 5", "OTHER", True),
        ("Kerkstraat", "OTHER", False), ("mijn huisarts", "PERSON", True), ("dr. x", "OTHER", True),
        ("Utrecht", "LOCATION", True), ("Ut", "LOCATION", False), ("+31 6 12345678", "OTHER", True),
        ("a@b.nl", "OTHER", True), ("Goedemiddag", "ID_NUMBER", False), ("x", "ADDRESS", True),
    ],
)
def test_strong_signal(spark, entity, kind, strong):
    assert column(spark, lambda: signals.has_strong_pii_signal("a", "b"), (entity, kind)) == [strong]


def test_garbage(spark):
    rows = [("Dank  u", "PERSON"), ("abc", "ID_NUMBER"), ("Ut", "LOCATION"), ("U2", "LOCATION"),
            ("kunt u komen", "DATE"), ("kunt uw", "DATE"), ("de man", "PERSON"), ("de Man", "PERSON")]
    got = column(spark, lambda: signals.is_obvious_garbage("a", "b"), *rows)
    assert got == [True, True, True, False, True, False, True, False]


def test_transcripts(spark):
    rows = [("a",), ("...",), (", , ",), ("Tot de volgende keer!",), ("hello hello hello",),
            ("a b a b a",), ("yes yes yes no no",), ("ja ja ja nee",), ("one two three one two three one",),
            ("this is a normal sentence",)]
    got = column(spark, lambda: signals.is_invented_transcript("a"), *rows)
    #      exactly 60 % is not over the limit (yes yes yes no no)
    assert got == [True, True, True, True, True, True, False, True, True, False]


def test_image_names(spark):
    rows = [("A.DCM", "1"), ("noext", "1024"), ("noext", "1025"), ("ct1.txt", "1"), ("IMG", "1"),
            ("12.5", "2000"), ("12.5", "10"), ("doc.pdf", "999999"), ("x.weird", "2000")]
    got = column(spark, lambda: signals.looks_like_image("a", F.col("b").cast("int")), *rows)
    assert got == [True, False, True, True, True, True, False, False, True]
    hints = column(spark, lambda: signals.guess_modality("a"), ("RTSTRUCT1",), ("petscan",), ("x",))
    assert hints == ["RTSTRUCT", "PT", None]


def test_labels(spark):
    assert column(spark, lambda: text.sanitize_path("a"), ('a<>:b/c',), (" ",), ("",), ("x__y",)) == ["a_b_c", "unknown", "unknown", "x_y"]
    assert column(spark, lambda: text.format_dicom_date("a"), ("20240131",), ("2024",), (None,)) == ["2024-01-31", "2024", ""]
    sizes = column(spark, lambda: text.human_size(F.col("a").cast("bigint")), ("1023",), ("1536",), ("1572864",), ("1610612736",))
    assert sizes == ["1023 B", "1.5 KB", "1.5 MB", "1.50 GB"]
    assert column(spark, lambda: text.format_seconds(F.col("a").cast("double")), ("59.9",), ("3661",)) == ["00:59", "01:01:01"]


def test_languages(spark):
    dutch = "het is een man van de stad en dat is niet met op aan"
    assert column(spark, lambda: language.detect_language_nl_en("a"), (dutch,), ("the man and the sea of the world",), ("xyz qrs",), ("goed",)) == [
        "Dutch", "English", "the same language as the source text", "Dutch"]
    german = "der die das und ist nicht mit für von den dem sich auf auch"
    assert column(spark, lambda: language.detect_language_five("a"), (german,), ("kort",), ("x" * 50,)) == ["deu", None, None]


def test_replies(spark):
    rows = [('<think>[]</think>[{"entity":"Jan","type":"PERSON"},{"entity":" ","type":"X"},{"type":"Y"}]',),
            ("no list",), ('[{"entity":"a"',), ('[{"entity":"a]b","type":"PERSON"}]',)]
    got = column(spark, lambda: replies.parse_entity_json("a"), *rows)
    assert [[tuple(item) for item in items] for items in got] == [[("Jan", "PERSON")], [], [], []]
    greedy = column(spark, lambda: replies.parse_entity_json("a", greedy=True), rows[3])
    assert greedy[0][0]["entity"] == "a]b"


def test_names(spark):
    got = column(spark, lambda: names.split_name("a"), ("Johan Pieter de Vries",), ("Puts",), ("van Gogh",), ("Jan van",), ("",))
    assert [(row["given"], row["surname"]) for row in got] == [
        (["Johan", "Pieter"], "de Vries"), ([], "Puts"), ([], "van Gogh"), (["Jan"], "van"), ([], "")]
    pairs = [("S. Puts", "Sander Puts"), ("Puts", "Sander Puts"), ("Sanne de Vries", "Lucas de Vries"), ("J.P. Smit", "Jan Smit"), ("Jan Smit", "Jan Piet smit")]
    same = column(spark, lambda: names.names_compatible(names.split_name("a"), names.split_name("b")), *pairs)
    assert same == [True, True, False, True, True]


# --- rewriting -----------------------------------------------------------------------------------
def rewrite(spark, source, entries, mode="sequential"):
    frame = spark.createDataFrame([(source, entries)], "t string, e array<struct<entity:string,replacement:string,seq:long>>")
    return frame.select(anonymize_text(F.col("t"), F.col("e"), mode)).first()[0]


def test_rewrite_boundaries_and_order(spark):
    entries = [("Maastricht", "[LOCATION_1]", 1), ("Maastricht UMC+", "[ORGANIZATION_1]", 2), ("+31 6", "[PHONE_1]", 3), ("é", "[OTHER_1]", 4)]
    source = "In maastricht, bij Maastricht UMC+x en Maastrichter: +31 6 of 1+31 6. préé é"
    assert rewrite(spark, source, entries) == (
        "In [LOCATION_1], bij [ORGANIZATION_1]x en Maastrichter: [PHONE_1] of 1[PHONE_1]. préé [OTHER_1]")


def test_rewrite_inside_tags(spark):
    entries = [("Jan Smit", "[PERSON_1]", 1), ("PERSON", "[OTHER_1]", 2), ("1", "[OTHER_2]", 3)]
    assert rewrite(spark, "Jan Smit", entries) == "[[OTHER_[OTHER_2]]_[OTHER_2]]"
    assert rewrite(spark, "Jan Smit 1 person", entries, "single_pass") == "[PERSON_1] [OTHER_2] [OTHER_1]"


def test_rewrite_special_characters(spark):
    entries = [(r"a\E$1", r"$0\x", 1), ("c.d", "<>", 2)]
    assert rewrite(spark, r"see a\E$1 and c.d cxd", entries) == r"see $0\x and <> cxd"


# --- chunkers ------------------------------------------------------------------------------------
def test_short_text_is_one_chunk():
    assert chunking.chunks_of("a\n\n\nb", 100, 10) == ["a\nb"]
    assert chunking.chunks_of(" \n ", 100, 10) == [" \n "]


def test_chunk_overlap_is_cut_at_sentence():
    first = "x" * 50 + ". " + "tail words here and more of it"
    chunks = chunking.chunks_of(first + "\n" + "y" * 60, 100, 50)
    assert chunks == [first, "tail words here and more of it\n" + "y" * 60] or chunks[1].endswith("y" * 60)
    assert chunks[1].split("\n")[0] in first


def test_long_paragraph_is_cut_at_words_and_repeats_the_overlap():
    words = " ".join(f"w{i:03d}" for i in range(200))
    chunks = chunking.chunks_of(words, 100, 20)
    assert all(len(chunk) <= 101 for chunk in chunks)
    assert {word for chunk in chunks for word in chunk.split()} >= set(words.split())
    assert all(set(one.split()) & set(two.split()) for one, two in zip(chunks, chunks[1:]))


def test_hard_cut_without_breaks():
    assert [len(chunk) for chunk in chunking.chunks_of("x" * 250, 100, 20)] == [100, 100, 90]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n!?", max_size=400), st.integers(20, 60))
def test_chunks_cover_every_paragraph(source, size):
    chunks = chunking.chunks_of(source, size, size // 10)
    letters = [char for char in source if not char.isspace()]
    joined = "".join(chunks)
    assert sum(not char.isspace() for char in joined) >= len(letters)
    for paragraph in filter(str.strip, source.split("\n")):
        if len(paragraph) <= size:
            assert any(paragraph.strip() in chunk for chunk in chunks)


def test_windows_end_at_sentences():
    source = ("a" * 1600 + ". ") * 5
    pieces = chunking.windows_of(source, 3000, 200)
    assert pieces[0].endswith(".") and len(pieces[0]) == 1601
    # Nothing is lost: every window overlaps the one before, the last one reaches the end.
    assert len("".join(pieces)) >= len(source.strip()) and source.strip().endswith(pieces[-1])
    assert chunking.windows_of("short", 3000, 200) == ["short"]
    assert chunking.windows_of("short", 3000, 200, minimum=50) == []


def test_sentence_chunks(spark):
    source = "One two. Three four! Five six? " * 30
    got = column(spark, lambda: chunking.chunk_sentences("a", 60), (source,), ("short!",))
    assert got[1] == ["short!"]
    assert "".join(got[0]).count("One two.") == 30
    assert all(len(chunk) <= 61 for chunk in got[0])


def test_chunkers_from_sql(spark):
    chunking.register_table_functions(spark)
    random.seed(1)
    body = "\n".join("word " * random.randint(1, 300) for _ in range(20))
    spark.createDataFrame([(1, body)], "id int, body string").createOrReplaceTempView("bodies")
    rows = spark.sql("SELECT chunk_idx, chunk FROM bodies, LATERAL chunk_text(body) ORDER BY chunk_idx").collect()
    assert [row["chunk"] for row in rows] == chunking.chunks_of(body, 2400, 240)
    column_rows = spark.table("bodies").select(F.explode(chunking.chunk_text("body"))).collect()
    assert [row[0] for row in column_rows] == chunking.chunks_of(body, 2400, 240)
