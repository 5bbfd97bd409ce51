"""Numbering, medians, mappings, persons and plans against brute force and on skewed data."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from clinspark.functions.chunking import chunk_fixed, chunk_text
from clinspark.functions.text import split_words
from clinspark.operators.inference import reviewed, safe_rows
from clinspark.operators import mapping as mappings
from clinspark.operators import filing, imaging, ordering, persons, rewriting
from clinspark.operators.rewriting import anonymize_text, apply_global_mapping, effective_entries
from clinspark.plans import anonymize as anonymize_plan
from clinspark.plans.anonymize import anonymize, extend_mapping
from clinspark.sinks.mapping_files import mapping_documents, write_mapping
from clinspark.sources.mapping_files import read_mapping_json


def skewed(spark, rows=3000):
    """Two thirds of the rows belong to one key."""
    random.seed(3)
    data = [("hot" if i % 3 else f"k{i % 40}", random.randint(0, 10**6), i) for i in range(rows)]
    return spark.createDataFrame(data, "k string, v long, id long"), data


@pytest.mark.parametrize("ranges", [None, 1, 16])
def test_ordinals_of_a_hot_key_come_from_many_ranges(spark, ranges):
    df, data = skewed(spark)
    out = ordering.ordinal_within(df, ["k"], ["v", "id"], ranges=ranges)
    expected = {}
    for key in {row[0] for row in data}:
        ordered = sorted((v, i) for k, v, i in data if k == key)
        expected |= {(key, i): n for n, (_, i) in enumerate(ordered, 1)}
    assert {(r["k"], r["id"]): r["ordinal"] for r in out.collect()} == expected


def test_ordinals_take_one_range_exchange_and_the_input_once(spark, tmp_path, monkeypatch):
    """Nine tenths of the rows belong to one key; no range holds more than a few of the 16 shares."""
    seen, stages = [], []
    real = ordering.cut_lineage

    def watched(df):
        seen.append(df._jdf.queryExecution().toString())
        stages.append(real(df))
        return stages[-1]

    monkeypatch.setattr(ordering, "cut_lineage", watched)
    spark.range(40_000).selectExpr("if(id % 10 = 0, id, -1) as k", "xxhash64(id) as v", "id", "'x' as more").write.parquet(str(tmp_path / "in"))
    out = ordering.ordinal_within(spark.read.parquet(str(tmp_path / "in")), ["k"], ["v", "id"], ranges=16)
    plans = [plan.split("== Physical Plan ==")[1] for plan in [*seen, out._jdf.queryExecution().toString()]]
    assert [plan.count("rangepartitioning") for plan in plans] == [0, 1, 0]
    assert [f"{tmp_path}/in" in plan for plan in plans] == [True, False, False]
    spread = [r["count"] for r in stages[1].filter("k = -1").groupBy("_range").count().collect()]
    assert max(spread) < 40_000 // 4 and len(spread) > 8
    assert sorted(r["ordinal"] for r in out.filter("k = -1").collect()) == list(range(1, 36_001))


def test_ordinals_without_keys_and_with_nulls(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"), "id")
    out = ordering.ordinal_within(df, [], ["v", "id"], ranges=8).orderBy("ordinal").collect()
    expected = sorted(df.collect(), key=lambda r: (r["v"] is not None, r["v"] or 0, r["id"]))
    assert [r["id"] for r in out] == [r["id"] for r in expected]
    assert [r["ordinal"] for r in out] == list(range(1, 1001))
    assert ordering.ordinal_within(df.limit(0), ["v"], ["id"]).count() == 0


@pytest.mark.parametrize("spread", [10, 5000, 10**7])
def test_median_is_exact(spark, spread):
    random.seed(spread)
    data = [(f"k{random.randint(0, 5)}", random.randint(0, spread)) for _ in range(2001)] + [("one", 5)]
    df = spark.createDataFrame(data, "k string, v long")
    got = {r["k"]: r["median"] for r in ordering.exact_median(df, ["k"], "v").collect()}
    for key in {k for k, _ in data}:
        assert got[key] == statistics.median([v for k, v in data if k == key])


def reference_components(names):
    """Pairwise restatement of the compatibility rule with a plain closure."""
    particles = {"van", "de", "der", "den", "ter", "ten", "op", "in", "het"}

    def parts(name):
        tokens = name.split()
        cut = next((i for i, t in enumerate(tokens[:-1]) if t.lower() in particles), len(tokens) - 1)
        return tokens[:cut], " ".join(tokens[cut:]).lower()

    def initial(token):
        return len(token) >= 1 and "A" <= token[0] <= "Z" and (len(token) == 1 or token[1] == ".")

    def letter(token):
        return next((c.lower() for c in token if c.isascii() and c.isalpha()), "")

    def same(a, b):
        (ga, sa), (gb, sb) = parts(a), parts(b)
        return sa == sb and all(
            letter(x) == letter(y) if initial(x) or initial(y) else x.lower() == y.lower()
            for x, y in zip(ga, gb)
        )

    label = list(range(len(names)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(names)), 2):
            if label[a] != label[b] and same(names[a], names[b]):
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_components_match_brute_force(spark):
    random.seed(11)
    pool = ["Jan", "jan", "Johan", "J.", "J", "A.", "Anna", "P.", "Pieter", "J.P.", "Élise", "E."]
    surnames = ["Smit", "de Vries", "van der Berg"]
    names = [
        " ".join([*random.choices(pool, k=random.choice([0, 1, 1, 2, 2, 3])), random.choice(surnames) + str(n % 4)])
        for n in range(160)
    ]
    df = spark.createDataFrame([("s", n, "PERSON", f"[PERSON_{i}]", i) for i, n in enumerate(names)],
                               "scope string, entity string, type string, replacement string, seq long")
    found = persons.connected_components(persons.namesake_links(df, ["scope"]), ["scope"])
    got = list(range(len(names)))
    for row in found.collect():
        got[row["node"]] = row["component"]
    assert got == reference_components(names)


def test_links_do_not_grow_with_the_square_of_a_block(spark):
    names = [(f"Name{i % 500} Smit" if i % 2 else "Smit") for i in range(1000)]
    df = spark.createDataFrame([("s", n, i) for i, n in enumerate(names)], "scope string, entity string, seq long")
    assert persons.namesake_links(df, ["scope"]).count() < 6 * len(names)


def test_long_names_next_to_initials(spark):
    """Fifteen given names, fifteen initials and every prefix of both: linear rows, brute-force components."""
    random.seed(5)
    full = [random.choice("ABCDE") + random.choice(["an", "el", "im"]) for _ in range(15)]
    letters = [f"{name[0]}." for name in full]
    names = [" ".join([*full[:n], "Smit"]) for n in range(1, 16)] + [" ".join([*letters[:n], "Smit"]) for n in range(1, 16)]
    names += [" ".join([*full[:7], *letters[7:], "Smit"]), " ".join([*full[:14], "Zed", "Smit"]), "Xi Smit"]
    df = spark.createDataFrame([("s", n, i) for i, n in enumerate(names)], "scope string, entity string, seq long")
    links = persons.namesake_links(df, ["scope"])
    tokens = sum(name.count(" ") for name in names)
    assert links.count() < 8 * tokens
    got = list(range(len(names)))
    for row in persons.connected_components(links, ["scope"]).collect():
        got[row["node"]] = row["component"]
    assert got == reference_components(names)


def test_strict_persons(spark):
    rows = ["Sander Puts", "S. Puts", "Puts", "Sanne de Vries", "de Vries", "Puts"]
    df = spark.createDataFrame([(0, n, "PERSON", f"[PERSON_{i}]", i) for i, n in enumerate(rows)], "scope int, entity string, type string, replacement string, seq long")
    resolved, _ = persons.resolve_persons(df, ["scope"], strict=True)
    tags = [r["replacement"] for r in resolved.orderBy("seq").collect()]
    assert tags == ["[PERSON_0]", "[PERSON_0]", "[PERSON_2]", "[PERSON_3]", "[PERSON_4]", "[PERSON_2]"]


def test_resolve_persons(spark):
    rows = [("Sander Puts", "PERSON", "[PERSON_1]"), ("S. Puts", "PERSON", "[PERSON_2]"), ("Puts", "PERSON", "[PERSON_3]"),
            ("Sanne de Vries", "PERSON", "[PERSON_4]"), ("Lucas de Vries", "PERSON", "[PERSON_5]"), ("Puts", "LOCATION", "[LOCATION_1]")]
    df = spark.createDataFrame([(0, *row, i) for i, row in enumerate(rows)], "scope int, entity string, type string, replacement string, seq long")
    resolved, merged = persons.resolve_persons(df, ["scope"])
    tags = [r["replacement"] for r in resolved.orderBy("seq").collect()]
    assert tags == ["[PERSON_1]"] * 3 + ["[PERSON_4]", "[PERSON_5]", "[LOCATION_1]"]
    assert merged.collect()[0]["merged"] == 2


def test_mapping_json_round_trip(spark, tmp_path):
    rows = [(f"Entity {i}", "PERSON" if i % 2 else "DATE", f"[{'PERSON' if i % 2 else 'DATE'}_{i}]", i) for i in range(95)]
    df = spark.createDataFrame(rows, "entity string, type string, replacement string, seq long")
    assert mapping_documents(df, [], 40).count() == 3
    write_mapping(df, [], str(tmp_path / "m"))
    lines = [line for file in (tmp_path / "m").glob("part-*") for line in file.read_text().splitlines()]
    (tmp_path / "docs").mkdir()
    for number, line in enumerate(lines):
        (tmp_path / "docs" / f"{number}.json").write_text(line)
    back, counters = read_mapping_json(spark, str(tmp_path / "docs"))
    assert {tuple(r) for r in back.collect()} == {row[:3] for row in rows}
    assert {r["type"]: r["last_number"] for r in counters.collect()} == {"PERSON": 93, "DATE": 94}


def test_mapping_json_counters_rebuilt_when_missing(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entities": {"Jan": {"type": "PERSON", "replacement": "[PERSON_7]"}}, "extra": 1}')
    mapping, counters = read_mapping_json(spark, str(tmp_path))
    assert [tuple(r) for r in counters.collect()] == [("PERSON", 7)]
    assert mapping.count() == 1


def test_mapping_table_needs_its_columns(spark):
    with pytest.raises(ValueError):
        mappings.mapping_from_table(spark.range(3).withColumn("Type", F.lit("x")), "id")


def test_numbers_continue_across_calls(spark):
    first = spark.createDataFrame([("Jan", "PERSON", 1), ("1 mei", "DATE", 2)], "entity string, type string, pos int")
    second = spark.createDataFrame([("JAN", "OTHER", 1), ("Piet", "PERSON", 2), ("piet", "PERSON", 3)], "entity string, type string, pos int")
    known = extend_mapping(first, [], ["pos"])
    grown = extend_mapping(second, [], ["pos"], known)
    assert [(r["entity"], r["replacement"]) for r in grown.orderBy("seq").collect()] == [
        ("Jan", "[PERSON_1]"), ("1 mei", "[DATE_1]"), ("Piet", "[PERSON_2]")]


def test_global_mapping_with_hot_runs(spark):
    """Entities that share common runs meet texts on their rarest run; odd entities have none."""
    texts = spark.createDataFrame([(i, f"De heer van den Berg {i} zei +++ tegen de arts") for i in range(60)], "doc_id long, text string")
    mapping = spark.createDataFrame(
        [(f"van den Berg {i}", f"[PERSON_{i}]", i) for i in range(60)] + [("+++", "[OTHER_1]", 99)], "entity string, replacement string, seq long")
    done = apply_global_mapping(texts, mapping, ["doc_id"])
    assert {r["doc_id"]: r["anonymized_text"] for r in done.collect()} == {
        i: f"De heer [PERSON_{i}] zei [OTHER_1] tegen de arts" for i in range(60)}


INTAKE = (
    "Interviewer: Wat is uw naam?\nPatiënt: Mijn naam is Klaas Jan de Boer, geboren op 3 april 1970 te Delft. "
    "Ik woon aan de Lindelaan 12, 2611 AB Delft.\nPatiënt: Mijn BSN is 123456789, mail k.deboer@voorbeeld.nl of bel +31 6 11112222.\n"
    "Patiënt: Mijn vrouw Petra de Boer werkt bij Bakker Techniek BV. IBAN NL12 BANK 0123 4567 89."
)


def test_dutch_intake_with_the_rule_detector(spark):
    docs = spark.createDataFrame([(1, INTAKE)], "doc_id long, text string")
    result = anonymize(docs)
    found = {(r["entity"], r["type"]) for r in result.mapping.collect()}
    assert found >= {
        ("Klaas Jan de Boer", "PERSON"), ("3 april 1970", "DATE"), ("Lindelaan 12", "ADDRESS"), ("2611 AB", "ADDRESS"),
        ("123456789", "ID_NUMBER"), ("k.deboer@voorbeeld.nl", "EMAIL"), ("+31 6 11112222", "PHONE"),
        ("Petra de Boer", "PERSON"), ("Bakker Techniek BV", "ORGANIZATION"), ("NL12 BANK 0123 4567 89", "ID_NUMBER")}
    assert "Boer" not in result.texts.first()["anonymized_text"]
    words = result.mapping.select(F.max(F.size(split_words("entity")))).first()[0]
    assert words <= 5


def test_name_joins_broadcast_no_stored_table(spark, monkeypatch):
    """Files of consecutive numbers are small, however many rows they hold: sizes do not bound a broadcast."""
    plans, real = [], persons.cut_lineage

    def planned(df):
        return df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(persons, "cut_lineage", lambda df: plans.append(planned(df)) or real(df))
    rows = [("s", f"{given} Smit-{n // 3}", "PERSON", f"[PERSON_{n}]", n) for n, given in enumerate(["Jan", "J.", ""] * 20)]
    mapping = spark.createDataFrame(rows, "scope string, entity string, type string, replacement string, seq long")
    resolved, merged = persons.resolve_persons(mapping, ["scope"])
    plans += [planned(resolved), planned(merged)]
    assert len(plans) > 4 and not [plan for plan in plans if "Broadcast" in plan]
    assert merged.first()["merged"] == 40
    assert {row["replacement"] for row in resolved.collect()} == {f"[PERSON_{n}]" for n in range(0, 60, 3)}


def test_index_stores_one_place_and_only_optional_tags_per_series(spark, monkeypatch):
    """Tags that no level keeps are not shuffled or stored; the first place decides, read headers before inferred ones."""
    stored, real = [], imaging.cut_lineage
    monkeypatch.setattr(imaging, "cut_lineage", lambda df: stored.append(df.schema) or real(df))
    tags = {"PatientID": "P", "StudyInstanceUID": "1", "SeriesInstanceUID": "2", "Modality": "CT", "StationName": "X"}
    rows = [("b", 1, tags | {"KVP": "7", "PatientName": "B"}, False), ("a", 2, tags | {"KVP": "8", "PatientName": "A"}, True), ("c", 3, tags, False)]
    index = imaging.build_index(spark.createDataFrame(rows, "path string, size long, tags map<string,string>, inferred boolean"))
    series = index["series"].first()
    assert series["optional_tags"] == {"KVP": "7"} and series["first_place"] == (False, "b")
    assert (series["file_count"], series["total_size"], series["inferred_count"]) == (3, 6, 1)
    assert index["patients"].first()["patient_name"] == "B"
    assert "first_place" not in stored[0].fieldNames()
    assert "tags" not in stored[0]["first"].dataType.fieldNames()


@pytest.mark.parametrize("mode", ["single_pass", "sequential"])
def test_repeated_entities_are_tried_once_unless_they_can_come_back(spark, mode):
    """Equal entities behind the first change nothing; those that a replacement brings back stay."""
    schema = "entity string, replacement string, seq long"
    names = [("Customer#1", f"[PERSON_{n}]", n) for n in range(40)] + [("customer#1", "[LOW]", 50)]
    back = [("Ann", "[Bob]", 1), ("Ann", "[Cy]", 3), ("Bob", "[Ann]", 2), ("Bob", "[Ann]", 4), ("-", "_", 5), ("-", "x", 6)]
    joining = [("a", "", 1), ("#", "b", 1), ("bc", "[1]", 2), ("bc", "[2]", 3)]
    texts = spark.createDataFrame([(1, "Customer#1 or customer#1: Ann-Bob, Ann; bacbc bc#c b#c")], "id long, text string")
    for rows in (names, back, joining, names + back):
        mapping = spark.createDataFrame(rows, schema)
        entries = mapping.agg(F.collect_list(F.struct("entity", "replacement", "seq")).alias("e"))
        whole = texts.join(entries).select(anonymize_text("text", "e", mode)).first()[0]
        assert apply_global_mapping(texts, mapping, ["id"], mode=mode).first()["anonymized_text"] == whole
    kept = effective_entries(spark.createDataFrame(names, schema), mode)
    assert sorted(map(tuple, kept.collect())) == [("Customer#1", "[PERSON_0]", 0), ("customer#1", "[LOW]", 50)]
    assert effective_entries(spark.createDataFrame(back, schema), mode).count() == (3 if mode == "single_pass" else 6)


def image_headers(spark):
    """Two patients, three studies; one series of seven files, labels on therapy series."""
    rows = []
    for number in range(24):
        study, kind = number % 3, ("CT", "RTSTRUCT", "RTPLAN", "CT")[number % 4]
        tags = {
            "PatientID": f"P{study % 2}", "PatientName": f"N{number}", "StudyInstanceUID": f"1.{study}", "StudyDate": "20240102",
            "SeriesInstanceUID": f"1.{study}.{kind}", "Modality": kind, "SeriesDescription": f"d{number}", "RTPlanLabel": "L",
            "RTPlanName": "n", "KVP": "7", "Manufacturer": "M", "AccessionNumber": "A", "InstanceNumber": str(number),
        }
        rows.append((f"/in/{number:02}.dcm", number, tags, number % 5 == 0))
    return spark.createDataFrame(rows, "path string, size long, tags map<string,string>, inferred boolean")


def test_index_carries_only_what_the_caller_reads(spark, monkeypatch):
    """F8 to F23: plans, totals and details do not shuffle and store attributes they never read."""
    stored, real = [], imaging.cut_lineage
    monkeypatch.setattr(imaging, "cut_lineage", lambda df: stored.append(df.schema) or real(df))
    headers = image_headers(spark)
    whole = imaging.build_index(headers)
    for keep in (imaging.KEPT_BY_PLANS, imaging.KEPT_BY_TOTALS, imaging.KEPT_BY_DETAIL):
        narrow = imaging.build_index(headers, keep)
        assert len(stored[-1]["first"].dataType) < len(stored[0]["first"].dataType) - 5
        for mode in ("nested", "flat", "modality") if keep == imaging.KEPT_BY_PLANS else ():
            assert sorted(filing.sort_plan(narrow, mode).collect()) == sorted(filing.sort_plan(whole, mode).collect())
    assert imaging.scan_info(imaging.build_index(headers, imaging.KEPT_BY_TOTALS)).collect() == imaging.scan_info(whole).collect()
    detail = imaging.files_detail(imaging.build_index(headers, imaging.KEPT_BY_DETAIL))
    assert sorted(detail.collect()) == sorted(imaging.files_detail(whole).collect())


def test_folder_tree_counts_what_the_plan_counts(spark):
    """the tree comes from file counts per series; it is that of the plan."""
    index = imaging.build_index(image_headers(spark))
    for mode in ("nested", "flat", "modality"):
        tree = filing.folder_tree(filing.series_folders(index, mode))
        assert sorted(tree.collect()) == sorted(filing.plan_tree(filing.sort_plan(index, mode)).collect())
        assert "instance_number" not in tree._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_large_and_small_series_hold_every_file(spark, monkeypatch):
    """small series are gathered once; files of large ones are numbered; parts are the same."""
    index = imaging.build_index(image_headers(spark))
    whole = sorted(imaging.index_documents(index, 3).collect())
    assert sum(row["files"] for row in whole) == 24 and max(row["files"] for row in whole) == 3
    monkeypatch.setattr(imaging, "ordinal_within", None)
    assert sorted(imaging.index_documents(index, 3).collect()) == whole
    monkeypatch.undo()
    monkeypatch.setattr(imaging, "GATHERED_FILES", 2)
    assert sorted(imaging.index_documents(index, 3).collect()) == whole


def test_plans_and_documents_deal_files_once_by_study(spark):
    """F3 to F8: one exchange of the files; series, studies and folders are worked out where a study lies."""
    index = {"rows": imaging.file_rows(image_headers(spark))}
    for mode in ("nested", "flat", "modality"):
        plan = filing.sort_plan(index, mode)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan
    tree = filing.folder_counts(filing.file_folders(index))._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange ") == 1
    documents = imaging.index_documents(index, 3)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in documents.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("series_uid" in line for line in dealt)


def test_large_studies_have_the_same_plan_and_documents(spark, monkeypatch):
    """F3 to F8: files of large studies meet their series by joins, small and large ones beside each other."""
    calls = [("nested", None, None), ("nested", ["RTSTRUCT"], None), ("nested", ["CT"], ["CT", "RTPLAN"]), ("flat", None, ["CT", "MR"]), ("modality", ["CT"], None)]
    extra = spark.createDataFrame([("/in/x", 1, {"PatientID": "P1", "StudyInstanceUID": "7", "Modality": "MR"}, False)], "path string, size long, tags map<string,string>, inferred boolean")
    both = imaging.build_index(image_headers(spark).unionByName(extra))
    usual = [sorted(filing.sort_plan(both, *call).collect()) for call in calls]
    documents = sorted(imaging.index_documents(both, 3).collect())
    assert [len(rows) for rows in usual] == [25, 19, 13, 9, 13]
    monkeypatch.setattr(imaging, "GATHERED_FILES", 2)
    assert [sorted(filing.sort_plan(both, *call).collect()) for call in calls] == usual
    assert sorted(imaging.index_documents(both, 3).collect()) == documents


def test_headers_may_have_their_tags_as_columns(spark):
    """F3 to F8: tags as columns give the same tables as a map; a plan does not work out tags that it does not need."""
    headers = image_headers(spark)
    keys = [row[0] for row in headers.select(F.explode(F.map_keys("tags"))).distinct().collect()]
    flat = headers.select("path", "size", "inferred", *[F.col("tags")[key].alias(key) for key in keys])
    one, other = imaging.build_index(headers), imaging.build_index(flat)
    for name in ("files", "series", "studies", "patients"):
        ordered = [column if column != "optional_tags" else F.to_json(column) for column in one[name].columns]
        assert sorted(one[name].select(*ordered).collect()) == sorted(other[name].select(*ordered).collect())
    counted = imaging.file_rows(flat.withColumn("KVP", F.assert_true(F.lit(False)).cast("string"))).select("patient_id", "path")
    assert counted.count() == 24


def test_rounds_of_replacements_carry_only_runs_that_can_matter(spark, monkeypatch):
    """of the texts' runs only those of entities that replacements can bring in are stored and joined."""
    counted, real = [], rewriting._set_matches
    monkeypatch.setattr(rewriting, "_set_matches", lambda runs, *rest: counted.append(runs.count()) or real(runs, *rest))
    text = "Ann or who else of Bob: " + " ".join(f"w{n}" for n in range(400))
    texts = spark.createDataFrame([(1, text), (2, "Bob: nobody"), (3, "w1 w2")], "id long, text string")
    rows = [("Ann", "[PERSON_1]", 1), ("Bob", "[PERSON_2]", 2), ("person", "<WHO IS>", 3), ("who is", "[X]", 4), ("else of", "[Y]", 5)]
    for more in ([], [("w1", "-", 6), ("w7-w8", "[Z]", 7)]):
        mapping = spark.createDataFrame(rows + more, "entity string, replacement string, seq long")
        entries = mapping.agg(F.collect_list(F.struct("entity", "replacement", "seq")).alias("e"))
        whole = sorted(texts.crossJoin(entries).select("id", anonymize_text("text", "e").alias("t")).collect())
        done = apply_global_mapping(texts, mapping, ["id"], mode="sequential")
        assert sorted(done.select("id", "anonymized_text").collect()) == whole
        assert max(counted) < 40


def test_rules_run_once_under_a_review(spark, monkeypatch):
    """what the rules found is stored before a review reads it, so they run once."""
    stored, real = [], anonymize_plan.cut_lineage
    monkeypatch.setattr(anonymize_plan, "cut_lineage", lambda df: stored.append(df.columns) or real(df))
    docs = spark.createDataFrame([(1, "mail a@b.org on 2024-01-02"), (2, "nothing")], "doc_id long, text string")
    done = anonymize_plan.anonymize_table(docs, "doc_id", ["text"], passes=("ner", "llm"), model_fn=safe_rows(lambda row: "[]"))
    assert stored[1] == ["doc_id", "chunk_idx", "pos", "entity", "type", "score"]
    assert sorted(row["text"] for row in done.texts.collect()) == ["mail [EMAIL_1] on [DATE_1]", "nothing"]


def test_places_whose_first_run_no_entity_begins_with_are_not_looked_up(spark, monkeypatch):
    """lengths are looked up for places that an entity can begin at."""
    looked, real = [], rewriting._through_mask
    monkeypatch.setattr(rewriting, "_through_mask", lambda keyed, *rest: looked.append(keyed.count()) or real(keyed, *rest))
    texts = spark.createDataFrame([(1, " ".join(f"w{n}" for n in range(300)) + " Ann B C, ann")], "id long, text string")
    rows = [("Ann", "[1]", 1), ("ann b", "[2]", 2), ("Ann B C", "[3]", 3), ("w299 ann", "[4]", 4), ("C ann", "[5]", 5)]
    found = rewriting.sequence_matches(texts, spark.createDataFrame(rows, "entity string, replacement string, seq long"), ["id"])
    assert sorted(row["seq"] for row in found.collect()) == [1, 2, 3, 4, 5]
    assert looked[0] == 304 and looked[1] < 30


def test_models_and_chunkers_hold_few_rows_at_once(spark):
    """F6, F13, F16: an Arrow batch of thousands of rows is asked and cut a few rows at a time."""
    docs = spark.range(3000).repartition(1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("Some text "), "id")).alias("text"))

    def widths(frames):
        for frame in frames:
            yield frame.assign(reply=str(len(frame)))

    asked = reviewed(docs.filter("text IS NOT NULL"), widths).collect()
    assert len(asked) == 3000 - 429 and max(int(row["reply"]) for row in asked) <= 500
    cut = docs.select("id", chunk_text("text").alias("c"), chunk_fixed("text").alias("f")).collect()
    for row in cut:
        assert row["c"] == row["f"] == (None if row["id"] % 7 == 0 else [f"Some text {row['id']}"])
