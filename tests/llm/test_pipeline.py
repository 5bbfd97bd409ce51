"""The pipeline stage by stage against plain Python."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.cases import SCHEMA, words
from tests.llm.test_exact_and_shares import norm, water_fill
from tests.llm.test_texts import jaccard, variants


def folder_of(spark, path, rows, labels):
    spark.createDataFrame(rows, SCHEMA + ", kept string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    rows, number = [], 0

    def add(text, lang="en"):
        nonlocal number
        number += 1
        rows.append((number, text, lang, f"src{number % 3}", None, "x"))
        return number

    junk = {add(text) for text in (None, "", " \n", "12 345 ...")}
    clean = [add(words(rng, 120)) for _ in range(40)]
    bases = [words(rng, 140) for _ in range(8)]
    exact = [{add(base), add(base.replace(" ", "\t")), add(base)} for base in bases[:4]]
    near = [{add(text) for text in [base, *variants(rng, base, 3, 2)]} for base in bases[4:]]
    texts = {row[0]: row[1] for row in rows}
    assert all(jaccard(texts[min(group)], texts[i]) >= 0.8 for group in near for i in group)
    labels = [(n, n % 2, 0) for n in range(1, number, 3)] + [(1, None, 0), (None, 1, 0)]
    folder = folder_of(spark, tmp_path, rows, labels)

    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        kept.append(Counter(row["doc_id"] for row in docs.collect()))
    everything = set(texts) - junk
    assert set(kept[0]) == everything
    after_exact = everything - {i for group in exact for i in group if i != min(group)}
    assert set(kept[1]) == after_exact and len({norm(texts[i]) for i in after_exact}) == len(after_exact)
    after_near = after_exact - {i for group in near for i in group if i != min(group)}
    assert set(kept[2]) == after_near and set(clean) <= after_near
    sizes, taken = Counter(), Counter()
    for doc_id in after_near:
        count = len(re.findall(r"\S+", texts[doc_id]))
        sizes[f"src{doc_id % 3}"] += count
        taken[f"src{doc_id % 3}"] += kept[3][doc_id] * count
    targets = water_fill(sizes, {f"src{n}": w for n, w in enumerate((3.0, 1.0, 2.0))}, 1.5, 2.0)
    assert all(abs(taken[source] - targets[source]) <= 140 for source in sizes)
    assert max(kept[3].values()) <= 2 and set(kept[3]) <= after_near

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(row["doc_id"] for row in packed if row["start"] == 0) == kept[3]
    filled = defaultdict(list)
    for row in packed:
        filled[row["sequence_id"]].append((row["offset"], row["length"]))
    for pieces in filled.values():
        ends = [offset + length for offset, length in sorted(pieces)]
        assert [0, *ends[:-1]] == [offset for offset, _ in sorted(pieces)] and ends[-1] <= 4096

    again = corpus_pipeline.run(spark, folder).collect()
    tokens = lambda found: sorted((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in found)
    assert tokens(again) == tokens(packed)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, [], [])).count() == 0


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rng = random.Random(3)
    one, two = words(rng, 50), words(rng, 60)
    rows = [(1, one, "en", None, None, "x")] * 3 + [(2, two, None, "a", None, "x"), (None, words(rng, 40), "en", "a", None, "x")]
    packed = corpus_pipeline.run(spark, folder_of(spark, tmp_path, rows, [])).collect()
    assert {row["doc_id"] for row in packed} <= {1, 2, None} and len(packed) >= 3
