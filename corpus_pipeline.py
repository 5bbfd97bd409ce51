"""Documents to packed training sequences in five stages, each a stored table.

Every stage takes all rows that the stage before it left and gives the columns of ``documents``; the
last one gives the packed pieces. A stage's operator states what it does with nulls, empty and repeated
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.llm.common import staged, table
from clinspark.llm.exact_dedup import exact_dedup
from clinspark.llm.language_ppm import UNKNOWN, fit, predict
from clinspark.llm.mixing import mix_sources, word_count
from clinspark.llm.packing import pack_documents
from clinspark.llm.registered import quality_weight, tokenizer_file
from clinspark.llm.near_copies import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text or without a letter go; a missing label is filled in."""
    model = fit(docs, "doc_id", "text", "lang")
    said = predict(docs.select(*COLUMNS), model)
    lang = F.coalesce("lang", "lang_pred").alias("lang")
    return said.filter(F.col("lang_pred") != UNKNOWN).select("doc_id", "text", lang, "source", "n_chars")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to runs of white space) the smallest id stays."""
    return exact_dedup(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    gone = near_duplicates(docs).filter("doc_id <> keep_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it: not at all, once or twice."""
    sized = quality_weight(
        docs.select("doc_id", "source", word_count("text").alias("size")), table(spark, sf_dir, "labels")
    )
    plan = mix_sources(staged(sized, "mix-sizes"), F.col("_quality")).select("doc_id", "source", "size", "copies")
    # Rows that repeat an id are told apart by source and size; equal ones are taken alike.
    times = plan.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    sized_docs = docs.select(*COLUMNS, word_count("text").alias("_size"))
    same = (
        sized_docs["doc_id"].eqNullSafe(times["doc_id"])
        & sized_docs["source"].eqNullSafe(times["source"])
        & (F.col("_size") == times["size"])
    )
    wanted = sized_docs.join(times, same).withColumn(
        "_times", F.expr("cast(_all div _rows + if(_all % _rows > pmod(hash(text), _rows), 1, 0) as int)")
    )
    repeated = wanted.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(*[sized_docs[name] for name in COLUMNS])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = pack_documents(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"), digest=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", known_language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("mix", mixed_sources),
    ("pack", packed_sequences),
]
# Language models, fingerprints and tokenizers are not SQL: checked by brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
