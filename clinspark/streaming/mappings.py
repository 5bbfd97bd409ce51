"""Anonymizing streams with a mapping that grows across documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from clinspark import fixed_values as fixed
from clinspark.functions.chunking import chunk_text, explode_chunks
from clinspark.functions.text import entity_key, trim_spaces
from clinspark.operators.detection import rule_detect, rule_matches, rule_type
from clinspark.operators.guarding import ModelFn
from clinspark.operators.inference import Detector
from clinspark.operators.rewriting import anonymize_text, apply_global_mapping
from clinspark.plans.anonymize import extend_mapping, run_passes, withheld
from clinspark.session import cut_lineage

MAPPING = "entity string, type string, replacement string, seq bigint"


def known_mapping(spark: SparkSession, path: str, before_batch: int) -> DataFrame:
    """The mapping rows written by batches before ``before_batch``.

    Only a folder that is not there means that no batch has written yet; any other trouble with it is
    an error, since numbering would start again and tags would collide.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place) or not files.listStatus(place):
        return spark.createDataFrame([], MAPPING)
    rows = spark.read.schema(MAPPING + ", batch bigint").parquet(path)
    return rows.filter(F.col("batch") < before_batch).drop("batch")


def anonymize_stream(
    docs: DataFrame,
    mapping_path: str,
    output_path: str,
    checkpoint: str,
    key: str = "doc_id",
    detector: Detector | None = None,
    chunk_size: tuple[int, int] = fixed.CHUNK_DEFAULT,
    passes: tuple[str, ...] = ("ner",),
    model_fn: ModelFn | None = None,
    filter_garbage: bool = False,
    release_failed: bool = False,
    deadline_s: float | None = None,
):
    """A stream writer that anonymizes documents with one mapping that only grows.

    Entities are found by the passes of ``plans.anonymize`` (``detector`` or the rules, a review and a
    second pass by ``model_fn``). Each batch is detected once, reads the mapping of earlier batches,
    numbers its new entities after them, and writes its own rows to the folder of its batch id,
    replacing what an interrupted run of the same batch left there. Running a batch twice therefore
    changes nothing. With a detector or model the texts carry ``error``: a text with a failed request is
    withheld unless ``release_failed``. Start the returned writer with the trigger of your choice.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = known_mapping(spark, mapping_path, batch_id)
        failed = None
        if detector is None and model_fn is None:
            found, order = rule_detect(batch, [key]), [key, "pos"]
        else:
            chunks = cut_lineage(explode_chunks(batch, chunk_text("text", *chunk_size), [key]))
            done = run_passes(chunks, [key], passes, detector, model_fn, filter_garbage, deadline_s)
            found, failed, order = done.found, done.failed, ["phase", key, "chunk_idx", "pos"]
        extended = extend_mapping(cut_lineage(found), [], order, known)
        fresh = extended.join(
            known.select(entity_key("entity").alias("_key")),
            entity_key("entity") == F.col("_key"),
            "left_anti",
        )
        folder = f"{mapping_path}/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(folder)
        written = spark.read.schema(MAPPING).parquet(folder)
        texts = apply_global_mapping(batch, known.unionByName(written), [key])
        if failed is not None and not release_failed:
            texts = withheld(texts, failed, [key])
        texts.write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


class SessionMapping(StatefulProcessor):
    """The mapping of one session; entries vanish ``ttl_ms`` after their last use."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState(
            "entries", "entity string", "type string, replacement string, seq long", self.ttl_ms
        )
        self.counters = handle.getMapState("counters", "type string", "last long", self.ttl_ms)

    def _last(self, kind: str) -> int:
        return self.counters.getValue((kind,))[0] if self.counters.containsKey((kind,)) else 0

    def _replacement(self, entity: str, kind: str) -> tuple[str, int]:
        name = (entity.lower(),)
        last, every = self._last(kind), self._last("")
        if self.entries.containsKey(name):
            kind, replacement, seq = self.entries.getValue(name)
            last = self._last(kind)
        else:
            last, every = last + 1, every + 1
            replacement, seq = f"[{kind}_{last}]", every
        # Writing again renews the time to live, of the entry as of its counters: a counter never goes
        # before the entries it has numbered, so no tag is given twice.
        self.entries.updateValue(name, (kind, replacement, seq))
        self.counters.updateValue((kind,), (last,))
        self.counters.updateValue(("",), (every,))
        return replacement, seq

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        docs = pd.concat(list(rows)).sort_values("doc_id")
        out = []
        for doc in docs.itertuples():
            entries = []
            for hit in doc.hits:
                replacement, seq = self._replacement(hit["entity"], hit["type"])
                entries.append({"entity": hit["entity"], "replacement": replacement, "seq": seq})
            out.append((key[0], doc.doc_id, doc.text, entries))
        yield pd.DataFrame(out, columns=["session_id", "doc_id", "text", "entries"])

    def close(self) -> None:
        pass


def session_mapping_stream(docs: DataFrame, ttl_ms: int = 30 * 60 * 1000) -> DataFrame:
    """Anonymize a stream of (session_id, doc_id, text) with one mapping per session that is
    forgotten after ``ttl_ms`` without use. Detection and rewriting stay in the JVM; only the short
    hit lists are numbered in the stateful operator."""
    hits = F.transform(
        rule_matches("text"),
        lambda hit: F.struct(trim_spaces(hit).alias("entity"), rule_type(hit).alias("type")),
    )
    numbered = (
        docs.select("session_id", "doc_id", "text", hits.alias("hits"))
        .groupBy("session_id")
        .transformWithStateInPandas(
            SessionMapping(ttl_ms),
            StructType.fromDDL(
                "session_id string, doc_id long, text string, "
                "entries array<struct<entity:string,replacement:string,seq:long>>"
            ),
            "append",
            "ProcessingTime",
        )
    )
    entries = F.array_distinct("entries")
    return numbered.select(
        "session_id", "doc_id", anonymize_text(F.col("text"), entries).alias("anonymized_text")
    )
