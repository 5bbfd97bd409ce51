"""Writing results and copying files."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.operators.filing import plan_collisions

COPY_BYTES = 4 << 20
SUFFIXES = {"anonymized": "_anonymized.txt", "summary": "_summary.txt", "translated": "_translated.txt"}


def output_name(path_column: str, kind: str):
    """``name_anonymized.txt`` and the like for a source path or name."""
    name = F.substring_index(path_column, "/", -1)
    return F.concat(F.regexp_replace(name, r"\.[^/.]+\z", ""), F.lit(SUFFIXES[kind]))


def write_texts(
    df: DataFrame, path: str, key: str, buckets: int = 64, files_per_bucket: int = 1
) -> None:
    """Write a table of texts as Parquet in ``buckets`` folders by hash of the key, each of
    ``files_per_bucket`` files: choose both so that a file is some hundred megabytes."""
    number = F.xxhash64(key)
    bucket = F.pmod(number, F.lit(buckets))
    slice_of = F.pmod(F.shiftright(number, 32), F.lit(files_per_bucket))
    (
        df.withColumn("bucket", bucket)
        .repartition(buckets * files_per_bucket, "bucket", slice_of)
        .sortWithinPartitions("bucket", key)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def write_book(changed: DataFrame, others: dict[str, DataFrame], name: str, path: str) -> None:
    """Write the changed sheet and pass every other sheet through unchanged, one folder per sheet."""
    changed.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
    for sheet, table in others.items():
        if sheet != name:
            table.write.mode("overwrite").option("header", "true").csv(f"{path}/{sheet}")


def _place(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there. URIs keep their scheme and host."""
    if "://" in root or root.startswith("file:"):
        system, path = fs.FileSystem.from_uri(root if "://" in root else "file://" + root[5:])
    else:
        system, path = fs.LocalFileSystem(), os.path.realpath(root)
    return system, path.rstrip("/") or "/"


def _digest(system: fs.FileSystem, path: str) -> bytes:
    found = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while block := stream.read(COPY_BYTES):
            found.update(block)
    return found.digest()


def _copy_one(source: fs.FileSystem, origin: str, target: fs.FileSystem, goal: str) -> str:
    """``kept`` if the target already has this content, else ``copied``.

    The copy is written under a name of its own and moved into place, so that a task that runs twice
    does no harm and nobody sees half a file.
    """
    found = target.get_file_info(goal)
    if found.type == fs.FileType.File and found.size == source.get_file_info(origin).size:
        if _digest(source, origin) == _digest(target, goal):
            return "kept"
    target.create_dir(goal.rsplit("/", 1)[0], recursive=True)
    partial = f"{goal}.{uuid.uuid4().hex}.part"
    with source.open_input_stream(origin) as stream, target.open_output_stream(partial) as out:
        while block := stream.read(COPY_BYTES):
            out.write(block)
    target.move(partial, goal)
    return "copied"


def execute_copy(
    plan: DataFrame,
    src_root: str,
    dst_root: str,
    partitions: int | None = None,
    max_copy: int | None = None,
    allow_collisions: bool = False,
) -> DataFrame:
    """(src, dst, status, error): copy the files of a plan between folders all executors can reach.

    Folders are paths or URIs of any file system that pyarrow knows. Refuses to write into the source
    and, unless allowed, to let two files share a destination. A failed file is a row with status
    ``error``, not a failed job. A file that is already in place with the same content is ``kept``, a
    different one is replaced and ``copied``. ``max_copy`` (a test run of a few files) takes the first
    files in order, which are gathered in one task.
    """
    here, there = _place(src_root), _place(dst_root)
    if here[1] == there[1] and here[0].equals(there[0]):
        raise ValueError("the output folder is the source folder")
    if not allow_collisions and not plan_collisions(plan).isEmpty():
        raise ValueError("several files share a destination; see plan_collisions")
    chosen = plan.select("src", "dst")
    if max_copy is not None:
        chosen = chosen.orderBy("src", "dst").limit(max_copy)
    if partitions:
        chosen = chosen.repartition(partitions)

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (source, from_path), (target, to_path) = _place(src_root), _place(dst_root)
        for frame in frames:
            statuses, errors = [], []
            for src, dst in zip(frame["src"], frame["dst"]):
                try:
                    statuses.append(_copy_one(source, f"{from_path}/{src}", target, f"{to_path}/{dst}"))
                    errors.append(None)
                except (OSError, pa.ArrowException) as problem:
                    statuses.append("error")
                    errors.append(f"{src}: {problem}")
            yield frame.assign(status=statuses, error=errors)

    return chosen.mapInPandas(copy, "src string, dst string, status string, error string")
