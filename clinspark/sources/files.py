"""File inventories and upload rules."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark import fixed_values as fixed
from clinspark.functions.text import as_column, file_extension
from clinspark.session import checkpoint_folder

PAGE_ENTRIES = 10_000
DIRECTORIES_PER_TASK = 64


def _relative(path: Column, root: str) -> Column:
    """``path`` without the scheme and ``root``."""
    plain = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain)


LISTED = "path string, is_dir boolean, size bigint, mtime timestamp"


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each directory (``path``), in pages of ``PAGE_ENTRIES`` rows."""
    for batch in batches:
        for uri in map(_address, batch.column("path").to_pylist()):
            system, place = fs.FileSystem.from_uri(uri)
            local = isinstance(system, fs.LocalFileSystem)
            # Options of a store (after ``?``) hold for everything below it.
            base, mark, options = uri.partition("?")
            prefix, suffix = ("file:", "") if local else (base.rstrip("/").removesuffix(_quoted(place)), mark + options)
            entries = system.get_file_info(fs.FileSelector(place, recursive=False, allow_not_found=True))
            for at in range(0, len(entries), PAGE_ENTRIES):
                page = [
                    (prefix + (entry.path if local else _quoted(entry.path)) + suffix, entry.type == fs.FileType.Directory, entry.size, None if entry.mtime_ns is None else entry.mtime_ns // 1000)
                    for entry in entries[at : at + PAGE_ENTRIES]
                    # A linked directory is listed where it really is; following links could go in circles.
                    if not (local and entry.type == fs.FileType.Directory and os.path.islink(entry.path))
                ]
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
                columns = [pa.array([row[n] for row in page], kind) for n, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "is_dir", "size", "mtime"])


def _address(path: str) -> str:
    """A URI that ``pyarrow.fs`` takes: local paths get their scheme, and characters are quoted."""
    if path.startswith("file:") or "://" not in path:
        return "file://" + _quoted("/" + path.removeprefix("file:").lstrip("/"))
    return path


def _quoted(path: str) -> str:
    return quote(path, safe="/")


def _walk(spark: SparkSession, root: str) -> DataFrame:
    """Everything below ``root`` as (path, is_dir, size, mtime), level by level.

    The directories of a level are a stored table; their entries are listed by tasks and stored, and
    the directories among them are the next level. The driver sees the number of directories of a level.
    """
    levels = f"{checkpoint_folder(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(levels)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    directories, count, depth = spark.createDataFrame([(root,)], "path string"), 1, 0
    while count:
        # Waits on storage, not work: a few directories a task, spread over more tasks than cores.
        tasks = max(1, min(-(-count // DIRECTORIES_PER_TASK), 32 * spark.sparkContext.defaultParallelism))
        listed = directories.repartition(tasks).mapInArrow(_list_directories, LISTED)
        listed.write.parquet(f"{levels}/level={depth}")
        directories = spark.read.schema(LISTED).parquet(f"{levels}/level={depth}").filter("is_dir").select("path")
        count, depth = directories.count(), depth + 1
    return spark.read.schema(LISTED).parquet(*[f"{levels}/level={n}" for n in range(depth)])


def list_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """(path, dir, name, size, mtime, uri) of every file below ``root``.

    Directories are listed by tasks, one level of the tree after the other, so no file's status
    passes through the driver and no file is opened. A folder whose scheme only Spark's readers know
    is listed by the metadata columns of the binary source instead. ``max_files`` is the test-mode cap.
    """
    try:
        system, place = fs.FileSystem.from_uri(_address(root))
        if system.get_file_info(place).type != fs.FileType.Directory:
            raise FileNotFoundError(root)
        found = _walk(spark, root).filter("not is_dir").select(F.col("path"), F.col("size").alias("length"), F.col("mtime").alias("modificationTime"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = _relative(F.col("path"), root)
    name = F.substring_index(path, "/", -1)
    files = found.select(
        path.alias("path"),
        F.when(
            F.contains(path, F.lit("/")),
            F.substring(path, F.lit(1), F.length(path) - F.length(name) - 1),
        ).otherwise("").alias("dir"),
        name.alias("name"),
        F.col("length").cast("bigint").alias("size"),
        F.date_trunc("millisecond", "modificationTime").alias("mtime"),
        F.col("path").alias("uri"),
    )
    return files if max_files is None else files.orderBy("path").limit(max_files)


def upload_problem(
    name: Column | str, size: Column | str, purpose: str, max_bytes: int | None = fixed.MAX_DOCX_BYTES
) -> Column:
    """Why a file is refused for a purpose (``docx``, ``audio``, ``anonymize``, ``pdf``), or NULL.
    ``max_bytes`` holds for docx; None lets any size in."""
    extension, size = file_extension(name), as_column(size)
    if purpose == "docx":
        return F.when(extension != "docx", "invalid file type").when(
            F.lit(False) if max_bytes is None else size > max_bytes, "file is too large"
        )
    allowed = {
        "audio": fixed.AUDIO_EXTENSIONS,
        "anonymize": fixed.ANONYMIZE_EXTENSIONS,
        "pdf": ("pdf",),
    }[purpose]
    return F.when(~extension.isin(*allowed), "unsupported file type")


def accept_files(
    files: DataFrame, purpose: str, max_bytes: int | None = fixed.MAX_DOCX_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; rejected files carry a ``reason``. ``max_bytes`` holds for docx."""
    judged = files.withColumn("reason", upload_problem("name", "size", purpose, max_bytes))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")
