"""Indexing a folder of image files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.operators.imaging import (
    build_index,
    classify_files,
    infer_from_sample,
    limit_index,
)
from clinspark.session import cut_lineage
from clinspark.sources.dicom import read_dicom_headers
from clinspark.sources.files import list_files


@dataclass(frozen=True)
class ImageIndex:
    tables: dict[str, DataFrame]
    classed: DataFrame
    headers: DataFrame
    uninferred: DataFrame


def index_dicom(
    spark: SparkSession,
    root: str,
    smart: bool = False,
    max_files: int | None = None,
    partitions: int | None = None,
) -> ImageIndex:
    """Inventory, class, read, infer, roll up.

    The inventory, its classes and the headers that were read are checkpointed: listing and reading
    are slow storage calls, and each of the three feeds several tables.
    """
    inventory = cut_lineage(list_files(spark, root, max_files))
    classed = cut_lineage(classify_files(inventory, smart))
    chosen = classed if max_files is None else limit_index(classed, max_files)
    to_read = chosen.filter("class IN ('parse', 'sample')")
    headers = cut_lineage(read_dicom_headers(to_read, partitions=partitions))
    read = headers.filter("tags IS NOT NULL").select(
        "path", "size", "tags", F.lit(False).alias("inferred"), "series_group"
    )
    rest = chosen.filter("class = 'rest'").select("path", "size", "series_group")
    inferred, uninferred = infer_from_sample(
        rest, read.filter("series_group IS NOT NULL").select("series_group", "path", "tags")
    )
    tables = build_index(read.drop("series_group").unionByName(inferred))
    return ImageIndex(tables, classed, headers, uninferred)
