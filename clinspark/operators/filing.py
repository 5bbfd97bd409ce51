"""Destination plans: where every file of an index goes, and how to copy it there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark import fixed_values as fixed
from clinspark.functions.text import format_dicom_date, sanitize_path
from clinspark.operators.imaging import SERIES, STUDY, by_study, exclude_modalities, roll_up, split_studies
from clinspark.operators.ordering import ordinal_within
from clinspark.session import cut_lineage


def label_tag_of(modality: Column, optional_tags: Column) -> Column:
    """The label tag of a therapy series, out of its optional tags."""
    return (
        F.when(modality == "RTSTRUCT", F.try_element_at(optional_tags, F.lit("StructureSetLabel")))
        .when(modality == "RTPLAN", F.try_element_at(optional_tags, F.lit("RTPlanLabel")))
        .when(modality == "RTDOSE", F.try_element_at(optional_tags, F.lit("DoseType")))
    )


def series_label(label_tag: Column, description: Column, number: Column) -> Column:
    """The folder label of a series: the label tag of therapy series, else the description, else
    ``S`` and the series number."""
    empty = F.lit("")
    return F.coalesce(
        F.nullif(label_tag, empty),
        F.nullif(description, empty),
        F.concat(F.lit("S"), F.coalesce(number, empty)),
    )


def complete_patients(series: DataFrame, required: list[str]) -> DataFrame:
    """Patients that have every required modality (looked at before any exclusion)."""
    return (
        series.filter(F.col("modality").isin(*required))
        .groupBy("patient_id")
        .agg(F.array(*[F.bool_or(F.col("modality") == modality) for modality in set(required)]).alias("_have"))
        .filter(~F.array_contains("_have", False))
        .select("patient_id")
    )


def primary_series(series: DataFrame) -> DataFrame:
    """Per study, the imaging series with the most files; the first one on ties."""
    rank = F.struct((-F.col("file_count")).alias("fewer"), F.col("first_place"))
    return (
        series.filter(F.col("modality").isin(*fixed.IMAGING_MODALITIES))
        .groupBy(*STUDY)
        .agg(F.min_by(F.struct("series_uid", "modality", "label"), rank).alias("primary"))
    )


def nest_plans(plans: DataFrame, structs: DataFrame) -> DataFrame:
    """Folders of RTPLAN series: one under every RTSTRUCT of the study, or under the primary series
    if the study has none.

    Every such pair is a destination of its own, so the product per study is the result itself.
    """
    under = structs.select(*STUDY, F.col("folder").alias("_struct_folder"))
    parent = F.coalesce("_struct_folder", "primary_folder")
    nested = plans.join(under, STUDY, "left")
    return nested.withColumn("folder", F.concat(parent, F.lit("/RTPLAN_"), F.col("label")))


def _dated() -> Column:
    """The study's part of a folder: date and description."""
    date = F.coalesce(F.nullif(format_dicom_date("study_date"), F.lit("")), F.lit(fixed.NO_DATE))
    description = F.coalesce(F.nullif(F.col("study_description"), F.lit("")), F.lit(fixed.NO_DESCRIPTION))
    return F.concat(date, F.lit("_"), sanitize_path(description))


def series_folders(
    index: dict[str, DataFrame],
    mode: str = "nested",
    excluded: list[str] | None = None,
    required: list[str] | None = None,
    complete: DataFrame | None = None,
) -> DataFrame:
    """(patient, study, series, file_count, folder): the destination folders of every series. ``complete`` are
    the patients to keep, if they are known already."""
    series = index["series"].join(index["studies"].drop("series_count"), STUDY)
    if required and complete is None:
        complete = complete_patients(index["series"], required)
    if complete is not None:
        series = series.join(complete, "patient_id", "left_semi")
    series = exclude_modalities(series, excluded or [])
    label_tag = label_tag_of(F.col("modality"), F.col("optional_tags"))
    label = series_label(label_tag, F.col("series_description"), F.col("series_number"))
    labelled = series.select(
        *SERIES,
        "modality",
        "file_count",
        "first_place",
        sanitize_path(label).alias("label"),
        F.concat(sanitize_path("patient_id"), F.lit("/"), _dated()).alias("base"),
    )
    sibling = F.concat(F.col("base"), F.lit("/"), F.col("modality"), F.lit("_"), F.col("label"))
    if mode == "modality":
        return labelled.select(*SERIES, "file_count", F.concat_ws("/", "base", "modality", "label").alias("folder"))
    if mode == "flat":
        return labelled.select(*SERIES, "file_count", sibling.alias("folder"))
    if mode != "nested":
        raise ValueError(f"unknown mode {mode!r}")
    primary_folder = F.concat(
        F.col("base"), F.lit("/"), F.col("primary.modality"), F.lit("_"), F.col("primary.label")
    )
    placed = labelled.join(primary_series(labelled), STUDY, "left").select(
        *SERIES, "modality", "file_count", "label", "base", primary_folder.alias("primary_folder")
    )
    # Read three times below; one row per series, so writing it is cheaper than joining it again.
    placed = cut_lineage(placed)
    nested = F.col("primary_folder").isNotNull() & F.col("modality").isin(*fixed.THERAPY_MODALITIES)
    below = F.concat(
        F.col("primary_folder"), F.lit("/"), F.col("modality"), F.lit("_"), F.col("label")
    )
    is_plan = nested & (F.col("modality") == "RTPLAN")
    others = placed.filter(~is_plan).withColumn("folder", F.when(nested, below).otherwise(sibling))
    structs = others.filter(nested & (F.col("modality") == "RTSTRUCT"))
    columns = [*SERIES, "file_count", "folder"]
    plans = nest_plans(placed.filter(is_plan), structs)
    return others.select(*columns).unionByName(plans.select(*columns))


def _folders_in_study(files: DataFrame, mode: str, excluded: list[str]) -> DataFrame:
    """(patient, study, series, path, folder) of files (``SERIES``, ``file``) that are dealt by study.

    The rules are those of ``series_folders``. Every file learns the first file of its series and what its
    study has by windows over the one order in which the files of a task are sorted.
    """
    of_series, of_study = Window.partitionBy(*SERIES), Window.partitionBy(*STUDY)
    first = F.min("file").over(of_series).alias("first")
    placed = files.select(*SERIES, "file.path", first, F.count("*").over(of_series).alias("file_count"))
    kept = ~F.col("modality").isin(*excluded) if excluded else F.lit(True)
    known = placed.select("*", "first.modality", "first.label", F.min("first").over(of_study)["dated"].alias("dated"))
    base = F.concat(sanitize_path("patient_id"), F.lit("/"), "dated")
    if mode == "modality":
        folders = F.array(F.concat_ws("/", base, "modality", "label"))
    else:
        folders = F.array(F.concat(base, F.lit("/"), "modality", F.lit("_"), "label"))
    if mode == "nested":
        rank = F.struct((-F.col("file_count")).alias("fewer"), F.col("first.inferred"), F.col("first.path"), "modality", "label")
        primary = F.min(F.when(kept & F.col("modality").isin(*fixed.IMAGING_MODALITIES), rank))
        struct = F.when(kept & (F.col("modality") == "RTSTRUCT"), F.struct("series_uid", "label"))
        known = known.select("*", primary.over(of_study).alias("primary"), F.collect_set(struct).over(of_study).alias("structs"))
        parent = F.concat(base, F.lit("/"), F.col("primary.modality"), F.lit("_"), F.col("primary.label"))
        below = F.concat(parent, F.lit("/"), "modality", F.lit("_"), "label")
        under = F.transform("structs", lambda one: F.concat(parent, F.lit("/RTSTRUCT_"), one["label"], F.lit("/RTPLAN_"), F.col("label")))
        nested = F.col("primary").isNotNull() & F.col("modality").isin(*fixed.THERAPY_MODALITIES)
        is_plan = nested & (F.col("modality") == "RTPLAN") & (F.size("structs") > 0)
        folders = F.when(is_plan, under).when(nested, F.array(below)).otherwise(folders)
    return known.filter(kept).select(*SERIES, "path", F.explode(folders).alias("folder"))


def file_folders(
    index: dict[str, DataFrame],
    mode: str = "nested",
    excluded: list[str] | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """(patient, study, series, path, folder): every file of ``rows`` of the index with its destination folders.

    Files are dealt once, by study. Those of large studies, if there are any, go by way of their series.
    """
    if mode not in ("nested", "flat", "modality"):
        raise ValueError(f"unknown mode {mode!r}")
    rows, large, total = split_studies(index["rows"])
    label = series_label(F.col("label_tag"), F.col("series_description"), F.col("series_number"))
    file = F.struct("inferred", "path", "modality", sanitize_path(label).alias("label"), _dated().alias("dated"))
    files = by_study(rows.select(*SERIES, file.alias("file")), total)
    folders = _folders_in_study(files, mode, excluded or [])
    tables = None if large is None else roll_up(large)
    complete = None
    if required:
        first_files = files.groupBy(*SERIES).agg(F.min("file").alias("first"))
        kinds = first_files.select("patient_id", F.col("first.modality").alias("modality"))
        if tables is not None:
            kinds = kinds.unionByName(tables["series"].select("patient_id", "modality"))
        complete = complete_patients(kinds, required)
        # Only studies meet patients; files stay where they are.
        studies = first_files.select(*STUDY).distinct().join(complete, "patient_id", "left_semi")
        folders = folders.join(studies, STUDY, "left_semi")
    if tables is not None:
        of_series = series_folders(tables, mode, excluded, None, complete).drop("file_count")
        folders = folders.unionByName(tables["files"].select(*SERIES, "path").join(of_series, SERIES))
    return folders


def sort_plan(
    index: dict[str, DataFrame],
    mode: str = "nested",
    excluded: list[str] | None = None,
    required: list[str] | None = None,
    max_copy: int | None = None,
) -> DataFrame:
    """(patient, study, series, src, dst) of the files in ``rows`` of the index. ``max_copy`` is the test-mode cap."""
    plan = file_folders(index, mode, excluded, required).select(
        *SERIES,
        F.col("path").alias("src"),
        F.concat(F.col("folder"), F.lit("/"), F.substring_index("path", "/", -1)).alias("dst"),
    )
    return plan if max_copy is None else plan.orderBy("src", "dst").limit(max_copy)


def plan_collisions(plan: DataFrame) -> DataFrame:
    """Destinations that several plan rows share; copying them would overwrite silently."""
    return (
        plan.groupBy("dst")
        .agg(F.count("*").cast("bigint").alias("sources"))
        .filter("sources > 1")
    )


def _ancestors(folder: Column) -> Column:
    """``folder`` and all folders above it."""
    parts = F.split(folder, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda depth: F.array_join(F.slice(parts, 1, depth), "/")
    )


def plan_tree(plan: DataFrame) -> DataFrame:
    """Files per destination folder and per ancestor folder."""
    name = F.substring_index("dst", "/", -1)
    folder = F.substring(F.col("dst"), F.lit(1), F.length("dst") - F.length(name) - 1)
    return (
        plan.filter(F.contains("dst", F.lit("/")))
        .select(F.explode(_ancestors(folder)).alias("folder"))
        .groupBy("folder")
        .agg(F.count("*").cast("bigint").alias("files"))
    )


def folder_counts(files: DataFrame) -> DataFrame:
    """(patient, study, folder, file_count) of ``file_folders``, counted where a study's files lie."""
    return files.groupBy(*STUDY, "folder").agg(F.count("*").cast("bigint").alias("file_count"))


def folder_tree(folders: DataFrame) -> DataFrame:
    """``plan_tree`` of the plan for ``folders`` (of ``series_folders`` or ``folder_counts``): they come with
    the number of their files, so no file is looked at."""
    return (
        folders.select(F.explode(_ancestors(F.col("folder"))).alias("folder"), "file_count")
        .groupBy("folder")
        .agg(F.sum("file_count").cast("bigint").alias("files"))
    )


def copy_batches(plan: DataFrame, batch: int = fixed.COPY_BATCH) -> DataFrame:
    """File names per (source folder, destination folder), ``batch`` at a time."""

    def folder(path: str) -> Column:
        name = F.substring_index(path, "/", -1)
        return F.substring(F.col(path), F.lit(1), F.length(path) - F.length(name) - 1)

    pairs = plan.select(
        F.coalesce(F.nullif(folder("src"), F.lit("")), F.lit(".")).alias("src_dir"),
        folder("dst").alias("dst_dir"),
        F.substring_index("src", "/", -1).alias("name"),
    )
    keys = ["src_dir", "dst_dir"]
    numbered = ordinal_within(pairs, keys, ["name"]).withColumn(
        "batch_no", F.floor((F.col("ordinal") - 1) / batch).cast("bigint")
    )
    return numbered.groupBy(*keys, "batch_no").agg(
        F.sort_array(F.collect_list("name")).alias("names")
    )


def copy_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.when(F.col("status") == "copied", True)).cast("bigint").alias("copied"),
        F.count(F.when(F.col("status") == "kept", True)).cast("bigint").alias("kept"),
        F.count(F.when(F.col("status") == "error", True)).cast("bigint").alias("errors"),
        F.count("*").cast("bigint").alias("total"),
    )
