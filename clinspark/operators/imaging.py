"""Image inventories: classing files, inferring headers, and the patient/study/series index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark import fixed_values as fixed
from clinspark.functions.signals import guess_modality, looks_like_image
from clinspark.functions.text import format_dicom_date, human_size
from clinspark.operators.ordering import exact_median, ordinal_within
from clinspark.session import cut_lineage


# --- classing files ------------------------------------------------------------------------------
def directory_profile(files: DataFrame) -> DataFrame:
    """Per directory: candidates, exact median size, files of similar size, files per guessed
    imaging modality."""
    candidates = files.filter(looks_like_image("name", "size")).withColumn(
        "_guess", guess_modality("name")
    )
    sizes = candidates.groupBy("dir", "size").agg(
        F.count("*").alias("_n"),
        *[
            F.count(F.when(F.col("_guess") == modality, True)).alias(f"_{modality}")
            for modality in fixed.IMAGING_MODALITIES
        ],
    )
    medians = exact_median(sizes, ["dir"], "size", weight="_n")
    near = F.abs(F.col("size") - F.col("median")) < F.col("median") * fixed.SIMILAR_SIZE_RATIO
    return (
        sizes.join(medians, "dir")
        .groupBy("dir")
        .agg(
            F.sum("_n").alias("candidates"),
            F.first("median").alias("median"),
            F.coalesce(F.sum(F.when(near, F.col("_n"))), F.lit(0)).alias("similar"),
            *[
                F.sum(f"_{modality}").alias(f"guessed_{modality.lower()}")
                for modality in fixed.IMAGING_MODALITIES
            ],
        )
    )


def is_sample_position(index: Column, total: Column, samples: int) -> Column:
    """Whether the zero-based ``index`` is one of ``samples`` evenly spaced places of ``total``."""
    step = total / F.lit(samples + 1)
    places = [F.floor(step * number) for number in range(1, samples + 1)]
    spaced = index.isin(*places)
    return F.when(total <= samples, F.lit(True)).otherwise(spaced)


def classify_files(files: DataFrame, smart: bool = False) -> DataFrame:
    """``files`` plus ``class`` (parse, sample, rest, skip) and ``series_group``.

    Without ``smart`` every candidate is parsed. With it, a directory of at least ten candidates of
    similar, slice-like size is sampled (outliers are parsed); otherwise files named like CT, MR or
    PT slices are sampled per modality from ten on, and the rest is parsed. Positions follow the
    path order within a group.
    """
    image = looks_like_image("name", "size")
    if not smart:
        kind = F.when(image, "parse").otherwise("skip")
        return files.withColumn("class", kind).withColumn(
            "series_group", F.lit(None).cast("string")
        )
    profile = directory_profile(files)
    seen = files.withColumn("_image", image).withColumn(
        "_guess", F.when(F.col("_image"), guess_modality("name"))
    )
    joined = seen.join(profile, "dir", "left")
    many = fixed.SERIES_MIN_FILES
    slices = (
        (F.col("candidates") >= many)
        & (F.col("similar") >= many)
        & F.col("median").between(fixed.SERIES_MEDIAN_MIN, fixed.SERIES_MEDIAN_MAX)
    )
    near = F.abs(F.col("size") - F.col("median")) < F.col("median") * fixed.SIMILAR_SIZE_RATIO
    guess = F.col("_guess")
    group = F.when(
        slices, F.when(near, F.struct(F.lit("size").alias("by"), F.col("similar").alias("total")))
    )
    for modality in fixed.IMAGING_MODALITIES:
        count = F.col(f"guessed_{modality.lower()}")
        group = group.when(
            (guess == modality) & (count >= many),
            F.struct(F.lit(modality).alias("by"), count.alias("total")),
        )
    grouped = joined.withColumn("_group", F.when(F.col("_image"), group)).select(
        *files.columns, "_image", "_group.by", "_group.total"
    )
    # Numbering samples, counts and numbers these rows, and the rest of them is read once more.
    grouped = cut_lineage(grouped)
    members = ordinal_within(grouped.filter("by IS NOT NULL"), ["dir", "by"], ["path"])
    sampled = is_sample_position(
        F.col("ordinal") - 1, F.col("total"), fixed.SAMPLES_PER_SERIES
    )
    in_series = members.withColumn("class", F.when(sampled, "sample").otherwise("rest"))
    in_series = in_series.withColumn("series_group", F.concat_ws("|", "dir", "by"))
    alone = grouped.filter("by IS NULL").withColumn(
        "class", F.when(F.col("_image"), "parse").otherwise("skip")
    )
    alone = alone.withColumn("series_group", F.lit(None).cast("string"))
    columns = [*files.columns, "class", "series_group"]
    return in_series.select(*columns).unionByName(alone.select(*columns))


def limit_index(classed: DataFrame, max_files: int) -> DataFrame:
    """Test mode: parse at most ``max_files`` files, then fill up with samples, then inferred rows.

    This cap is the feature; without it nothing is limited.
    """
    priority = (
        F.when(F.col("class") == "parse", 0).when(F.col("class") == "sample", 1).otherwise(2)
    )
    return (
        classed.filter("class <> 'skip'")
        .withColumn("_priority", priority)
        .orderBy("_priority", "series_group", "path")
        .limit(max_files)
        .drop("_priority")
    )


# --- headers -------------------------------------------------------------------------------------
def infer_from_sample(rest: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(inferred, uninferred)``: unread files take the tags of the first sample of their group that
    has a modality; files of groups without such a sample are returned, not lost.

    ``samples`` holds ``series_group``, ``path``, ``tags``; one row per group reaches the join.
    """
    usable = samples.filter(F.coalesce(F.col("tags")["Modality"], F.lit("")) != "")
    models = usable.groupBy("series_group").agg(F.min_by("tags", "path").alias("_model"))
    joined = rest.join(models, "series_group")
    own = F.create_map(
        F.lit("SOPInstanceUID"),
        F.concat(F.lit("inferred-"), F.col("path")),
        F.lit("InstanceNumber"),
        F.lit(""),
    )
    others = F.map_filter(
        "_model", lambda key, _: ~key.isin("SOPInstanceUID", "InstanceNumber")
    )
    inferred = joined.select(
        "path", "size", F.map_concat(others, own).alias("tags"), F.lit(True).alias("inferred")
    )
    uninferred = rest.join(models, "series_group", "left_anti")
    return inferred, uninferred


def project_tags(tags: Column | str, modality: Column | str) -> Column:
    """Only the optional tags of the series' modality."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    modality = F.col(modality) if isinstance(modality, str) else modality

    def chosen(keys: tuple[str, ...]) -> Column:
        return F.map_filter(tags, lambda key, _: key.isin(*keys))

    kept = None
    for name, keys in fixed.OPTIONAL_TAGS.items():
        match = modality == name
        kept = F.when(match, chosen(keys)) if kept is None else kept.when(match, chosen(keys))
    return kept.otherwise(F.create_map().cast("map<string,string>"))


STUDY = ["patient_id", "study_uid"]
SERIES = [*STUDY, "series_uid"]
OF_SERIES = (
    "modality", "series_number", "series_description", "frame_of_reference_uid", "manufacturer", "institution",
    "optional_tags",
)
OF_STUDY = ("study_date", "study_description", "accession_number")
OF_PATIENT = ("patient_name", "birth_date", "sex")
# A study of at most so many files lies in one task, and a series of as many is gathered in one row.
GATHERED_FILES = 20_000
# So many files meet in a task that holds whole studies.
ROWS_PER_TASK = 1_250_000
# What the plans, the totals and the sheets read of an index, for ``keep``.
KEPT_BY_PLANS = ("modality", "series_number", "series_description", "label_tags", "study_date", "study_description")
KEPT_BY_TOTALS = ("modality", "total_size", "inferred_count")
KEPT_BY_SHEET = (*OF_SERIES, "study_date", "study_description", "patient_name", "total_size")
KEPT_BY_DOCUMENTS = (*OF_SERIES, *OF_STUDY, *OF_PATIENT, "total_size")
KEPT_BY_DETAIL = ("modality", "series_description", "study_date")


def file_rows(headers: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per file of headers with ``path``, ``size``, ``tags``, ``inferred``: its keys and every attribute
    that a level may take from it. Without ``tags``, each tag is a column of its own (null: the file has none);
    then tags that a caller's columns do not need are not worked out or moved.

    ``label_tag`` is the tag that labels a therapy series; without ``optional_tags`` in ``keep``, the label tags
    are the only optional ones.
    """
    mapped = "tags" in headers.columns

    def tag(key: str) -> Column:
        if mapped:
            return F.col("tags")[key]
        return F.col(key) if key in headers.columns else F.lit(None).cast("string")

    def value(key: str, missing: str = "") -> Column:
        return F.coalesce(F.nullif(tag(key), F.lit("")), F.lit(missing)) if missing else F.coalesce(tag(key), F.lit(""))

    modality = value("Modality", fixed.UNKNOWN_MODALITY)
    tags = F.col("tags") if mapped else F.create_map().cast("map<string,string>")
    optional = sorted({key for keys in fixed.OPTIONAL_TAGS.values() for key in keys} & {*headers.columns})
    if optional and not mapped:
        given = [F.struct(F.lit(key).alias("key"), tag(key).alias("value")) for key in optional]
        tags = F.map_from_entries(F.filter(F.array(*given), lambda one: one["value"].isNotNull()))
    chosen = project_tags(tags, modality)
    if keep is not None and "optional_tags" not in keep:
        chosen = F.map_filter(chosen, lambda key, _: key.isin(*fixed.LABEL_TAGS))
    label_tag = F.lit(None).cast("string")
    for key in fixed.LABEL_TAGS:
        owners = [name for name, keys in fixed.OPTIONAL_TAGS.items() if key in keys]
        label_tag = F.when(modality.isin(*owners), tag(key)).otherwise(label_tag)
    return headers.select(
        value("PatientID", fixed.UNKNOWN_PATIENT).alias("patient_id"),
        value("StudyInstanceUID", fixed.UNKNOWN_STUDY).alias("study_uid"),
        value("SeriesInstanceUID", fixed.UNKNOWN_SERIES).alias("series_uid"),
        "path",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        value("InstanceNumber").alias("instance_number"),
        value("SOPInstanceUID").alias("sop_instance_uid"),
        F.coalesce("inferred", F.lit(False)).alias("inferred"),
        modality.alias("modality"),
        value("SeriesNumber").alias("series_number"),
        value("SeriesDescription").alias("series_description"),
        value("FrameOfReferenceUID").alias("frame_of_reference_uid"),
        value("Manufacturer").alias("manufacturer"),
        value("InstitutionName").alias("institution"),
        F.map_entries(chosen).alias("optional_tags"),
        value("StudyDate").alias("study_date"),
        value("StudyDescription").alias("study_description"),
        value("AccessionNumber").alias("accession_number"),
        value("PatientName").alias("patient_name"),
        value("PatientBirthDate").alias("birth_date"),
        value("PatientSex").alias("sex"),
        label_tag.alias("label_tag"),
    )


def build_index(headers: DataFrame, keep: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The ``files``, ``series``, ``studies`` and ``patients`` tables of headers with ``path``,
    ``size``, ``tags``, ``inferred``, and ``rows``: the files with their own attributes.

    ``keep`` names the attributes and sums (``total_size``, ``inferred_count``) that the caller
    reads; the others are not carried (``label_tags`` are those optional tags that label folders).
    """
    return roll_up(file_rows(headers, keep), keep)


def roll_up(rows: DataFrame, keep: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The tables of ``build_index`` for ``file_rows``.

    The first file of a level gives its attributes: read headers before inferred ones, then by path.
    Files are aggregated once, by series, with map-side combining, and that roll-up is checkpointed:
    studies, patients and totals all come from it and would otherwise each go through every file again.
    """
    attributes = [*OF_SERIES, *OF_STUDY, *OF_PATIENT]
    # Rows are ordered by their place, which leads the struct: the place travels once, and of the tags only
    # those that the series keeps.
    sums = {"total_size": F.sum("size"), "inferred_count": F.sum(F.col("inferred").cast("bigint"))}
    if keep is not None:
        wanted = {*keep, *(["optional_tags"] if "label_tags" in keep else [])}
        attributes = [name for name in attributes if name in wanted]
        sums = {name: column for name, column in sums.items() if name in keep}
    first_of_series = rows.groupBy(*SERIES).agg(
        F.min(F.struct("inferred", "path", *attributes)).alias("first"),
        F.count("*").cast("bigint").alias("file_count"),
        *[column.cast("bigint").alias(name) for name, column in sums.items()],
    )
    series_level = cut_lineage(first_of_series)
    of_series, of_study, of_patient = (
        [name for name in names if name in attributes] for names in (OF_SERIES, OF_STUDY, OF_PATIENT)
    )
    lead = [f"first.{name}" for name in ("inferred", "path", *of_study, *of_patient)]
    studies = series_level.groupBy(*STUDY).agg(
        F.min(F.struct(*lead)).alias("first"), F.count("*").cast("bigint").alias("series_count")
    )
    patients = studies.groupBy("patient_id").agg(
        F.min(F.struct(*[f"first.{name}" for name in ("inferred", "path", *of_patient)])).alias("first"),
        F.count("*").cast("bigint").alias("study_count"),
    )
    series = series_level.select(
        *SERIES,
        F.struct("first.inferred", "first.path").alias("first_place"),
        *[f"first.{name}" for name in of_series if name != "optional_tags"],
        "file_count",
        *sums,
        *[F.map_from_entries(f"first.{name}").alias(name) for name in of_series if name == "optional_tags"],
    )
    return {
        "rows": rows,
        "files": rows.select(*SERIES, "path", "size", "instance_number", "sop_instance_uid", "inferred"),
        "series": series,
        "studies": studies.select(*STUDY, *[f"first.{name}" for name in of_study], "series_count"),
        "patients": patients.select("patient_id", *[f"first.{name}" for name in of_patient], "study_count"),
    }


def split_studies(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of studies of at most ``GATHERED_FILES`` files, those of larger studies (None if there are none)
    and the number of all rows.

    Studies are counted by a hash of their keys. Two that share one may count as large together, which
    changes their way and not the result. There are at most all rows / ``GATHERED_FILES`` large ones.
    """
    study = F.xxhash64(*STUDY).alias("_study")
    counts = rows.groupBy(study).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if most <= GATHERED_FILES:
        return rows, None, total
    large = F.broadcast(cut_lineage(counts.filter(F.col("_n") > GATHERED_FILES).select("_study")))
    marked = rows.select("*", study)
    usual, rest = (marked.join(large, "_study", how).drop("_study") for how in ("left_anti", "left_semi"))
    return usual, rest, total


def by_study(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` dealt by study, for ``total`` rows of studies none of which is large: series and studies are
    then aggregated, ordered and joined where they lie."""
    spark = rows.sparkSession
    tasks = -(-total // ROWS_PER_TASK)
    if tasks <= spark.sparkContext.defaultParallelism:
        return rows.repartition(*STUDY)
    return rows.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *STUDY)


def series_with_study(index: dict[str, DataFrame]) -> DataFrame:
    """Every series with its study's attributes."""
    return index["series"].join(index["studies"].drop("series_count"), ["patient_id", "study_uid"])


def series_with_context(index: dict[str, DataFrame]) -> DataFrame:
    """The flat series list: every series with its study's and patient's attributes. Studies meet
    patients first, so that series are dealt once."""
    studies = index["studies"].drop("series_count").join(index["patients"].drop("study_count"), "patient_id")
    return index["series"].join(studies, ["patient_id", "study_uid"])


def filter_modality(series: DataFrame, modality: str) -> DataFrame:
    return series.filter(F.col("modality") == modality)


def exclude_modalities(series: DataFrame, excluded: list[str]) -> DataFrame:
    return series.filter(~F.col("modality").isin(*excluded)) if excluded else series


# --- totals --------------------------------------------------------------------------------------
def scan_info(index: dict[str, DataFrame], classed: DataFrame | None = None) -> DataFrame:
    """One row of totals, all from the rolled-up levels: no file is counted twice or looked at again."""
    series = index["series"].agg(
        F.count("*").cast("bigint").alias("series"),
        F.sum("file_count").cast("bigint").alias("files"),
        F.sum("inferred_count").cast("bigint").alias("inferred"),
        (F.sum("file_count") - F.sum("inferred_count")).cast("bigint").alias("parsed"),
        F.array_join(F.sort_array(F.collect_set("modality")), ", ").alias("modalities"),
    )
    studies = index["studies"].agg(F.count("*").cast("bigint").alias("studies"))
    patients = index["patients"].agg(F.count("*").cast("bigint").alias("patients"))
    tables = [series, studies, patients]
    if classed is not None:
        tables.append(
            classed.agg(
                F.count("*").cast("bigint").alias("scanned"),
                F.count(F.when(F.col("class") == "skip", True)).cast("bigint").alias("skipped"),
            )
        )
    # Each table is a single row; they meet on a constant key.
    keyed = [table.withColumn("_one", F.lit(1)) for table in tables]
    total = keyed[0]
    for table in keyed[1:]:
        total = total.join(F.broadcast(table), "_one")
    return total.drop("_one")


def series_rollup(series: DataFrame) -> DataFrame:
    """File counts and sizes per patient, study and modality with subtotals."""
    return series.rollup("patient_id", "study_uid", "modality").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.sum("file_count").cast("bigint").alias("files"),
        F.sum("total_size").cast("bigint").alias("bytes"),
    )


def modality_counts(series: DataFrame) -> DataFrame:
    return series.groupBy("modality").agg(F.count("*").cast("bigint").alias("series"))


# --- exports -------------------------------------------------------------------------------------
def series_sheet(series_list: DataFrame) -> DataFrame:
    """The twelve display columns of the series list plus one column per optional tag."""
    tags = list(dict.fromkeys(key for keys in fixed.OPTIONAL_TAGS.values() for key in keys))
    return series_list.select(
        F.col("patient_id").alias("Patient ID"),
        F.col("patient_name").alias("Patient Name"),
        format_dicom_date("study_date").alias("Study Date"),
        F.col("study_description").alias("Study Description"),
        F.col("modality").alias("Modality"),
        F.col("series_number").alias("Series #"),
        F.col("series_description").alias("Series Description"),
        F.col("file_count").alias("Files"),
        human_size("total_size").alias("Size"),
        F.col("frame_of_reference_uid").alias("Frame of Ref UID"),
        F.col("manufacturer").alias("Manufacturer"),
        F.col("institution").alias("Institution"),
        *[F.try_element_at("optional_tags", F.lit(tag)).alias(tag) for tag in tags],
    )


def scan_summary(info: DataFrame, source: str, scan_date: str, seconds: float) -> DataFrame:
    """Twelve property/value rows."""
    rows = [
        ("Source", F.lit(source)),
        ("Scan Date", F.lit(scan_date)),
        ("Total Files Scanned", F.col("scanned")),
        ("DICOM Files Parsed", F.col("parsed")),
        ("Files Inferred (sampled)", F.col("inferred")),
        ("Files Skipped", F.col("skipped")),
        ("Patients", F.col("patients")),
        ("Studies", F.col("studies")),
        ("Series", F.col("series")),
        ("Total DICOM Files", F.col("files")),
        ("Modalities", F.col("modalities")),
        ("Duration", F.lit(f"{seconds:.1f} s")),
    ]
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("Property"), value.cast("string").alias("Value"))
            for name, value in rows
        ]
    )
    return info.select(F.inline(pairs))


def files_detail(
    index: dict[str, DataFrame], cap: int | None = None
) -> DataFrame:
    """One row per file for a sheet. The sheet format holds 100 000 rows; a table has no such limit,
    so there is no cap unless one is asked for."""
    context = series_with_study(index).select(
        "patient_id", "study_uid", "series_uid", "study_date", "modality", "series_description"
    )
    rows = (
        index["files"]
        .join(context, ["patient_id", "study_uid", "series_uid"])
        .select(
            F.col("patient_id").alias("Patient ID"),
            format_dicom_date("study_date").alias("Study Date"),
            F.col("modality").alias("Modality"),
            F.col("series_description").alias("Series Description"),
            F.col("instance_number").alias("Instance #"),
            F.col("path").alias("File Path"),
            human_size("size").alias("Size"),
            F.when(F.col("inferred"), "Yes").otherwise("").alias("Inferred"),
        )
    )
    return rows if cap is None else rows.orderBy("Patient ID", "File Path").limit(cap)


def _cut(files: str, size: int) -> Column:
    """An array that is not empty, in arrays of at most ``size``."""
    starts = F.sequence(F.lit(1), F.size(files), F.lit(size))
    return F.transform(starts, lambda start: F.slice(files, start, F.lit(size)))


def file_parts(index: dict[str, DataFrame], files_per_document: int) -> DataFrame:
    """(patient, study, series, part, files): the files of every series by path, so many to a part.

    A series of at most ``GATHERED_FILES`` files is gathered and cut inside its row, which deals its files
    once. Files of larger ones, if there are any, are numbered without gathering them.
    """
    keys = ["patient_id", "study_uid", "series_uid"]
    file = F.struct("path", "size", F.col("instance_number").alias("instanceNumber"), "inferred")
    files = index["files"].select(*keys, file.alias("file"))
    large = index["series"].filter(F.col("file_count") > GATHERED_FILES).select(*keys)
    some_large = not large.isEmpty()
    small = files.join(large, keys, "left_anti") if some_large else files
    whole = small.groupBy(*keys).agg(F.sort_array(F.collect_list("file")).alias("_all"))
    parts = whole.select(*keys, F.posexplode(_cut("_all", files_per_document)).alias("part", "files"))
    if not some_large:
        return parts
    rest = files.join(large, keys, "left_semi").select(*keys, "file", F.col("file.path").alias("_path"))
    numbered = ordinal_within(rest, keys, ["_path"]).withColumn(
        "part", F.floor((F.col("ordinal") - 1) / files_per_document).cast("int")
    )
    gathered = numbered.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return parts.unionByName(gathered)


def index_documents(index: dict[str, DataFrame], files_per_document: int = 5000) -> DataFrame:
    """Nested JSON of the index: one document per series and part of at most ``files_per_document``
    files, carrying its patient and study. Reads ``rows`` of the index.

    A patient or series may own any share of all files, so a document per patient could not be built
    in one task. Parts are numbered; all files of all parts together are all files. Files are dealt once, by
    study, and gathered and cut there; those of large studies, if there are any, meet their series by joins.
    """
    rows, large, total = split_studies(index["rows"])
    file = F.struct("inferred", "path", "size", "instance_number", *OF_SERIES, *OF_STUDY).alias("file")
    dealt = by_study(rows.select(*SERIES, file), total)
    item = F.struct("file.path", "file.size", F.col("file.instance_number").alias("instanceNumber"), "file.inferred")
    gathered = dealt.groupBy(*SERIES).agg(
        F.min("file").alias("first"), F.count("*").cast("bigint").alias("file_count"), F.sum("file.size").cast("bigint").alias("total_size"),
        F.sort_array(F.collect_list(item)).alias("_all"),
    )
    lead = F.struct("first.inferred", "first.path", *[f"first.{name}" for name in OF_STUDY])
    placed = gathered.withColumn("study", F.min(lead).over(Window.partitionBy(*STUDY)))
    cut = placed.select(
        *SERIES, *[f"first.{name}" for name in OF_SERIES if name != "optional_tags"], F.map_from_entries("first.optional_tags").alias("optional_tags"),
        "file_count", "total_size", *[f"study.{name}" for name in OF_STUDY], F.posexplode(_cut("_all", files_per_document)).alias("part", "files"),
    )
    # Patients meet studies, not files.
    lead = F.struct("inferred", "path", *OF_PATIENT)
    patients = index["rows"].groupBy("patient_id").agg(F.min(lead).alias("patient"))
    parts = cut.join(dealt.select(*STUDY).distinct().join(patients, "patient_id"), STUDY)
    if large is not None:
        tables = roll_up(large)
        series = series_with_study(tables).join(patients, "patient_id")
        parts = parts.unionByName(file_parts(tables, files_per_document).join(series, SERIES).select(*parts.columns))
    document = F.struct(
        F.struct(
            F.col("patient_id").alias("patientID"),
            F.col("patient.patient_name").alias("patientName"),
            F.col("patient.birth_date").alias("patientBirthDate"),
            F.col("patient.sex").alias("patientSex"),
        ).alias("patient"),
        F.struct(
            F.col("study_uid").alias("studyInstanceUID"),
            F.col("study_date").alias("studyDate"),
            F.col("study_description").alias("studyDescription"),
            F.col("accession_number").alias("accessionNumber"),
        ).alias("study"),
        F.struct(
            F.col("series_uid").alias("seriesInstanceUID"),
            F.col("series_number").alias("seriesNumber"),
            F.col("modality").alias("modality"),
            F.col("series_description").alias("seriesDescription"),
            F.col("frame_of_reference_uid").alias("frameOfReferenceUID"),
            F.col("manufacturer").alias("manufacturer"),
            F.col("institution").alias("institutionName"),
            F.col("file_count").alias("fileCount"),
            F.col("total_size").alias("totalSize"),
            F.col("optional_tags").alias("optionalTags"),
        ).alias("series"),
        F.col("part").alias("part"),
        F.col("files").alias("files"),
    )
    return parts.select(*SERIES, "part", F.size("files").cast("bigint").alias("files"), F.to_json(document).alias("json"))
