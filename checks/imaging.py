"""Image inventories and indexes over an adapter view of the order tables.

Patient = customer, study = order, series = order and modality, instance = line item. The same CASE
expressions stand in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Check, table
from clinspark import fixed_values as fixed
from clinspark.functions import signals
from clinspark.operators import filing, imaging
from clinspark.session import spread

MODALITIES = ("CT", "MR", "PT", "RTSTRUCT", "RTPLAN", "RTDOSE")


def _lines(spark, folder):
    lines, orders, customers = (table(spark, folder, name) for name in ("lineitem", "orders", "customer"))
    lines = spread(lines)
    # Orders meet customers first, so that line items are dealt once.
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


def headers(spark, folder):
    """(path, size, inferred) of every line item and its tags, one a column."""
    order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    number = supplier % 6
    modality = F.get(F.array(*map(F.lit, MODALITIES)), number.cast("int"))
    text = lambda column: column.cast("string")
    label = F.when(order % 4 == 0, "").otherwise(F.concat(F.lit("Set "), text(order % 3)))
    values = {
        "PatientID": F.when(F.col("c_custkey") % 50 == 0, "").otherwise(F.concat(F.lit("P/"), text(F.col("c_custkey")))),
        "PatientName": F.col("c_name"),
        "StudyInstanceUID": F.concat(F.lit("1.2."), text(order)),
        "StudyDate": F.when(order % 7 == 0, "").when(order % 11 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")),
        "StudyDescription": F.when(order % 5 == 0, "").otherwise(F.col("o_orderpriority")),
        "SeriesInstanceUID": F.concat(F.lit("1.2."), text(order), F.lit("."), text(number)),
        "Modality": F.when(order % 31 == 0, "").otherwise(modality),
        "SeriesNumber": text(number + 1),
        "SeriesDescription": F.when(part % 3 == 0, "").otherwise(F.concat(F.lit("Series: "), text(part % 2))),
        "Manufacturer": F.concat(F.lit("M"), text(supplier % 4)),
        "InstanceNumber": text(F.col("l_linenumber")),
        "SOPInstanceUID": F.concat_ws(".", order, F.col("l_linenumber"), part, supplier),
        "StructureSetLabel": label, "RTPlanLabel": label, "DoseType": label,
        "KVP": text(part % 5), "SliceThickness": text(part % 7),
    }
    name = F.concat(F.lit("IM"), F.col("l_linenumber").cast("string"), F.lit("_"), part.cast("string"))
    return _lines(spark, folder).select(
        F.concat_ws("/", F.concat(F.lit("disk"), text(order % 3)), text(order), text(number), F.concat(name, F.lit("_"), text(supplier), F.lit(".dcm"))).alias("path"),
        F.floor("l_extendedprice").cast("bigint").alias("size"),
        (F.col("l_returnflag") == "R").alias("inferred"),
        *[value.alias(key) for key, value in values.items()],
    )


def index(spark, folder, keep=None):
    return imaging.build_index(headers(spark, folder), keep)


def file_rows(spark, folder, keep=None):
    """As much of an index as plans and documents read."""
    return {"rows": imaging.file_rows(headers(spark, folder), keep)}


FILES_CTE = """img AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN 'UNKNOWN' ELSE 'P/' || c_custkey END AS patient_id, c_name AS patient_name,
  '1.2.' || l_orderkey AS study_uid, '1.2.' || l_orderkey || '.' || (l_suppkey % 6) AS series_uid,
  CASE WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y%m%d') END AS study_date,
  CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS study_description,
  CASE WHEN l_orderkey % 31 = 0 THEN 'UNKNOWN' ELSE (['CT', 'MR', 'PT', 'RTSTRUCT', 'RTPLAN', 'RTDOSE'])[l_suppkey % 6 + 1] END AS modality,
  CAST(l_suppkey % 6 + 1 AS VARCHAR) AS series_number,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'Series: ' || (l_partkey % 2) END AS series_description,
  'M' || (l_suppkey % 4) AS manufacturer, CAST(l_linenumber AS VARCHAR) AS instance_number,
  l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS sop,
  CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'Set ' || (l_orderkey % 3) END AS label,
  CAST(l_partkey % 5 AS VARCHAR) AS kvp, CAST(l_partkey % 7 AS VARCHAR) AS thickness,
  'disk' || (l_orderkey % 3) || '/' || l_orderkey || '/' || (l_suppkey % 6) || '/IM' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.dcm' AS path,
  CAST(floor(l_extendedprice) AS BIGINT) AS size, l_returnflag = 'R' AS inferred
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
placed AS (SELECT *, CASE WHEN inferred THEN '1' ELSE '0' END || path AS place FROM img),
series AS (SELECT patient_id, study_uid, series_uid, min(place) AS place, arg_min(modality, place) AS modality, arg_min(series_number, place) AS series_number,
  arg_min(series_description, place) AS series_description, arg_min(manufacturer, place) AS manufacturer, arg_min(label, place) AS label,
  arg_min(kvp, place) AS kvp, arg_min(thickness, place) AS thickness, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size
  FROM placed GROUP BY ALL),
studies AS (SELECT patient_id, study_uid, arg_min(study_date, place) AS study_date, arg_min(study_description, place) AS study_description,
  count(DISTINCT series_uid) AS series_count FROM placed GROUP BY ALL),
patients AS (SELECT patient_id, arg_min(patient_name, place) AS patient_name, count(DISTINCT study_uid) AS study_count FROM placed GROUP BY ALL)"""


def index_series(spark, folder):
    series = index(spark, folder)["series"]
    tag = lambda key: F.coalesce(F.try_element_at("optional_tags", F.lit(key)), F.lit("-"))
    return series.select(
        "patient_id", "study_uid", "series_uid", "modality", "series_number", "series_description",
        "manufacturer", "file_count", "total_size",
        F.concat_ws("|", tag("StructureSetLabel"), tag("RTPlanLabel"), tag("DoseType"), tag("KVP"), tag("SliceThickness")).alias("optional"),
    )


_OPTIONAL = """CASE WHEN modality = 'RTSTRUCT' THEN label ELSE '-' END || '|' || CASE WHEN modality = 'RTPLAN' THEN label ELSE '-' END || '|' ||
  CASE WHEN modality = 'RTDOSE' THEN label ELSE '-' END || '|' || CASE WHEN modality = 'CT' THEN kvp ELSE '-' END || '|' ||
  CASE WHEN modality IN ('CT', 'MR', 'PT') THEN thickness ELSE '-' END"""
INDEX_SERIES_SQL = f"""
WITH {FILES_CTE} SELECT patient_id, study_uid, series_uid, modality, series_number, series_description, manufacturer, file_count, total_size,
  {_OPTIONAL} AS optional FROM series"""


def index_studies(spark, folder):
    return index(spark, folder)["studies"].drop("accession_number")


def index_patients(spark, folder):
    return index(spark, folder)["patients"].select("patient_id", "patient_name", "study_count")


def scan_info(spark, folder):
    return imaging.scan_info(index(spark, folder, imaging.KEPT_BY_TOTALS))


SCAN_SQL = f"""
WITH {FILES_CTE} SELECT (SELECT count(*) FROM series) AS series, (SELECT count(*) FROM img) AS files,
  (SELECT string_agg(modality, ', ' ORDER BY modality) FROM (SELECT DISTINCT modality FROM series)) AS modalities,
  (SELECT count(*) FROM studies) AS studies, (SELECT count(*) FROM patients) AS patients,
  (SELECT count(*) FROM img WHERE inferred) AS inferred, (SELECT count(*) FROM img WHERE NOT inferred) AS parsed"""


def scan_summary(spark, folder):
    classed = imaging.classify_files(inventory(spark, folder), smart=True)
    info = imaging.scan_info(index(spark, folder, imaging.KEPT_BY_TOTALS), classed)
    return imaging.scan_summary(info, "archive", "2024-01-01T00:00:00.000Z", 1.25)


def _summary_sql() -> str:
    rows = [
        ("Source", "'archive'"), ("Scan Date", "'2024-01-01T00:00:00.000Z'"),
        ("Total Files Scanned", "(SELECT count(*) FROM lineitem)"),
        ("DICOM Files Parsed", "(SELECT count(*) FROM img WHERE NOT inferred)"),
        ("Files Inferred (sampled)", "(SELECT count(*) FROM img WHERE inferred)"),
        ("Files Skipped", "(SELECT count(*) FROM inv WHERE NOT image)"),
        ("Patients", "(SELECT count(*) FROM patients)"), ("Studies", "(SELECT count(*) FROM studies)"),
        ("Series", "(SELECT count(*) FROM series)"), ("Total DICOM Files", "(SELECT count(*) FROM img)"),
        ("Modalities", "(SELECT string_agg(modality, ', ' ORDER BY modality) FROM (SELECT DISTINCT modality FROM series))"),
        ("Duration", "'1.2 s'"),
    ]
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS \"Property\", CAST({value} AS VARCHAR) AS \"Value\"" for name, value in rows
    )
    return f"WITH {FILES_CTE}, {INVENTORY_CTE} {parts}"


def series_rollup(spark, folder):
    return imaging.series_rollup(index(spark, folder, imaging.KEPT_BY_TOTALS)["series"])


ROLLUP_SQL = f"""
WITH {FILES_CTE} SELECT patient_id, study_uid, modality, CAST(grouping_id(patient_id, study_uid, modality) AS BIGINT) AS level,
  CAST(sum(file_count) AS BIGINT) AS files, CAST(sum(total_size) AS BIGINT) AS bytes FROM series GROUP BY ROLLUP (patient_id, study_uid, modality)"""


def modality_counts(spark, folder):
    return imaging.modality_counts(index(spark, folder, imaging.KEPT_BY_TOTALS)["series"])


def modality_filters(spark, folder):
    series = index(spark, folder, imaging.KEPT_BY_TOTALS)["series"].select("series_uid", "modality")
    only = imaging.filter_modality(series, "CT").withColumn("view", F.lit("only CT"))
    rest = imaging.exclude_modalities(series, ["CT", "RTDOSE"]).withColumn("view", F.lit("without CT, RTDOSE"))
    return only.unionByName(rest)


FILTER_SQL = f"""
WITH {FILES_CTE} SELECT series_uid, modality, 'only CT' AS view FROM series WHERE modality = 'CT'
UNION ALL SELECT series_uid, modality, 'without CT, RTDOSE' FROM series WHERE modality NOT IN ('CT', 'RTDOSE')"""


def series_sheet(spark, folder):
    sheet = imaging.series_sheet(imaging.series_with_context(index(spark, folder, imaging.KEPT_BY_SHEET)))
    return sheet.select(
        "Patient ID", "Patient Name", "Study Date", "Study Description", "Modality", "Series #",
        "Series Description", "Files", "Size", "Frame of Ref UID", "Manufacturer", "Institution", "KVP", "RTPlanLabel",
    )


_DATE = "CASE WHEN length(study_date) >= 8 THEN substr(study_date, 1, 4) || '-' || substr(study_date, 5, 2) || '-' || substr(study_date, 7, 2) ELSE study_date END"
_SIZE = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.1f KB', floor({0} / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor({0} / 1048576.0::DOUBLE * 10 + 0.5) / 10) END"
SHEET_SQL = f"""
WITH {FILES_CTE} SELECT patient_id AS "Patient ID", patient_name AS "Patient Name", {_DATE} AS "Study Date", study_description AS "Study Description",
  modality AS "Modality", series_number AS "Series #", series_description AS "Series Description", file_count AS "Files",
  {_SIZE.format('total_size')} AS "Size", '' AS "Frame of Ref UID", manufacturer AS "Manufacturer", '' AS "Institution",
  CASE WHEN modality = 'CT' THEN kvp END AS "KVP", CASE WHEN modality = 'RTPLAN' THEN label END AS "RTPlanLabel"
FROM series JOIN studies USING (patient_id, study_uid) JOIN patients USING (patient_id)"""


def files_detail(spark, folder):
    return imaging.files_detail(index(spark, folder, imaging.KEPT_BY_DETAIL))


DETAIL_SQL = f"""
WITH {FILES_CTE} SELECT patient_id AS "Patient ID", {_DATE.replace('study_date', 'st.study_date')} AS "Study Date", s.modality AS "Modality",
  s.series_description AS "Series Description", i.instance_number AS "Instance #", path AS "File Path", {_SIZE.format('size')} AS "Size",
  CASE WHEN inferred THEN 'Yes' ELSE '' END AS "Inferred"
FROM img i JOIN series s USING (patient_id, study_uid, series_uid) JOIN studies st USING (patient_id, study_uid)"""


def index_documents(spark, folder):
    """The nested documents, flattened again: every file once, with its series."""
    documents = imaging.index_documents(file_rows(spark, folder, imaging.KEPT_BY_DOCUMENTS), files_per_document=2)
    schema = (
        "patient struct<patientID:string,patientName:string>, study struct<studyInstanceUID:string>, "
        "series struct<seriesInstanceUID:string,fileCount:long>, part int, files array<struct<path:string,size:long,instanceNumber:string,inferred:boolean>>"
    )
    read = documents.select(F.from_json("json", schema).alias("d"))
    return read.select("d.patient.patientID", "d.study.studyInstanceUID", "d.series.fileCount", "d.part", F.explode("d.files").alias("f")).select(
        F.col("patientID").alias("patient_id"), F.col("studyInstanceUID").alias("study_uid"), F.col("fileCount").alias("file_count"), "part", "f.path", "f.size", "f.inferred"
    )


DOCUMENTS_SQL = f"""
WITH {FILES_CTE} SELECT patient_id, study_uid, count(*) OVER (PARTITION BY patient_id, study_uid, series_uid) AS file_count,
  CAST((row_number() OVER (PARTITION BY patient_id, study_uid, series_uid ORDER BY path) - 1) // 2 AS INTEGER) AS part, path, size, inferred FROM img"""


# --- inventories ---------------------------------------------------------------------------------
def inventory(spark, folder):
    """One file per line item, one directory per customer; names and sizes of many kinds."""
    part, line = F.col("l_partkey"), F.col("l_linenumber").cast("string")
    customer = F.col("o_custkey")
    stem = F.concat_ws("_", F.col("l_orderkey"), F.col("l_linenumber"), part, F.col("l_suppkey"))
    name = (
        F.when(customer % 3 == 0, F.concat(F.lit("CT"), stem, F.lit(".dcm")))
        .when(part % 9 == 0, F.concat(F.lit("notes"), stem, F.lit(".txt")))
        .when(part % 9 == 1, F.concat(F.lit("MR"), stem))
        .when(part % 9 == 2, F.concat(F.lit("Rtplan"), stem, F.lit(".dcm")))
        .when(part % 9 == 3, F.concat(F.lit("scan"), stem))
        .when(part % 9 == 4, F.concat(stem, F.lit(".bin")))
        .when(part % 9 == 5, F.concat(F.lit("pet"), stem, F.lit(".dat")))
        .when(part % 9 == 6, F.concat(F.lit("rd"), stem, F.lit(".JPG")))
        .otherwise(F.concat(F.lit("ct_"), stem, F.lit(".dic")))
    )
    factor = F.when(customer % 2 == 0, 5.0).otherwise(0.2)
    size = F.when(customer % 9 == 0, 150000 + part % 100).otherwise(F.floor(F.col("l_extendedprice") * factor))
    lines = spread(table(spark, folder, "lineitem")).join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    folder_name = F.concat(F.lit("c"), customer.cast("string"))
    return lines.select(
        F.concat_ws("/", folder_name, name).alias("path"), folder_name.alias("dir"), name.alias("name"), size.cast("bigint").alias("size")
    )


_ORDERED = " ".join(
    [
        "CASE WHEN regexp_matches(l, '\\.(" + "|".join(fixed.IMAGE_EXTENSIONS) + ")$') THEN true",
        "WHEN NOT contains(l, '.') AND size > 1024 THEN true",
        "WHEN regexp_matches(l, '^(" + "|".join(fixed.IMAGE_NAME_PREFIXES) + ")\\d*') THEN true",
        "WHEN regexp_matches(split_part(l, '.', 1), '^\\d+$') AND size > 1024 THEN true",
        "WHEN regexp_matches(l, '\\.(" + "|".join(fixed.OTHER_EXTENSIONS) + ")$') THEN false ELSE size > 1024 END",
    ]
)
_GUESS = "CASE " + " ".join(
    f"WHEN regexp_matches(l, '^({'|'.join(prefixes)})') THEN '{modality}'" for modality, prefixes in fixed.MODALITY_PREFIXES
) + " END"
INVENTORY_CTE = f"""inv0 AS (SELECT 'c' || o_custkey AS dir, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS stem, l_partkey % 9 AS kind, o_custkey AS c,
  CASE WHEN o_custkey % 9 = 0 THEN 150000 + l_partkey % 100 ELSE CAST(floor(l_extendedprice * CASE WHEN o_custkey % 2 = 0 THEN 5.0::DOUBLE ELSE 0.2::DOUBLE END) AS BIGINT) END AS size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
inv1 AS (SELECT dir, size, CASE WHEN c % 3 = 0 THEN 'CT' || stem || '.dcm' WHEN kind = 0 THEN 'notes' || stem || '.txt' WHEN kind = 1 THEN 'MR' || stem
  WHEN kind = 2 THEN 'Rtplan' || stem || '.dcm' WHEN kind = 3 THEN 'scan' || stem WHEN kind = 4 THEN stem || '.bin' WHEN kind = 5 THEN 'pet' || stem || '.dat'
  WHEN kind = 6 THEN 'rd' || stem || '.JPG' ELSE 'ct_' || stem || '.dic' END AS name FROM inv0),
inv AS (SELECT dir, name, dir || '/' || name AS path, size, {_ORDERED} AS image, {_GUESS} AS guess FROM (SELECT *, lower(name) AS l FROM inv1)),
med AS (SELECT dir, count(*) AS n, quantile_cont(size, 0.5) AS m FROM inv WHERE image GROUP BY dir),
prof AS (SELECT i.dir, n, m, count(*) FILTER (abs(size - m) < m * 0.3) AS near_n, count(*) FILTER (guess = 'CT') AS ct, count(*) FILTER (guess = 'MR') AS mr,
  count(*) FILTER (guess = 'PT') AS pt FROM inv i JOIN med USING (dir) WHERE image GROUP BY ALL)"""


def looks_like_image(spark, folder):
    return inventory(spark, folder).select(
        "path", signals.looks_like_image("name", "size").alias("image"), signals.guess_modality("name").alias("guess")
    )


def directory_profile(spark, folder):
    return imaging.directory_profile(inventory(spark, folder))


PROFILE_SQL = f"""
WITH {INVENTORY_CTE} SELECT dir, n AS candidates, CAST(m AS DOUBLE) AS median, near_n AS "similar", ct AS guessed_ct, mr AS guessed_mr, pt AS guessed_pt FROM prof"""


def classify_files(spark, folder):
    return imaging.classify_files(inventory(spark, folder), smart=True).select("path", "class", "series_group")


CLASS_CTE = f"""{INVENTORY_CTE},
grp AS (SELECT i.*, CASE WHEN NOT image THEN NULL WHEN n >= 10 AND near_n >= 10 AND m BETWEEN 102400 AND 2097152 THEN CASE WHEN abs(size - m) < m * 0.3 THEN 'size' END
  WHEN guess = 'CT' AND ct >= 10 THEN 'CT' WHEN guess = 'MR' AND mr >= 10 THEN 'MR' WHEN guess = 'PT' AND pt >= 10 THEN 'PT' END AS by_
  FROM inv i LEFT JOIN prof USING (dir)),
num AS (SELECT *, row_number() OVER (PARTITION BY dir, by_ ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY dir, by_) AS total FROM grp),
classed AS (SELECT path, size, CASE WHEN NOT image THEN 'skip' WHEN by_ IS NULL THEN 'parse'
  WHEN i IN (floor(total / 4.0), floor(total / 4.0 * 2), floor(total / 4.0 * 3)) THEN 'sample' ELSE 'rest' END AS class,
  CASE WHEN by_ IS NOT NULL THEN dir || '|' || by_ END AS series_group FROM num)"""


def classify_plain(spark, folder):
    return imaging.classify_files(inventory(spark, folder), smart=False).select("path", "class")


def _sample_headers(classed):
    """Headers of the sampled files; in every third group only the last sample has a modality."""
    samples = classed.filter("class = 'sample'")
    has = (F.length("series_group") % 3 != 0) | (F.length("path") % 2 == 0)
    tags = F.create_map(
        F.lit("Modality"), F.when(has, "CT").otherwise(""), F.lit("InstanceNumber"), F.lit("7"),
        F.lit("SOPInstanceUID"), F.col("path"), F.lit("SeriesDescription"), F.col("path"),
    )
    return samples.select("series_group", "path", tags.alias("tags"))


def infer_from_sample(spark, folder):
    classed = imaging.classify_files(inventory(spark, folder), smart=True)
    inferred, uninferred = imaging.infer_from_sample(
        classed.filter("class = 'rest'").select("path", "size", "series_group"), _sample_headers(classed)
    )
    found = inferred.select(
        "path", "size", F.col("tags")["SOPInstanceUID"].alias("sop"), F.col("tags")["SeriesDescription"].alias("model"),
        F.concat(F.col("tags")["Modality"], F.lit("/"), F.col("tags")["InstanceNumber"]).alias("rest"),
    )
    lost = uninferred.select("path", "size", *[F.lit(None).cast("string").alias(name) for name in ("sop", "model", "rest")])
    return found.unionByName(lost)


INFER_SQL = f"""
WITH {CLASS_CTE}, model AS (SELECT series_group, min(path) AS model FROM classed WHERE class = 'sample'
  AND (length(series_group) % 3 <> 0 OR length(path) % 2 = 0) GROUP BY series_group)
SELECT path, size, CASE WHEN model IS NOT NULL THEN 'inferred-' || path END AS sop, model, CASE WHEN model IS NOT NULL THEN 'CT/' END AS rest
FROM classed LEFT JOIN model USING (series_group) WHERE class = 'rest'"""


def limit_index(spark, folder):
    """Test mode keeps the first 500 files: parsed ones, then samples, then the rest."""
    return imaging.limit_index(imaging.classify_files(inventory(spark, folder), smart=True), 500).select("path", "class")


LIMIT_SQL = f"""
WITH {CLASS_CTE} SELECT path, class FROM classed WHERE class <> 'skip'
ORDER BY CASE class WHEN 'parse' THEN 0 WHEN 'sample' THEN 1 ELSE 2 END, series_group NULLS FIRST, path LIMIT 500"""


# --- plans ---------------------------------------------------------------------------------------
def _san(value: str) -> str:
    return f"trim(regexp_replace(regexp_replace({value}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '_+', '_', 'g'))"


PLAN_CTE = f"""{FILES_CTE},
lab AS (SELECT s.*, {_san('''coalesce(nullif(CASE WHEN s.modality IN ('RTSTRUCT', 'RTPLAN', 'RTDOSE') THEN label END, ''), nullif(series_description, ''), 'S' || series_number)''')} AS lbl,
  {_san('patient_id')} || '/' || coalesce(nullif({_DATE}, ''), 'NoDate') || '_' || {_san("coalesce(nullif(study_description, ''), 'NoDescription')")} AS base
  FROM series s JOIN studies USING (patient_id, study_uid))"""
PRIMARY_CTE = f"""{PLAN_CTE},
kept AS (SELECT * FROM lab WHERE KEEP),
prim AS (SELECT patient_id, study_uid, base || '/' || modality || '_' || lbl AS pdir, series_uid AS primary_uid FROM kept WHERE modality IN ('CT', 'MR', 'PT')
  QUALIFY row_number() OVER (PARTITION BY patient_id, study_uid ORDER BY file_count DESC, place) = 1),
pos AS (SELECT k.*, pdir FROM kept k LEFT JOIN prim USING (patient_id, study_uid)),
rs AS (SELECT *, pdir || '/RTSTRUCT_' || lbl AS folder FROM pos WHERE modality = 'RTSTRUCT' AND pdir IS NOT NULL),
folders AS (SELECT patient_id, study_uid, series_uid, base || '/' || modality || '_' || lbl AS folder FROM pos
    WHERE pdir IS NULL OR modality NOT IN ('RTSTRUCT', 'RTPLAN', 'RTDOSE')
  UNION ALL SELECT patient_id, study_uid, series_uid, folder FROM rs
  UNION ALL SELECT patient_id, study_uid, series_uid, pdir || '/RTDOSE_' || lbl FROM pos WHERE modality = 'RTDOSE' AND pdir IS NOT NULL
  UNION ALL SELECT p.patient_id, p.study_uid, p.series_uid, rs.folder || '/RTPLAN_' || p.lbl FROM pos p JOIN rs USING (patient_id, study_uid) WHERE p.modality = 'RTPLAN'
  UNION ALL SELECT patient_id, study_uid, series_uid, pdir || '/RTPLAN_' || lbl FROM pos p WHERE modality = 'RTPLAN' AND pdir IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM rs WHERE rs.patient_id = p.patient_id AND rs.study_uid = p.study_uid)),
plan AS (SELECT i.patient_id, i.study_uid, i.series_uid, i.path AS src, folder || '/' || regexp_extract(i.path, '[^/]*$') AS dst
  FROM img i JOIN folders USING (patient_id, study_uid, series_uid))"""
NESTED_CTE = PRIMARY_CTE.replace("KEEP", "true")
SELECT_PLAN = "SELECT patient_id, study_uid, series_uid, src, dst FROM plan"


def plan_nested(spark, folder):
    return filing.sort_plan(file_rows(spark, folder, imaging.KEPT_BY_PLANS), "nested")


def plan_flat(spark, folder):
    return filing.sort_plan(file_rows(spark, folder, imaging.KEPT_BY_PLANS), "flat", excluded=["PT"])


def plan_modality(spark, folder):
    return filing.sort_plan(file_rows(spark, folder, imaging.KEPT_BY_PLANS), "modality")


def plan_required(spark, folder):
    """Only patients with a CT and a plan; doses are left out after that test."""
    return filing.sort_plan(file_rows(spark, folder, imaging.KEPT_BY_PLANS), "nested", ["RTDOSE", "MR"], ["CT", "RTPLAN", "RTDOSE"])


def _simple_plan_sql(folder: str, keep: str) -> str:
    return f"""
WITH {PLAN_CTE} SELECT i.patient_id, i.study_uid, i.series_uid, i.path AS src, {folder} || '/' || regexp_extract(i.path, '[^/]*$') AS dst
FROM img i JOIN lab USING (patient_id, study_uid, series_uid) WHERE {keep}"""


_COMPLETE = "SELECT patient_id FROM series WHERE modality IN ('CT', 'RTPLAN', 'RTDOSE') GROUP BY patient_id HAVING count(DISTINCT modality) = 3"


def complete_patients(spark, folder):
    return filing.complete_patients(index(spark, folder, imaging.KEPT_BY_TOTALS)["series"], ["CT", "RTPLAN", "RTDOSE"])


def primary_series(spark, folder):
    series = index(spark, folder, imaging.KEPT_BY_PLANS)["series"].withColumn("label", F.col("series_description"))
    return filing.primary_series(series).select("patient_id", "study_uid", F.col("primary.series_uid").alias("primary_uid"))


def plan_collisions(spark, folder):
    return filing.plan_collisions(_stem_plan(spark, folder))


def _stem_plan(spark, folder):
    """The nested plan with files renamed to their instance number, so that names repeat."""
    plan = plan_nested(spark, folder)
    return plan.withColumn("dst", F.regexp_replace("dst", "_[0-9]+_[0-9]+\\.dcm$", ""))


COLLISION_SQL = f"""
WITH {NESTED_CTE} SELECT regexp_replace(dst, '_[0-9]+_[0-9]+\\.dcm$', '') AS dst, count(*) AS sources FROM plan GROUP BY 1 HAVING count(*) > 1"""


def plan_tree(spark, folder):
    return filing.folder_tree(filing.folder_counts(filing.file_folders(file_rows(spark, folder, imaging.KEPT_BY_PLANS), "nested")))


TREE_SQL = f"""
WITH {NESTED_CTE}, p AS (SELECT string_split(dst, '/') AS parts FROM plan)
SELECT array_to_string(parts[1:d], '/') AS folder, count(*) AS files FROM p, unnest(range(1, len(parts))) AS r(d) GROUP BY 1"""


def copy_batches(spark, folder):
    """Batches of 50 names per source and destination; line items share one folder per customer."""
    plan = inventory(spark, folder).select(
        F.col("path").alias("src"), F.concat(F.lit("sorted/"), F.substring("name", 1, 2), F.lit("/"), "name").alias("dst")
    )
    batches = filing.copy_batches(plan, 10)
    return batches.select("src_dir", "dst_dir", "batch_no", F.array_join("names", ",").alias("names"))


BATCH_SQL = f"""
WITH {INVENTORY_CTE}, n AS (SELECT dir AS src_dir, 'sorted/' || substr(name, 1, 2) AS dst_dir, name,
  (row_number() OVER (PARTITION BY dir, substr(name, 1, 2) ORDER BY name) - 1) // 10 AS batch_no FROM inv)
SELECT src_dir, dst_dir, batch_no, string_agg(name, ',' ORDER BY name) AS names FROM n GROUP BY ALL"""

CHECKS = {
    "looks_like_image": Check(looks_like_image, f"WITH {INVENTORY_CTE} SELECT path, image, guess FROM inv"),
    "directory_profile": Check(directory_profile, PROFILE_SQL),
    "classify_files": Check(classify_files, f"WITH {CLASS_CTE} SELECT path, class, series_group FROM classed"),
    "classify_files_plain": Check(classify_plain, f"WITH {INVENTORY_CTE} SELECT path, CASE WHEN image THEN 'parse' ELSE 'skip' END AS class FROM inv"),
    "infer_from_sample": Check(infer_from_sample, INFER_SQL),
    "limit_index": Check(limit_index, LIMIT_SQL),
    "index_series": Check(index_series, INDEX_SERIES_SQL),
    "index_studies": Check(index_studies, f"WITH {FILES_CTE} SELECT * FROM studies"),
    "index_patients": Check(index_patients, f"WITH {FILES_CTE} SELECT * FROM patients"),
    "scan_info": Check(scan_info, SCAN_SQL),
    "scan_summary": Check(scan_summary, _summary_sql()),
    "series_rollup": Check(series_rollup, ROLLUP_SQL),
    "modality_counts": Check(modality_counts, f"WITH {FILES_CTE} SELECT modality, count(*) AS series FROM series GROUP BY modality"),
    "modality_filters": Check(modality_filters, FILTER_SQL),
    "series_sheet": Check(series_sheet, SHEET_SQL),
    "files_detail": Check(files_detail, DETAIL_SQL),
    "index_documents": Check(index_documents, DOCUMENTS_SQL),
    "complete_patients": Check(complete_patients, f"WITH {FILES_CTE} {_COMPLETE}"),
    "primary_series": Check(primary_series, f"WITH {NESTED_CTE} SELECT patient_id, study_uid, primary_uid FROM prim"),
    "sort_plan_nested": Check(plan_nested, f"WITH {NESTED_CTE} {SELECT_PLAN}"),
    "sort_plan_flat": Check(plan_flat, _simple_plan_sql("base || '/' || modality || '_' || lbl", "lab.modality <> 'PT'").replace("base || '/' || modality", "base || '/' || lab.modality")),
    "sort_plan_modality": Check(plan_modality, _simple_plan_sql("base || '/' || lab.modality || '/' || lbl", "true")),
    "sort_plan_required": Check(plan_required, f"WITH {PRIMARY_CTE.replace('KEEP', f'''modality NOT IN ('RTDOSE', 'MR') AND patient_id IN ({_COMPLETE})''')} {SELECT_PLAN}"),
    "plan_collisions": Check(plan_collisions, COLLISION_SQL),
    "plan_tree": Check(plan_tree, TREE_SQL),
    "copy_batches": Check(copy_batches, BATCH_SQL),
}
