"""Files: inventories, image headers, copies, documents, sheets, tables, audio."""

import io
import os
import struct
import wave
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinspark.plans.imaging import index_dicom
from clinspark.operators.filing import copy_summary, sort_plan
from clinspark.sinks.files import execute_copy, output_name, write_book, write_texts
from clinspark.sources import dicom
from clinspark.sources.audio import read_audio_frames
from clinspark.sources.documents import extract_html_tables, read_documents, read_sheets
from clinspark.sources.files import accept_files, list_files

LONG = {"OB", "OW", "SQ", "UN", "UT"}


def element(tag, vr, value, explicit=True, undefined=False):
    data = value if isinstance(value, bytes) else value.encode("latin-1")
    data += b"\0" * (len(data) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    size = 0xFFFFFFFF if undefined else len(data)
    if not explicit:
        return head + struct.pack("<I", size) + data
    if vr in LONG:
        return head + vr.encode() + b"\0\0" + struct.pack("<I", size) + data
    return head + vr.encode() + struct.pack("<H", size) + data


def header(values, syntax="1.2.840.10008.1.2.1", extra=b"", pixels=b"\0" * 64, magic=b"DICM"):
    explicit = syntax != "1.2.840.10008.1.2"
    body = b"".join(
        element(dicom.ALL_TAGS[name], "LO", value, explicit)
        for name, value in sorted(values.items(), key=lambda item: dicom.ALL_TAGS[item[0]])
    )
    meta = element(0x00020010, "UI", syntax)
    return b"\0" * 128 + magic + meta + extra + body + element(0x7FE00010, "OW", pixels, explicit)


BASE = {"Modality": "CT", "PatientID": "P1", "StudyInstanceUID": "1.2", "SeriesInstanceUID": "1.2.3",
        "SeriesNumber": "4", "StudyDate": "20240102", "StudyDescription": "Thorax/Abd", "SeriesDescription": "Axial", "InstanceNumber": "1"}


def test_explicit_and_implicit_headers():
    for syntax in ("1.2.840.10008.1.2.1", "1.2.840.10008.1.2"):
        tags = dicom.parse_header(header(BASE | {"PatientName": "Zoë^A "}, syntax), dicom.ALL_TAGS)
        assert tags == BASE | {"PatientName": "Zoë^A", "TransferSyntaxUID": syntax}


def test_damaged_headers():
    assert dicom.parse_header(b"x" * 100, dicom.ALL_TAGS) is None
    assert dicom.parse_header(header(BASE, magic=b"NOPE"), dicom.ALL_TAGS) is None
    full = header(BASE)
    cut = dicom.parse_header(full[: full.index(b"Axial") + 2], dicom.ALL_TAGS)
    assert "SeriesDescription" not in cut and cut["StudyDate"] == "20240102"
    assert dicom.parse_header(header(BASE), {"PatientSex": 0x00100040}) is None


def test_sequences_of_undefined_length_are_skipped():
    inner = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(0x00100020, "LO", "WRONG")
    inner += struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE000, 8) + b"12345678"
    inner += struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    sequence = element(0x00081140, "SQ", inner, undefined=True)
    tags = dicom.parse_header(header(BASE, extra=sequence), dicom.ALL_TAGS)
    assert tags["PatientID"] == "P1" and tags["Modality"] == "CT"


class Counting:
    """A file that counts what is read of it; ``holes`` (place -> bytes) lie in zeros."""

    def __init__(self, size, holes):
        self.length, self.holes, self.at, self.total = size, sorted(holes.items()), 0, 0

    def seek(self, at):
        self.at = at

    def read(self, count):
        count = min(count, self.length - self.at)
        out = bytearray(count)
        for place, data in self.holes:
            low, high = max(place, self.at), min(place + len(data), self.at + count)
            if low < high:
                out[low - self.at : high - self.at] = data[low - place : high - place]
        self.at += count
        self.total += count
        return bytes(out)


LATE = {name: BASE[name] for name in ("SeriesNumber", "SeriesDescription", "InstanceNumber", "StudyDate") if name in BASE}


@pytest.mark.parametrize("syntax", ["1.2.840.10008.1.2.1", "1.2.840.10008.1.2"])
def test_late_tags_of_large_files_are_found_by_seeking(syntax):
    explicit = syntax != "1.2.840.10008.1.2"
    early = b"\0" * 128 + b"DICM" + element(0x00020010, "UI", syntax) + element(0x00080060, "LO", "CT", explicit)
    gap = 60 << 20
    private = struct.pack("<HH", 0x0009, 0x1010) + (b"OB\0\0" if explicit else b"") + struct.pack("<I", gap)
    late = b"".join(element(dicom.ALL_TAGS[name], "LO", LATE[name], explicit) for name in sorted(LATE, key=dicom.ALL_TAGS.get))
    tail = late + element(0x7FE00010, "OW", b"\0" * 64, explicit)
    start = len(early) + len(private)
    opened = Counting(start + gap + len(tail), {0: early + private, start + gap: tail})
    tags = dicom.read_header(opened, opened.length, dicom.ALL_TAGS)
    assert tags == LATE | {"Modality": "CT", "TransferSyntaxUID": syntax}
    assert opened.total < 1 << 20


def nested(depth, filler, explicit=True):
    """A sequence of undefined length in whose items lie sequences of undefined length and large values."""
    inner = nested(depth - 1, filler, explicit) if depth else element(0x00100020, "LO", "WRONG", explicit)
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(0x00091001, "OB", b"\0" * filler, explicit) + inner
    item += element(0x00100020, "LO", "WRONG", explicit) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    item += struct.pack("<HHI", 0xFFFE, 0xE000, filler) + b"\xff" * filler
    return element(0x00081140, "SQ", item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0), explicit, undefined=True)


@pytest.mark.parametrize("syntax", ["1.2.840.10008.1.2.1", "1.2.840.10008.1.2"])
def test_nested_sequences_of_ten_megabytes_are_jumped_over(syntax):
    explicit = syntax != "1.2.840.10008.1.2"
    meta = element(0x00020010, "UI", syntax)
    body = header(BASE, syntax)[132 + len(meta) :]
    data = b"\0" * 128 + b"DICM" + meta + nested(4, 1 << 20, explicit) + body
    assert len(data) > 10 << 20
    opened = Counting(len(data), {0: data})
    assert dicom.read_header(opened, len(data), dicom.ALL_TAGS) == BASE | {"TransferSyntaxUID": syntax}
    assert opened.total < 1 << 20


def test_pixels_are_never_read():
    head = header(BASE, pixels=b"")[:-8]
    data = head + struct.pack("<I", 500 << 20)
    opened = Counting(len(data) + (500 << 20), {0: data})
    assert dicom.read_header(opened, opened.length, dicom.ALL_TAGS)["SeriesNumber"] == "4"
    assert opened.total <= 64 << 10


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 300))
def test_any_bytes_end_the_walk(noise, cut):
    data = header(BASE)
    for damaged in (data[:cut] + noise, data[: 132 + cut] + noise + data[132 + cut :], data[:132] + noise):
        found = dicom.parse_header(damaged, dicom.ALL_TAGS)
        assert found is None or set(found) <= set(dicom.ALL_TAGS)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """A series of 12 slices, an RT plan, a text file, a broken file and a big-endian file."""
    root = tmp_path_factory.mktemp("archive")
    (root / "a").mkdir()
    for i in range(12):
        slice_ = header(BASE | {"InstanceNumber": str(i), "KVP": "120"}, pixels=b"\0" * (150_000 + 10 * i))
        (root / "a" / f"CT{i:02d}.dcm").write_bytes(slice_)
    plan = BASE | {"Modality": "RTPLAN", "SeriesInstanceUID": "1.2.4", "RTPlanLabel": "Plan:A", "SeriesDescription": ""}
    (root / "b").mkdir()
    (root / "b" / "rp1.dcm").write_bytes(header(plan))
    (root / "b" / "readme.txt").write_text("x" * 5000)
    (root / "b" / "broken.dcm").write_bytes(b"no header at all" * 20)
    (root / "b" / "big.dcm").write_bytes(header(BASE, "1.2.840.10008.1.2.2"))
    return root


def test_inventory(spark, archive):
    listed = list_files(spark, str(archive))
    rows = {r["path"]: r for r in listed.collect()}
    assert len(rows) == 16 and rows["b/readme.txt"]["dir"] == "b" and rows["b/readme.txt"]["size"] == 5000
    assert list_files(spark, str(archive), 3).count() == 3
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(archive / "none"))


def by_spark(spark, root):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    return {(r["path"], r["length"], r["modificationTime"]) for r in found.select("path", "length", "modificationTime").collect()}


def test_listing_of_ten_thousand_files(spark, tmp_path_factory, monkeypatch):
    """The same rows as the binary source's, found by tasks; the driver collects no file."""
    root = tmp_path_factory.mktemp("tree")
    for n in range(10_000):
        folder = root / f"p {n % 37}" / f"s{n % 11}" if n % 5 else root / "flat%20é"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f {n} é%.dcm").write_bytes(b"x" * (n % 7))
    (root / "empty").mkdir()
    (root / "p 1" / "again").symlink_to(root)
    want = {(r["path"], r["size"], r["mtime"]) for r in list_files(spark, str(root)).select(F.col("uri").alias("path"), "size", "mtime").collect()}
    (root / "p 1" / "again").unlink()
    # The binary source leaves empty files out.
    assert len(want) == 10_000 and {row for row in want if row[1]} == by_spark(spark, root)
    collected = []
    from pyspark.sql.classic.dataframe import DataFrame

    real = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(out := real(self)) or out)
    list_files(spark, "file://" + str(root).replace(" ", "%20"))
    assert sum(map(len, collected)) <= 5


def test_index_of_a_folder(spark, archive):
    result = index_dicom(spark, str(archive), smart=True, partitions=2)
    classes = {r["class"]: r["n"] for r in result.classed.groupBy("class").agg(F.count("*").alias("n")).collect()}
    assert classes == {"sample": 3, "rest": 9, "parse": 3, "skip": 1}
    errors = {r["path"]: r["parse_error"] for r in result.headers.filter("parse_error IS NOT NULL").collect()}
    assert errors == {"b/broken.dcm": "no_header", "b/big.dcm": "transfer_syntax"}
    series = {r["modality"]: r for r in result.tables["series"].collect()}
    assert series["CT"]["file_count"] == 12 and series["CT"]["optional_tags"]["KVP"] == "120"
    assert series["RTPLAN"]["optional_tags"] == {"RTPlanLabel": "Plan:A"}
    files = {r["path"]: r for r in result.tables["files"].collect()}
    assert files["a/CT03.dcm"]["inferred"] is False and files["a/CT04.dcm"]["inferred"] is True
    assert files["a/CT04.dcm"]["sop_instance_uid"] == "inferred-a/CT04.dcm"
    assert result.uninferred.count() == 0
    everything = index_dicom(spark, str(archive), smart=False)
    assert everything.tables["files"].filter("inferred").count() == 0


def test_copy(spark, archive, tmp_path):
    plan = sort_plan(index_dicom(spark, str(archive), smart=True).tables)
    log = execute_copy(plan, str(archive), str(tmp_path / "out"))
    assert copy_summary(log).first().asDict() == {"copied": 13, "kept": 0, "errors": 0, "total": 13}
    target = tmp_path / "out" / "P1" / "2024-01-02_Thorax_Abd" / "CT_Axial"
    assert (target / "CT00.dcm").exists() and (target / "RTPLAN_Plan_A" / "rp1.dcm").exists()
    # Again: everything is in place. Another content of the same size is replaced.
    (target / "CT00.dcm").write_bytes(bytes(len((target / "CT00.dcm").read_bytes())))
    again = execute_copy(plan, str(archive), (tmp_path / "out").as_uri())
    assert copy_summary(again).first().asDict() == {"copied": 1, "kept": 12, "errors": 0, "total": 13}
    assert any((target / "CT00.dcm").read_bytes())
    missing = spark.createDataFrame([("nowhere.dcm", "x/y.dcm"), ("b/readme.txt", "x/z.txt")], "src string, dst string")
    log = execute_copy(missing, str(archive), str(tmp_path / "out2"))
    assert {r["status"] for r in log.collect()} == {"copied", "error"}
    with pytest.raises(ValueError):
        execute_copy(missing, str(archive), str(archive))
    with pytest.raises(ValueError):
        execute_copy(missing.withColumn("dst", F.lit("same")), str(archive), str(tmp_path / "out3"))


# --- documents -----------------------------------------------------------------------------------
def docx(paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx(sheets):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        tabs = "".join(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1))
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{tabs}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{links}</Relationships>')
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>shared</t></si></sst>')
        for number, rows in enumerate(sheets.values(), 1):
            cells = ""
            for i, row in enumerate(rows, 1):
                for j, value in enumerate(row):
                    place = f"{chr(65 + j)}{i}"
                    if value == "shared":
                        cells += f'<c r="{place}" t="s"><v>0</v></c>'
                    elif isinstance(value, str):
                        cells += f'<c r="{place}" t="inlineStr"><is><t>{value}</t></is></c>'
                    else:
                        cells += f'<c r="{place}"><v>{value}</v></c>'
            archive.writestr(f"xl/worksheets/s{number}.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


@pytest.fixture(scope="module")
def uploads(tmp_path_factory):
    root = tmp_path_factory.mktemp("uploads")
    (root / "a.TXT").write_text("één\nregel", encoding="utf-8")
    (root / "b.docx").write_bytes(docx(["First", "Second"]))
    (root / "c.xlsx").write_bytes(xlsx({"One": [["Name", "n"], ["shared", 5]], "Two": [["x", "y"]]}))
    (root / "bad.docx").write_bytes(b"not a zip")
    (root / "bad.xlsx").write_bytes(b"not a zip")
    (root / "d.exe").write_bytes(b"MZ")
    return root


def test_documents_and_rejects(spark, uploads):
    documents, rejects = read_documents(spark, str(uploads))
    texts = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in documents.collect()}
    assert texts == {"a.TXT": "één\nregel", "b.docx": "First\n\nSecond\n\n", "c.xlsx": "Name n\nshared\nx y"}
    assert {r["path"].rsplit("/", 1)[-1] for r in rejects.collect()} == {"bad.docx", "bad.xlsx", "d.exe"}


def test_cells(spark, uploads):
    cells, _ = read_sheets(spark, str(uploads))
    rows = {(r["sheet"], r["row"], r["col"]): (r["value"], r["is_text"]) for r in cells.collect()}
    assert rows[("One", 1, 0)] == ("shared", True) and rows[("One", 1, 1)] == ("5", False)


def test_upload_rules(spark):
    files = spark.createDataFrame(
        [("a.docx", 10), ("b.docx", 11 * 1024 * 1024), ("c.mp4", 1), ("d.pdf", 1)], "name string, size long")
    names = lambda df: {r["name"] for r in df.collect()}
    assert names(accept_files(files, "docx")[0]) == {"a.docx"}
    assert names(accept_files(files, "docx", max_bytes=None)[0]) == {"a.docx", "b.docx"}
    assert names(accept_files(files, "audio")[0]) == {"c.mp4"}
    assert names(accept_files(files, "anonymize")[0]) == {"a.docx", "b.docx", "d.pdf"}
    assert names(accept_files(files, "pdf")[1]) == {"a.docx", "b.docx", "c.mp4"}


def test_html_tables(spark):
    page = "<p>x</p>\n<table id=1><tr><td>A&amp;</td><td><table><td>in</td></table></td></tr></table> <TABLE><td>2</TABLE>"
    df = spark.createDataFrame([(1, page), (2, "none"), (3, None)], "page_id long, html string")
    rows = {r["table_no"]: r for r in extract_html_tables(df, "page_id").collect()}
    assert len(rows) == 3
    assert rows[0]["html"].startswith("<table id=1>") and rows[0]["text"] == "A&in"
    assert rows[1]["html"] == "<table><td>in</td></table>" and rows[2]["text"] == "2"


def test_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as out:
        out.setnchannels(2)
        out.setsampwidth(2)
        out.setframerate(8000)
        out.writeframes(struct.pack("<4h", 16384, 0, -32768, -32768))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    rows = {r["path"]: r for r in read_audio_frames(spark, str(tmp_path)).collect()}
    assert rows["x.wav"]["sample_rate"] == 8000 and rows["x.wav"]["pcm"] == [0.25, -1.0]
    assert rows["bad.wav"]["error"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    write_texts(df, str(tmp_path / "texts"), "id", 4)
    assert spark.read.parquet(str(tmp_path / "texts")).count() == 2
    write_book(df, {"Main": df, "Other": df}, "Main", str(tmp_path / "book"))
    assert sorted(os.listdir(tmp_path / "book")) == ["Main", "Other"]
    named = df.select(F.lit("x/report.v1.docx").alias("path"))
    assert named.select(output_name("path", "summary")).first()[0] == "report.v1_summary.txt"
