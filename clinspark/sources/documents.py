"""Texts and sheets out of txt, docx and xlsx files, with unreadable files as rows of their own."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.fixed_values import TEXT_EXTENSIONS
from clinspark.functions.text import file_extension
from clinspark.operators.sheets import sheet_text

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def docx_text(content: bytes) -> str:
    """Raw text of a docx: one paragraph per line, blank line between paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    paragraphs = []
    for paragraph in body.iter(f"{_WORD}p"):
        parts = [
            node.text or "" if node.tag == f"{_WORD}t" else marks.get(node.tag, "")
            for node in paragraph.iter()
        ]
        paragraphs.append("".join(parts) + "\n\n")
    return "".join(paragraphs)


def xlsx_cells(content: bytes) -> Iterator[tuple[int, str, int, int, str, bool]]:
    """(sheet_no, sheet, row, col, value, is_text) of every non-empty cell of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            strings = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = [
                "".join(text.text or "" for text in item.iter(f"{_SHEET}t"))
                for item in strings.iter(f"{_SHEET}si")
            ]
        links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        targets = {link.get("Id"): link.get("Target", "") for link in links.iter(_PACKAGE)}
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        for number, sheet in enumerate(book.iter(f"{_SHEET}sheet")):
            target = targets[sheet.get(_RELATION)].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            root = ElementTree.fromstring(archive.read(part))
            for cell in root.iter(f"{_SHEET}c"):
                letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", cell.get("r", "")).groups()
                column = 0
                for letter in letters:
                    column = column * 26 + ord(letter) - 64
                kind, value = cell.get("t"), cell.find(f"{_SHEET}v")
                if kind == "inlineStr":
                    text = "".join(node.text or "" for node in cell.iter(f"{_SHEET}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = shared[int(value.text)] if kind == "s" else value.text
                is_text = kind in ("s", "str", "inlineStr")
                yield number, sheet.get("name", ""), int(digits) - 1, column - 1, text, is_text


def _guarded(content: bytes, read) -> tuple[object, str | None]:
    try:
        return read(content), None
    except Exception as problem:  # noqa: BLE001 - a damaged file becomes a reject row
        return None, f"{type(problem).__name__}: {problem}"


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", file_extension(F.substring_index("path", "/", -1)).alias("ext"), "content")
    )


def read_sheets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(cells, rejects)`` of all workbooks below ``path``.

    Cells are long: book, sheet_no, sheet, row, col, value, is_text. Row 0 holds the headers.
    """
    schema = (
        "book string, sheet_no int, sheet string, row int, col int, value string, "
        "is_text boolean, error string"
    )

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["sheet_no", "sheet", "row", "col", "value", "is_text"]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                cells, error = _guarded(content, lambda data: list(xlsx_cells(data)))
                rows = pd.DataFrame(cells or [(None,) * 6] * (error is not None), columns=columns)
                yield rows.assign(book=path, error=error)[["book", *columns, "error"]]

    books = _contents(spark, path).filter("ext = 'xlsx'").select("path", "content")
    parsed = books.mapInPandas(parse, schema)
    cells = parsed.filter("error IS NULL").drop("error")
    rejects = parsed.filter("error IS NOT NULL").select(F.col("book").alias("path"), "error")
    return cells, rejects


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, rejects)`` of the txt, docx and xlsx files below ``path``.

    Plain text is decoded in the JVM; only zip archives cross to Python. Other extensions and
    damaged files become rows of ``rejects``.
    """
    files = _contents(spark, path)
    plain = files.filter("ext = 'txt'").select("path", F.decode("content", "UTF-8").alias("text"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = [_guarded(content, docx_text) for content in frame["content"]]
            texts, errors = zip(*results) if results else ((), ())
            yield pd.DataFrame({"path": frame["path"], "text": texts, "error": errors})

    word = (
        files.filter("ext = 'docx'")
        .select("path", "content")
        .mapInPandas(parse, "path string, text string, error string")
    )
    cells, sheet_rejects = read_sheets(spark, path)
    books = sheet_text(cells).select(F.col("book").alias("path"), "text")
    documents = plain.unionByName(
        word.filter("error IS NULL").select("path", "text")
    ).unionByName(books)
    unsupported = files.filter(~F.col("ext").isin(*TEXT_EXTENSIONS)).select(
        "path", F.concat(F.lit("unsupported file type: "), "ext").alias("error")
    )
    rejects = unsupported.unionByName(
        word.filter("error IS NOT NULL").select("path", "error")
    ).unionByName(sheet_rejects)
    return documents, rejects


class _TableCollector(HTMLParser):
    """Outer HTML and text of every ``<table>``, nested tables included, in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.line_starts = [0, *(match.end() for match in re.finditer("\n", html))]
        self.open: list[int] = []
        self.tables: list[dict] = []
        self.feed(html)
        self.close()

    def _place(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(len(self.tables))
            self.tables.append({"start": self._place(), "end": len(self.html), "text": []})

    def handle_data(self, data):
        for number in self.open:
            self.tables[number]["text"].append(data)

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            number = self.open.pop()
            self.tables[number]["end"] = self.html.index(">", self._place()) + 1


def extract_html_tables(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_no, html, text) of every table in an HTML column."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (identity, number, page[table["start"] : table["end"]], "".join(table["text"]))
                for identity, page in zip(frame[key], frame[html])
                if page is not None
                for number, table in enumerate(_TableCollector(page).tables)
            ]
            yield pd.DataFrame(rows, columns=[key, "table_no", "html", "text"])

    kind = df.schema[key].dataType.simpleString()
    candidates = df.select(key, html).filter(F.lower(html).contains("<table"))
    return candidates.mapInPandas(parse, f"{key} {kind}, table_no int, html string, text string")
