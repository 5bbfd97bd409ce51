"""Reading the headers of image files without reading their pixels."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark import fixed_values as fixed

_PREAMBLE = 128
_PIXELS = 0x7FE00010
_ITEM, _ITEM_END, _SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
_WITHOUT_REPRESENTATION = {_ITEM, _ITEM_END, _SEQUENCE_END}
_UNDEFINED = 0xFFFFFFFF
_LONG = {name.encode() for name in fixed.LONG_VALUE_REPRESENTATIONS}
ALL_TAGS = fixed.CORE_TAGS | fixed.OPTIONAL_TAG_NUMBERS
STEP_BYTES = 8 * 1024  # fetched after a jump
SCHEMA = (
    "path string, size bigint, series_group string, tags map<string,string>, parse_error string"
)


class _EndOfFile(Exception):
    pass


class _Window:
    """A view of an open file that fetches only the stretches that are asked for.

    The first fetch takes ``first`` bytes, since most headers end there; after a jump behind what is
    held, ``step`` bytes or what is asked for.
    """

    def __init__(self, opened, size: int, first: int = fixed.HEADER_BYTES, step: int = STEP_BYTES):
        self.opened, self.size, self.step = opened, size, step
        self.start, self.data = 0, b""
        self._fetch(0, first)

    def _fetch(self, at: int, count: int) -> None:
        self.opened.seek(at)
        self.start, self.data = at, self.opened.read(min(count, self.size - at))

    def bytes(self, at: int, count: int) -> bytes:
        if count < 0 or at + count > self.size:
            raise _EndOfFile
        inside = at - self.start
        if inside < 0 or inside + count > len(self.data):
            self._fetch(at, max(count, self.step))
            inside = 0
            if len(self.data) < count:
                raise _EndOfFile
        return self.data[inside : inside + count]


@dataclass(frozen=True)
class _Element:
    tag: int
    at: int  # where the value starts
    size: int


class _Walk:
    """Goes from data element to data element of a little-endian file and never through a value.

    A value of known length is jumped over. One of undefined length is a sequence: its items are jumped
    over by their length or, if that is undefined too, walked to their delimiter, to any depth.
    """

    def __init__(self, window: _Window, at: int):
        self.window, self.at = window, at

    def number(self, layout: str) -> int:
        size = struct.calcsize(layout)
        (value,) = struct.unpack(layout, self.window.bytes(self.at, size))
        self.at += size
        return value

    def peek_group(self) -> int:
        return struct.unpack("<H", self.window.bytes(self.at, 2))[0]

    def element(self, explicit: bool) -> _Element:
        tag = self.number("<H") << 16 | self.number("<H")
        if tag in _WITHOUT_REPRESENTATION or not explicit:
            size = self.number("<I")
        else:
            representation = self.window.bytes(self.at, 2)
            self.at += 4 if representation in _LONG else 2
            size = self.number("<I" if representation in _LONG else "<H")
        return _Element(tag, self.at, size)

    def leave(self, element: _Element, explicit: bool) -> None:
        """Move behind the element's value."""
        if element.size != _UNDEFINED:
            self.at = element.at + element.size
            return
        open_ones = 1  # sequences and items of undefined length whose delimiters are still to come
        while open_ones:
            inner = self.element(explicit)
            if inner.tag in (_SEQUENCE_END, _ITEM_END):
                open_ones -= 1
            elif inner.size == _UNDEFINED:
                open_ones += 1
            else:
                self.at = inner.at + inner.size


def walk_header(window: _Window, wanted: dict[str, int]) -> dict[str, str] | None:
    """Wanted tags of a file, or None without the magic word or any wanted tag.

    The meta group is explicit; the transfer syntax decides about the rest. The walk ends at the pixels,
    when every wanted tag is found, or where the file ends; wherever a tag lies before, it is found.
    Values count only if they are not empty and lie fully inside the file.
    """
    syntax = fixed.CORE_TAGS["TransferSyntaxUID"]
    missing = {*wanted.values(), syntax}
    values: dict[int, str] = {}
    walk, in_meta, explicit = _Walk(window, _PREAMBLE + 4), True, True
    try:
        if window.bytes(_PREAMBLE, 4) != b"DICM":
            return None
        while missing:
            if in_meta and walk.peek_group() > 2:
                in_meta = False
                explicit = values.get(syntax, "") != fixed.IMPLICIT_TRANSFER_SYNTAX
            element = walk.element(explicit)
            if element.tag == _PIXELS:
                break
            if element.tag in missing and 0 < element.size < _UNDEFINED:
                raw = window.bytes(element.at, element.size).decode("latin-1")
                values[element.tag] = raw.replace("\0", "").strip(fixed.SPACE_CHARS)
                missing.discard(element.tag)
            walk.leave(element, explicit)
            walk.at += walk.at % 2
    except _EndOfFile:
        pass
    found = {name: values[number] for name, number in wanted.items() if number in values}
    return found or None


def parse_header(data: bytes, wanted: dict[str, int]) -> dict[str, str] | None:
    """Wanted tags of a header that is held in memory."""
    return walk_header(_Window(io.BytesIO(data), len(data)), wanted)


def read_header(opened, size: int, wanted: dict[str, int]) -> dict[str, str] | None:
    """Wanted tags of an open file of ``size`` bytes, however far into it they lie."""
    return walk_header(_Window(opened, size), wanted)


def read_dicom_headers(
    files: DataFrame, wanted: dict[str, int] | None = None, partitions: int | None = None
) -> DataFrame:
    """(path, size, series_group, tags, parse_error) of an inventory with ``uri``, ``path``, ``size``.

    Executors open each file through ``pyarrow.fs`` and walk its elements by ranged reads; the binary
    source would load pixel data too. There is no limit on how long a header or a file is.
    ``partitions`` spreads the reads, which are waits rather than work.
    """
    wanted = wanted or ALL_TAGS

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            tags, errors = [], []
            for uri in frame["uri"]:
                found, error = None, None
                try:
                    address = uri if "://" in uri else "file://" + uri.removeprefix("file:")
                    system, place = fs.FileSystem.from_uri(address)
                    with system.open_input_file(place) as opened:
                        found = read_header(opened, opened.size(), wanted)
                    if found is None:
                        error = "no_header"
                    elif found.get("TransferSyntaxUID") in fixed.UNREADABLE_TRANSFER_SYNTAXES:
                        error = "transfer_syntax"
                except Exception as problem:  # noqa: BLE001 - one bad file must not stop the job
                    error = f"{type(problem).__name__}: {problem}"
                tags.append(None if error else found)
                errors.append(error)
            yield pd.DataFrame(
                {
                    "path": frame["path"],
                    "size": frame["size"],
                    "series_group": frame["series_group"],
                    "tags": tags,
                    "parse_error": errors,
                }
            )

    if "series_group" not in files.columns:
        files = files.withColumn("series_group", F.lit(None).cast("string"))
    narrow = files.select("uri", "path", "size", "series_group")
    if partitions:
        narrow = narrow.repartition(partitions)
    return narrow.mapInPandas(parse, SCHEMA)
