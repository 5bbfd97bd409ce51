"""Fill-in-the-middle texts by piece tables: descriptors over two buffers that are never changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.llm.common import Hidden

SENTINELS = ("<P>", "<S>", "<M>")
FIM_RATE, SPM_RATE, SEED = 50, 80, 42
SCAN_BYTES = 1 << 22  # so much of a text is looked at at once
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TEXT, MARKS = 0, 1  # the two buffers: the document and the three sentinels

# A descriptor: (buffer, start, length) in bytes.
Piece = tuple[int, int, int]


def unit_ends(data: np.ndarray) -> Iterator[np.ndarray]:
    """Byte positions after each unit of a text: white space before words belongs to them, white space at
    the end is a unit. UTF-8 keeps white space out of longer characters, so bytes can be looked at."""
    for at in range(0, len(data), SCAN_BYTES):
        space = _IS_SPACE[data[at : at + SCAN_BYTES + 1]]
        last = at + SCAN_BYTES >= len(data)
        if last:
            space = np.append(space, True)
        yield at + 1 + np.flatnonzero(~space[:-1] & space[1:])
        if last and _IS_SPACE[data[-1]]:
            yield np.array([len(data)])


def characters(data: np.ndarray, start: int, length: int) -> int:
    """Code points of a piece of UTF-8: its bytes that do not continue one."""
    parts = (data[at : min(at + SCAN_BYTES, start + length)] for at in range(start, start + length, SCAN_BYTES))
    return sum(int(np.count_nonzero((part & 0xC0) != 0x80)) for part in parts)


def draws(name: object, seed: int) -> list[int]:
    """Four numbers of 32 bits that follow from the document's id alone (no id: the empty text)."""
    digits = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    return [int(digits[at : at + 8], 16) for at in range(0, 32, 8)]


def cut_points(data: np.ndarray, first: int, second: int) -> tuple[int, int, int]:
    """The number n of units, and the byte positions after the smaller and the larger of the two numbers,
    taken modulo n + 1, of units."""
    n = sum(len(ends) for ends in unit_ends(data))
    wanted = sorted((first % (n + 1), second % (n + 1)))
    cuts, seen = [0, 0], 0
    for ends in unit_ends(data):
        for at, units in enumerate(wanted):
            if seen < units <= seen + len(ends):
                cuts[at] = int(ends[units - seen - 1])
        seen += len(ends)
    return n, cuts[0], cuts[1]


def split(pieces: list[Piece], at: int) -> list[Piece]:
    """The same text with a boundary between descriptors at byte ``at``."""
    out, done = [], 0
    for buffer, start, length in pieces:
        inside = at - done
        if 0 < inside < length:
            out += [(buffer, start, inside), (buffer, start + inside, length - inside)]
        else:
            out.append((buffer, start, length))
        done += length
    return out


def between(pieces: list[Piece], start: int, end: int) -> list[Piece]:
    """The descriptors of the bytes from ``start`` to ``end``, which are boundaries."""
    out, done = [], 0
    for piece in pieces:
        if start <= done and done + piece[2] <= end and piece[2]:
            out.append(piece)
        done += piece[2]
    return out


def sentinel(number: int) -> list[Piece]:
    before = sum(len(mark.encode()) for mark in SENTINELS[:number])
    return [(MARKS, before, len(SENTINELS[number].encode()))]


def arranged(size: int, low: int, high: int, form: str) -> list[Piece]:
    """The descriptors of a document of ``size`` bytes that is cut at ``low`` and ``high``, in the order of
    ``form``."""
    whole: list[Piece] = [(TEXT, 0, size)] if size else []
    if form == "plain":
        return whole
    pieces = split(split(whole, low), high)
    prefix, middle, suffix = between(pieces, 0, low), between(pieces, low, high), between(pieces, high, size)
    lead, suffix_mark, middle_mark = (sentinel(number) for number in range(3))
    if form == "psm":
        return lead + prefix + suffix_mark + suffix + middle_mark + middle
    return suffix_mark + suffix + lead + prefix + middle_mark + middle


def restored(output: bytes, form: str) -> list[Piece]:
    """Descriptors over a finished text that give the document back: the sentinels are found in it, it is
    cut at them, and the parts go back to their places."""
    whole: list[Piece] = [(TEXT, 0, len(output))] if output else []
    if form == "plain":
        return whole
    found = {mark: output.find(mark.encode()) for mark in SENTINELS}
    order = sorted(SENTINELS, key=found.__getitem__)
    part = {}
    for mark, after in zip(order, [*order[1:], None]):
        start, end = found[mark] + len(mark.encode()), len(output) if after is None else found[after]
        part[mark] = between(split(split(whole, start), end), start, end)
    lead, suffix_mark, middle_mark = SENTINELS
    return part[lead] + part[middle_mark] + part[suffix_mark]


def streamed(pieces: list[Piece], text: memoryview, marks: bytes) -> Iterator[memoryview]:
    buffers = (text, memoryview(marks))
    for buffer, start, length in pieces:
        yield buffers[buffer][start : start + length]


def digest(pieces: list[Piece], text: memoryview, marks: bytes) -> str:
    seen = hashlib.sha256()
    for part in streamed(pieces, text, marks):
        seen.update(part)
    return seen.hexdigest()


ADDED = ("n", "form", "pieces", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")
KINDS = (
    "n long", "form string", "pieces array<struct<buffer: int, start: long, length: long>>", "prefix_chars long",
    "middle_chars long", "output string", "output_sha256 string", "restored_sha256 string",
)
ARROW_KINDS = (
    pa.int64(), pa.string(), pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])),
    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
)


def transformed(name: object, text: memoryview, marked: bool, seed: int, fim_rate: int, spm_rate: int, with_text: bool) -> tuple:
    """The added columns of one document."""
    data = np.frombuffer(text, dtype=np.uint8)
    h1, h2, h3, h4 = draws(name, seed)
    n, low, high = cut_points(data, h1, h2)
    plain = not len(data) or marked or h3 % 100 >= fim_rate
    form = "plain" if plain else "spm" if h4 % 100 < spm_rate else "psm"
    pieces = arranged(len(data), low, high, form)
    marks = "".join(SENTINELS).encode()
    output = b"".join(streamed(pieces, text, marks))
    back = restored(output, form)
    return (
        n,
        form,
        [{"buffer": buffer, "start": start, "length": length} for buffer, start, length in pieces],
        None if plain else characters(data, 0, low),
        None if plain else characters(data, low, high - low),
        output.decode("utf-8", "replace") if with_text else None,
        digest(pieces, text, marks),
        digest(back, memoryview(output), marks),
    )


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    fim_rate: int = FIM_RATE,
    spm_rate: int = SPM_RATE,
    with_text: bool = True,
) -> DataFrame:
    """Adds ``n`` (units), ``form`` (plain, psm, spm), ``pieces``, ``prefix_chars``, ``middle_chars``,
    ``output``, ``output_sha256`` and ``restored_sha256`` to every row. Without ``with_text`` the output is
    null and the text column left out, so that no text goes back to the JVM.

    ``pieces`` are the descriptors (buffer 0: the text, 1: the sentinels one after the other; byte start
    and length) whose bytes, in order, are the output. A document is cut at two unit boundaries that
    follow from its id; ``fim_rate`` of 100 documents are rearranged, ``spm_rate`` of 100 of those with
    the suffix first. ``restored_sha256`` is that of the text made again from output and form alone.

    Nulls and edges: a null text is the empty text; empty texts and texts that hold a sentinel stay
    plain; a null id counts as an empty one; rows that repeat an id are cut by the same numbers; an empty
    table gives an empty table. Input columns named like the added ones are replaced. There is no
    shuffle, and a task holds a batch of rows and one output at a time.
    """
    hidden = Hidden(docs if with_text else docs.drop(text_col), ADDED)
    carried = [F.col(own) for own in hidden.own.values()]
    base = docs.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").alias("_body"), *hidden.columns())
    kept = base.select(*carried).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("_body"), "")
            marked = np.zeros(len(texts), dtype=bool)
            for mark in SENTINELS:
                marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
            rows = [
                transformed(name, memoryview(text.as_buffer()), bool(seen), seed, fim_rate, spm_rate, with_text)
                for name, text, seen in zip(batch.column("_id").to_pylist(), texts, marked)
            ]
            added = [pa.array([row[at] for row in rows], kind) for at, kind in enumerate(ARROW_KINDS)]
            own = [batch.column(name) for name in hidden.own.values()]
            yield pa.RecordBatch.from_arrays(own + added, [*hidden.own.values(), *ADDED])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    result = base.mapInArrow(run, ", ".join(filter(None, (given, *KINDS))))
    return result.select(*hidden.back(), *ADDED)
