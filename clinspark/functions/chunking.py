"""Cutting documents into overlapping chunks for models.

The cut rules carry state from one chunk to the next, so the two character-window chunkers run as
Arrow UDFs (one document per value, nothing leaves the partition); the sentence
chunker is a plain SQL expression.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.fixed_values import CHUNK_DEFAULT, CHUNK_SENTENCES, CHUNK_SUMMARY, SPACE_CHARS
from clinspark.functions.text import as_column, split_sentences

_SENTENCE_MARK = re.compile("[.!?;] ")
_SUMMARY_MARK = re.compile("[.?][\\n ]")
_LINE_BREAKS = re.compile("\n+")

Span = tuple[int, int]


class Breaks:
    """Offsets of one kind of break in a text, found once and searched by bisection."""

    def __init__(self, places: Iterable[int]):
        self.places = list(places)

    @classmethod
    def of(cls, pattern: re.Pattern, text: str) -> Breaks:
        return cls(match.start() for match in pattern.finditer(text))

    def first(self, low: int, high: int) -> int | None:
        """The least offset in ``low <= offset < high``."""
        at = bisect_left(self.places, low)
        return self.places[at] if at < len(self.places) and self.places[at] < high else None

    def last(self, low: int, high: int) -> int | None:
        """The greatest offset in ``low <= offset < high``."""
        at = bisect_left(self.places, high) - 1
        return self.places[at] if at >= 0 and self.places[at] >= low else None


class Outline:
    """A text and where it can be cut. All rules below work on offsets; text is sliced at the end."""

    def __init__(self, text: str):
        self.text = text
        self.sentences = Breaks.of(_SENTENCE_MARK, text)
        self.spaces = Breaks.of(re.compile(" "), text)

    def trimmed(self, start: int, end: int) -> Span:
        while start < end and self.text[start] in SPACE_CHARS:
            start += 1
        while end > start and self.text[end - 1] in SPACE_CHARS:
            end -= 1
        return start, end

    def paragraphs(self) -> Iterator[Span]:
        """What lies between runs of line breaks, without blank ones."""
        edges = [0, *(edge for run in _LINE_BREAKS.finditer(self.text) for edge in run.span()), len(self.text)]
        for start, end in zip(edges[::2], edges[1::2]):
            inner = self.trimmed(start, end)
            if inner[0] < inner[1]:
                yield start, end

    def pieces(self, start: int, end: int, size: int, overlap: int) -> Iterator[Span]:
        """Spans of at most ``size`` characters of a paragraph that is longer.

        The cut is the last space within reach or the end of the last sentence, if that lies beyond
        45 % of the size; a cut below 35 % is no use, then the piece is cut at its full size. The next
        piece repeats the overlap, at most a fifth of the size.
        """
        start, end = self.trimmed(start, end)
        while end - start > size:
            reach = start + size
            space, sentence = self.spaces.last(start, reach + 1), self.sentences.last(start, reach)
            candidates = [-1 if space is None else space - start]
            if sentence is not None and sentence - start > 0.45 * size:
                candidates.append(sentence - start + 1)
            cut = max(candidates)
            cut = size if cut < 0.35 * size else cut
            yield self.trimmed(start, start + cut)
            start, _ = self.trimmed(start + cut - min(overlap, size // 5, cut - 1), end)
        if start < end:
            yield start, end

    def context(self, chunk: list[Span], overlap: int) -> list[Span]:
        """The end of a finished chunk that the next chunk repeats; spans are joined by line breaks.

        It begins after the last sentence of the tail, else after its last line break, if that lies
        beyond 35 % of the overlap, else after its first space, else it is the whole tail.
        """
        if overlap <= 0 or joined_length(chunk) <= overlap:
            return []
        tail: list[Span] = []
        room = overlap
        for start, end in reversed(chunk):
            begin = max(start, end - room)
            tail.append((begin, end))
            room -= end - begin + 1
            if room < 0:
                break
        tail.reverse()
        places = [overlap - joined_length(tail[at:]) for at in range(len(tail))]
        early = 0.35 * overlap
        marks = [self.sentences.last(start, end - 1) for start, end in tail]
        ends = [place + mark - span[0] for place, mark, span in zip(places, marks, tail) if mark is not None]
        lines = [place - 1 for place in places if place > 0]
        gaps = [self.spaces.first(start, end) for start, end in tail]
        first = next((place + gap - span[0] for place, gap, span in zip(places, gaps, tail) if gap is not None), 0)
        turn = next((found[-1] for found in (ends, lines) if found and found[-1] > early), first)
        begin = turn + 1 if turn > 0 else 0
        kept = [(max(span[0], span[0] + begin - place), span[1]) for place, span in zip(places, tail)]
        return self.outer_trimmed([span for span in kept if span[0] <= span[1]])

    def outer_trimmed(self, chunk: list[Span]) -> list[Span]:
        """A chunk without white space at its two ends."""
        chunk = list(chunk)
        while chunk:
            chunk[0] = (self.trimmed(*chunk[0])[0], chunk[0][1])
            if chunk[0][0] < chunk[0][1]:
                break
            chunk.pop(0)
        while chunk:
            chunk[-1] = (chunk[-1][0], self.trimmed(*chunk[-1])[1])
            if chunk[-1][0] < chunk[-1][1]:
                break
            chunk.pop()
        return chunk

    def sliced(self, chunk: list[Span]) -> str:
        return "\n".join(self.text[start:end] for start, end in chunk)


def joined_length(chunk: list[Span]) -> int:
    return sum(end - start for start, end in chunk) + max(len(chunk) - 1, 0)


def chunk_spans(outline: Outline, size: int, overlap: int) -> list[list[Span]]:
    """Chunks of about ``size`` characters as lists of spans.

    Paragraphs are taken in as long as they fit. A paragraph that does not fit starts a new chunk
    after the context of the one before; one that is longer than a chunk stands alone, in pieces.
    """
    done: list[list[Span]] = []
    held: list[Span] = []
    for start, end in outline.paragraphs():
        alone = end - start > size
        if alone or (held and joined_length(held) + 1 + end - start > size):
            done.append(outline.outer_trimmed(held))
            held = [] if alone else outline.context(done[-1], overlap)
        if alone:
            done += [[piece] for piece in outline.pieces(start, end, size, overlap)]
        else:
            held.append((start, end))
    done.append(outline.outer_trimmed(held))
    return [chunk for chunk in done if chunk]


def chunks_of(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed into chunks; a text without any is its own chunk."""
    outline = Outline(text)
    return [outline.sliced(chunk) for chunk in chunk_spans(outline, size, overlap)] or [text]


def window_spans(outline: Outline, size: int, overlap: int) -> Iterator[Span]:
    """Fixed windows that end at a sentence if one ends in their second half."""
    marks = Breaks.of(_SUMMARY_MARK, outline.text)
    start, total = 0, len(outline.text)
    while start < total:
        end = min(start + size, total)
        mark = marks.last(start, end - 1) if end < total else None
        if mark is not None and mark - start > size / 2:
            end = mark + 1
        yield outline.trimmed(start, end)
        start = total if end == total else max(end - overlap, 0)


def windows_of(text: str, size: int, overlap: int, minimum: int = 0) -> list[str]:
    """The windows that have more than ``minimum`` characters. By default nothing is dropped."""
    outline = Outline(text)
    return [text[start:end] for start, end in window_spans(outline, size, overlap) if end - start > minimum]


ROWS_AT_ONCE = 200


def _cut(text: Column | str, cutter: Callable[[str], list[str]]) -> Column:
    """``cutter`` over Arrow batches: texts become Python strings, and pieces are held as such, for a few
    rows at a time, however many an Arrow batch has."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        kind, done = pa.list_(pa.string()), []
        for start in range(0, len(texts), ROWS_AT_ONCE):
            some = texts.slice(start, ROWS_AT_ONCE).to_pylist()
            done.append(pa.array([None if text is None else cutter(text) for text in some], kind))
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return cut(as_column(text))


def chunk_text(
    text: Column | str, size: int = CHUNK_DEFAULT[0], overlap: int = CHUNK_DEFAULT[1]
) -> Column:
    """Array of overlapping paragraph chunks."""
    return _cut(text, lambda value: chunks_of(value, size, overlap))


def chunk_fixed(
    text: Column | str,
    size: int = CHUNK_SUMMARY[0],
    overlap: int = CHUNK_SUMMARY[1],
    minimum: int = 0,
) -> Column:
    """Array of fixed windows. ``minimum`` drops windows of so many characters or fewer; by default
    every character of the text is in a window."""
    return _cut(text, lambda value: windows_of(value, size, overlap, minimum))


def chunk_sentences(text: Column | str, size: int = CHUNK_SENTENCES) -> Column:
    """Array of sentence groups; every sentence ends in a dot afterwards. Short texts stay whole."""
    text = as_column(text)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, sentence: Column) -> Column:
        open_chunk = state["open"]
        fits = F.length(open_chunk) + 1 + F.length(sentence) <= size
        closed = F.when(fits | (open_chunk == ""), state["done"]).otherwise(
            F.array_append(state["done"], open_chunk)
        )
        joined = F.when(
            fits & (open_chunk != ""), F.concat(open_chunk, F.lit(" "), sentence, F.lit("."))
        ).otherwise(F.concat(sentence, F.lit(".")))
        return F.struct(closed.alias("done"), joined.alias("open"))

    def finish(state: Column) -> Column:
        return F.when(state["open"] == "", state["done"]).otherwise(
            F.array_append(state["done"], state["open"])
        )

    packed = F.aggregate(split_sentences(text), start, step, finish)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def explode_chunks(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """One row per chunk: ``keep`` columns, ``chunk_idx``, ``text``."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_idx", "text"))


def register_table_functions(spark: SparkSession) -> None:
    """Make the chunkers callable from SQL: ``SELECT … FROM docs, LATERAL chunk_text(docs.text)``."""

    def table_function(cutter, size: int, overlap: int):
        class Cut:
            def eval(self, text: str):
                if text is not None:
                    yield from enumerate(cutter(text, size, overlap))

        return F.udtf(Cut, returnType="chunk_idx: int, chunk: string")

    spark.udtf.register("chunk_text", table_function(chunks_of, *CHUNK_DEFAULT))
    spark.udtf.register("chunk_fixed", table_function(windows_of, *CHUNK_SUMMARY))
