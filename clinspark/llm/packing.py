"""Packing token sequences: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.llm.common import Hidden, gapless, small_table, staged

SEQUENCE_TOKENS = 4096
END_ID = 2
CACHED_WORDS = 100_000  # per generation and worker process
MET_WORDS = 1 << 20  # marks of words met once
ROWS_AT_ONCE = 500  # rows whose ids are held at once
# Characters for which lower-casing and composing a text is the same in Python as in the tokenizer.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-įı-ſ]*")
_CONTROLS = re.compile("[\x1c-\x1f]")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable ones of Latin-1 for
    themselves, the others, in order, for those from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(0x100 + place) for place, byte in enumerate(hidden)}


class WordIds(dict):
    """Ids of words as bytes, in two generations: when the young one is full it becomes the old one, and
    words still in use move over, so memory is bounded and rare words fade out. A word is stored when it
    comes again: most words come once and would only push others out."""

    def __init__(self, tokenizer, size: int):
        super().__init__()
        self.tokenizer, self.size, self.old = tokenizer, size, {}
        self.met = bytearray(MET_WORDS)  # by hash, whether a word of this generation was met
        self.letters = byte_letters()
        # Whether letters beyond ASCII reach the vocabulary as their bytes, as they do in byte-level ones.
        self.by_bytes = all(self.modelled(word) == self.encoded(word) for word in ("é", "naïve", "ñandú", "œuvre", "straße"))

    def modelled(self, word: str) -> bytes:
        """Ids of a word of letters, by the tokenizer's model alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.tokenizer.model.tokenize(word)]).tobytes()

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            core = word.strip(_PUNCTUATION)
            if core.isalpha() and "'" not in word and (self.by_bytes or word.isascii()):
                if core == word:
                    ids = self.modelled(word)
                else:  # marks around letters are pieces of their own
                    before, _, after = word.partition(core)
                    ids = b"".join([self[piece] for piece in (before, core, after) if piece])
            else:
                ids = self.encoded(word)
            place = hash(word) % MET_WORDS
            if not self.met[place]:
                self.met[place] = 1
                return ids
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
            self.met = bytearray(MET_WORDS)
        self[word] = ids
        return ids


def word_encoder(path: str) -> Callable[[str], bytes]:
    """Text to little-endian unsigned 32-bit ids with the tokenizer file at ``path``.

    The tokenizer drops white space and encodes what lies between on its own, so ids are kept per
    word. Texts with characters outside ``_PLAIN``, where its Unicode rules could differ from Python's,
    are given to it whole. A worker process keeps its encoder from task to task.
    """
    kept = sys.__dict__.setdefault("_word_encoders", {})
    if path not in kept:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        kept[path] = WordIds(tokenizer, CACHED_WORDS)
    words = kept[path]

    def encode(text: str) -> bytes:
        if text.isascii() and not _CONTROLS.search(text) or _PLAIN.fullmatch(text):
            return b"".join([words[word] for word in text.lower().split()])
        return words.encoded(text)

    return encode


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """(id, ``start``, ``length``, ``doc_tokens``, ``ids``): whole texts as token ids followed by
    ``end_id``, cut every ``most`` ids. ``ids`` holds little-endian unsigned 32-bit numbers.

    A null text is the empty text: one piece that holds ``end_id`` alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            rows, starts, lengths, totals, blobs = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = encode(text.as_py() or "") + end
                count = len(ids) // 4
                for start in range(0, count, most):
                    rows.append(row)
                    starts.append(start)
                    lengths.append(min(most, count - start))
                    totals.append(count)
                    blobs.append(ids[4 * start : 4 * (start + most)])
            columns = [pa.array(values, pa.int64()) for values in (starts, lengths, totals)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), *columns, pa.array(blobs, pa.binary())],
                ["id", "start", "length", "doc_tokens", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, start long, length long, doc_tokens long, ids binary"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def shortest_pack_first(histogram: dict[int, int], most: int) -> Counter:
    """How often each packing pattern (lengths in the order they were placed) occurs.

    Lengths are placed longest first. All pieces of a length go into the packs that are shortest at
    that moment, i.e. have the most room, as many at once as the pattern has packs; if even those have
    no room, new packs are opened. Each step uses up a length or moves a whole pattern, so there are
    at most two patterns per length.
    """
    by_room: list[Counter] = [Counter() for _ in range(most + 1)]
    widest = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while widest and not by_room[widest]:
                widest -= 1
            if widest < length:
                by_room[most - length][(length,)] += left
                widest = max(widest, most - length)
                break
            pattern = next(iter(by_room[widest]))
            packs = by_room[widest].pop(pattern)
            used = min(packs, left)
            if packs > used:
                by_room[widest][pattern] = packs - used
            by_room[widest - length][pattern + (length,)] += used
            left -= used
    return sum(by_room, Counter())


def pack(pieces: DataFrame, order: list[str], most: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``most``.

    The driver sees one count per length, ``most`` numbers at most, and turns them into patterns. A
    piece finds its place by its rank among the pieces of its length: each occurrence of a length in a
    pattern serves a range of ranks. Ranks are dealt in two levels, so no task holds a length; the
    table of ranges depends on the histogram alone and is broadcast. ``order`` should tell pieces
    apart; equal pieces may swap places. Columns named like the added ones are replaced.
    """
    spark = pieces.sparkSession
    hidden = Hidden(pieces, ("sequence_id", "offset"))
    length, order = hidden.own["length"], [hidden.own[name] for name in order]
    rows = pieces.select(*hidden.columns())
    histogram = {row[0]: row[1] for row in rows.groupBy(length).count().collect()}
    if not histogram:
        return pieces.select(*hidden.names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    served = dict.fromkeys(histogram, 0)
    places, sequence = [], 0
    for pattern, packs in sorted(shortest_pack_first(histogram, most).items(), reverse=True):
        offset = 0
        for piece in pattern:
            places.append((piece, served[piece], served[piece] + packs, sequence, offset))
            served[piece] += packs
            offset += piece
        sequence += packs
    ranges = small_table(spark, places, dict.fromkeys(("_length", "_from", "_to", "_sequence", "offset"), pa.int64()))
    ranked = gapless(rows, [length], order, "_rank", sum(histogram.values()))
    here = (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(ranges), here).select(
        *hidden.back(), (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, digest: bool = False) -> DataFrame:
    """Documents (``doc_id``, ``text``) as packed pieces, with their ``ids`` or only with the
    CRC-32 of those (``ids_crc32``). Repeated rows are packed as often as they come."""
    pieces = token_pieces(docs, tokenizer_path)
    if digest:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    stored = staged(pieces, "token-pieces")
    order = ["doc_id", "start", *(["ids_crc32"] if digest else [])]
    return pack(stored, order)
