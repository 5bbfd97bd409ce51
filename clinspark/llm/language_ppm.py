"""Language identification by prediction by partial matching (PPM-C) over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 3
FIT_DOCS = 1_500  # the model is fitted on about so many labelled documents per language
SYMBOLS = 256  # every byte that the sample holds has a symbol of its own; the others are never told apart
BYTES_AT_A_TIME = 1 << 17  # scored at once, at about 100 bytes of memory each
ROWS_AT_A_TIME = 1_000
UNKNOWN = "und"
_PAD = b"\n" * ORDER
_LOWER = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))


@dataclass
class Model:
    """Frozen statistics: a row per context of up to ORDER symbols, an entry per symbol seen after it.

    ``bits`` has a bit per row and symbol, ``before`` the number of entries before each 64 of them.
    ``cost`` is in bits per entry and language; a symbol without an entry costs ``escape`` of the row and
    what it costs in the row of the shorter context (``suffix``, -1 at the root).
    """

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol, below ``base``
    base: int
    row_of: np.ndarray  # number of a context of ORDER symbols -> row of its longest known suffix
    suffix: np.ndarray
    bits: np.ndarray
    before: np.ndarray
    cost: np.ndarray
    escape: np.ndarray


def _octets(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def _pieces(data: bytes) -> Iterator[np.ndarray]:
    """A text in pieces of bounded size, each led by the ORDER bytes before it."""
    padded = _PAD + data
    for at in range(0, len(data), BYTES_AT_A_TIME):
        yield np.frombuffer(padded[at : at + BYTES_AT_A_TIME + ORDER], dtype=np.uint8)


def _grams(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(label, ``gram``, ``n``): how often ORDER bytes and the next one follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label")):
                for piece in _pieces(_octets(text.as_py())):
                    code = np.zeros(len(piece) - ORDER, dtype=np.int64)
                    for place in range(ORDER + 1):
                        code = code * 256 + piece[place : len(piece) - ORDER + place]
                    values, counts = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label.as_py()] * len(values), pa.string()), pa.array(values), pa.array(counts)],
                        ["label", "gram", "n"],
                    )

    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    counted = rows.mapInArrow(run, "label string, gram long, n long")
    return counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def build_model(grams: list[tuple[str, int, int]]) -> Model:
    """The context trees of all languages, frozen into code lengths; every count is used."""
    labels, codes, counts = zip(*grams)
    return _frozen(np.array(labels, dtype=object), np.array(codes, dtype=np.int64), np.array(counts, dtype=np.float64))


def _frozen(label: np.ndarray, code: np.ndarray, count: np.ndarray) -> Model:
    """PPM-C: a symbol seen c times of n in a context has c / (n + d) with d distinct symbols; the escape
    d / (n + d) is shared by the unseen ones as the shorter context predicts them, seen ones excluded."""
    languages = sorted(set(label.tolist()))
    number = {name: place for place, name in enumerate(languages)}
    which = np.array([number[name] for name in label.tolist()], dtype=np.int64)
    wide = len(languages)
    places = [(code >> (8 * (ORDER - place))) & 255 for place in range(ORDER + 1)]
    met = np.unique(np.concatenate(places))
    base = len(met) + 1
    symbol = np.zeros(256, dtype=np.int64)
    symbol[met] = np.arange(1, base)
    coded = [symbol[place] for place in places]

    row_of = np.zeros(base**ORDER, dtype=np.int32)
    suffixes, rows, seconds, costs, escapes = [], [], [], [], []
    known, entries, offset, above = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, 0
    shorter = np.zeros((0, wide))
    for depth in range(ORDER + 1):
        context = np.zeros(len(code), dtype=np.int64)
        for place in range(ORDER - depth, ORDER):
            context = context * base + coded[place]
        keys, inverse = np.unique(context * base + coded[-1], return_inverse=True)
        seen = np.bincount(inverse * wide + which, weights=count, minlength=len(keys) * wide).reshape(-1, wide)
        used, starts, row = np.unique(keys // base, return_index=True, return_inverse=True)
        total = np.add.reduceat(seen, starts)
        distinct = np.add.reduceat((seen > 0).astype(np.float64), starts)
        if depth:
            short = shorter[np.searchsorted(entries, keys % base**depth)]
            suffix = np.searchsorted(known, used % base ** (depth - 1)) + above
        else:
            short, suffix = np.full((len(keys), wide), 1.0 / SYMBOLS), np.full(len(used), -1)
        rest = np.maximum(1.0 - np.add.reduceat(np.where(seen > 0, short, 0.0), starts), 1e-12)
        leave = np.where(total > 0, distinct / np.maximum(total + distinct, 1) / rest, 1.0)
        shorter = np.where(seen > 0, seen / np.maximum(total + distinct, 1)[row], leave[row] * short)
        costs.append(-np.log2(shorter).astype(np.float32))
        escapes.append(-np.log2(leave).astype(np.float32))
        suffixes.append(suffix)
        rows.append(row + offset)
        seconds.append(keys % base)
        row_of.reshape(-1, base**depth)[:, used] = np.arange(len(used), dtype=np.int32) + offset
        known, entries, above = used, keys, offset
        offset += len(used)
    row, second = np.concatenate(rows), np.concatenate(seconds)
    bits = np.zeros(offset * 4, dtype=np.uint64)
    np.bitwise_or.at(bits, row * 4 + (second >> 6), np.uint64(1) << (second & 63).astype(np.uint64))
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]]).astype(np.int32)
    suffix = np.concatenate(suffixes).astype(np.int32)
    return Model(languages, symbol, base, row_of, suffix, bits, before, np.concatenate(costs), np.concatenate(escapes))


def _costs(model: Model, context: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bits of each symbol after its context: (place, language)."""
    row = model.row_of[context].astype(np.int64)
    out = np.zeros((len(row), len(model.languages)), dtype=np.float32)
    live: np.ndarray | slice = slice(None)
    while len(row):
        cell, bit = row * 4 + (second >> 6), (second & 63).astype(np.uint64)
        word, one = model.bits[cell], np.uint64(1)
        found = (word >> bit & one).astype(bool)
        entry = model.before[cell] + np.bitwise_count(word & ((one << bit) - one))
        # A row without the symbol has no entry for it; what stands in its place is not used.
        out[live] += np.where(found[:, None], model.cost[np.minimum(entry, len(model.cost) - 1)], model.escape[row])
        missed = np.flatnonzero(~found)
        live = missed if isinstance(live, slice) else live[missed]
        row, second = model.suffix[row[missed]].astype(np.int64), second[missed]
        ended = row < 0
        out[live[ended]] += np.float32(np.log2(SYMBOLS))
        live, row, second = live[~ended], row[~ended], second[~ended]
    return out


def fit(
    docs: DataFrame, id_col: str, text_col: str, label_col: str, fit_docs: int = FIT_DOCS
) -> Model | None:
    """A model of the labelled rows of ``docs``, None if there are none.

    The counts come from a sample of about ``fit_docs`` whole documents per language, chosen by a
    hash of the id; all counts of the sample are used, whatever the other languages' are.
    """
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(label_col).count().collect()
    if not sizes:
        return None
    shares = [value for label, n in sizes for value in (F.lit(label), F.lit(min(1.0, fit_docs / n)))]
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = labelled.filter(draw < F.create_map(*shares)[F.col(label_col)])
    grams = _grams(sample, text_col, label_col).toArrow()
    if not grams.num_rows:
        return None
    label, code, count = (grams[name].to_numpy() for name in ("label", "gram", "n"))
    return _frozen(label, code, count.astype(np.float64))


def code_lengths(texts: list[str], model: Model) -> np.ndarray:
    """Bits that each language's model needs for each whole text: (text, language)."""
    bits = np.zeros((len(texts), len(model.languages)))
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if not waiting:
            return
        data = model.symbol[np.concatenate(waiting)]
        context = data[: -ORDER].copy()
        for place in range(1, ORDER):
            context = context * model.base + data[place : len(data) - ORDER + place]
        ends = np.cumsum([len(piece) for piece in waiting])
        starts = ends - [len(piece) for piece in waiting]
        costs = _costs(model, context, data[ORDER:])
        for start, end, owner in zip(starts, ends, owners):
            bits[owner] += costs[start : end - ORDER].sum(axis=0, dtype=np.float64)
        waiting.clear()
        owners.clear()

    size = 0
    for owner, text in enumerate(texts):
        for piece in _pieces(_octets(text)):
            waiting.append(piece)
            owners.append(owner)
            size += len(piece)
            if size >= BYTES_AT_A_TIME:
                flush()
                size = 0
    flush()
    return bits


def _judge(text: str | None, bits: np.ndarray, languages: list[str]) -> tuple[str, float]:
    if text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    best = int(np.argmin(bits))
    return languages[best], float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row of ``docs``; only the text is looked at.

    The prediction is the language whose frozen statistics code the whole text in the fewest bits,
    ``score`` its share ``2**-bits / sum(2**-bits)``. A null text and a text without a letter are
    ``und`` with score 0, as is everything if there is no model. Columns named like the added ones
    are replaced. Long texts are scored in pieces, so memory is bounded by the batch, not by its sums.
    """
    carried = [name for name in docs.columns if name not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*carried, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*carried)
    place = carried.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for batch in (whole.slice(at, ROWS_AT_A_TIME) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_A_TIME)):
            texts = batch.column(place).to_pylist()
            bits = code_lengths([text or "" for text in texts], frozen)
            said = [_judge(text, row, frozen.languages) for text, row in zip(texts, bits)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())],
                [*carried, "lang_pred", "score"],
            )

    schema = T.StructType([*rows.schema.fields]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
