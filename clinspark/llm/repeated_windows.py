"""Repeated byte windows across documents: depth-limited radix sort of suffixes, and their removal.

A window is the first ``WINDOW`` bytes of a suffix; two windows are equal if their suffixes fall into
one group when suffixes are ordered to that depth. The order is made by most-significant-digit passes:

* Suffixes are looked at in classes: every window holds exactly one *anchor*, the 32-byte gram in it
  with the least hash (the first of several), at a place that the window's bytes alone decide. So equal
  windows have equal anchors at equal places, and a whole stretch of neighbouring suffixes that share
  an anchor occurrence can be treated as one record. A window also holds the gram behind the anchor or, if
  the anchor is further back than that leaves room for, the one before it; stretches are cut there.
* Digit 1 is the anchor's gram with that neighbour. Pairs that occur once in the corpus end there.
* Digit 2 is everything that is left down to the threshold depth. If all occurrences of a gram lie in
  the same surroundings, the whole stretch is one digit; otherwise each suffix of the stretch has its
  own. Members of a group that are not its first (document, place) are repeats.

Digits are compared as keyed hashes of their bytes: a 64-bit one for order and groups and an independent
32-bit one beside it. The keys are drawn anew for every run, and for any two different grams the chance
to agree is 2 ** -64 and 2 ** -32 over the keys (multilinear hashing), whatever the texts are, so no text
can be made to collide with another. Two windows count as equal if 80 bits agree.

Digits travel as arrays of hashes between stored parts of the corpus and buckets of hash values, both
of bounded size; texts are stored once and never shuffled.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.llm.common import new_folder

WINDOW = 100
GRAM = 32
BATCH_BYTES = 1 << 19
POSITION_BITS = 23
PART_BYTES = 64 << 20
BUCKET_BYTES = 16 << 20  # of text per bucket of hash values
MIN_BUCKETS = 64
_MIXED = np.uint64(0)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SPOT = np.dtype([("row", "<u4"), ("start", "<i8"), ("length", "<u4")])
_NO_ID = np.iinfo(np.int64).max


def _mix(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of two 64-bit hashes in order."""
    out = a * _K[lane]
    out ^= out >> np.uint64(32)
    out += b
    out *= _K[lane + 1]
    out ^= out >> np.uint64(29)
    return out


def drawn_keys() -> np.ndarray:
    """Keys of three lanes of 32 bits for the words of a gram, and one to start from."""
    draws = [secrets.randbits(64) for _ in range(3 * (GRAM // 4 + 1))]
    return np.array(draws, dtype=np.uint64).reshape(3, GRAM // 4 + 1)


def keyed_lane(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """32 bits for the gram at each place: the upper half of a sum of its 4-byte words times keys."""
    count = len(words) - GRAM + 4
    total, scaled = np.full(count, keys[0], dtype=np.uint64), np.empty(count, dtype=np.uint64)
    for place in range(GRAM // 4):
        np.multiply(words[4 * place : 4 * place + count], keys[place + 1], out=scaled)
        total += scaled
    total >>= np.uint64(32)
    return total


class Batch:
    """Hashes of all grams of some pieces of texts laid end to end.

    ``pieces`` are (row of the part, offset in the text, bytes). A text longer than a batch comes in
    pieces that overlap by ``window - 1`` bytes, so that each window lies in exactly one piece.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]], window: int, keys: np.ndarray):
        self.window = window
        # The gram beside an anchor is so far from it that each window holds one of its two sides.
        self.beside_at = min(GRAM, (window - GRAM + 1) // 2)
        sizes = np.array([len(data) for _, _, data in pieces])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.rows = np.array([row for row, _, _ in pieces], dtype=np.int64)
        self.bases = np.array([base for _, base, _ in pieces], dtype=np.int64)
        data = b"".join(data for _, _, data in pieces)
        self.size = len(data)
        padded = np.frombuffer(data + bytes(2 * GRAM + window), dtype=np.uint8)
        words = np.ndarray((len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,)).astype(np.uint64)
        self.grams = keyed_lane(words, keys[0]) << np.uint64(32)
        self.grams |= keyed_lane(words, keys[1])
        self.beside = keyed_lane(words, keys[2])

    def anchors(self) -> dict[str, np.ndarray]:
        """Stretches of window starts ``first..last`` that share the anchor at ``at``."""
        count = self.size - self.window + 1
        if count <= 0:
            return dict.fromkeys(("first", "last", "at"), np.zeros(0, dtype=np.int64))
        low = np.uint64((1 << POSITION_BITS) - 1)
        span = self.window - GRAM + 1
        length = count + span - 1
        least = (self.grams[:length] & ~low) | np.arange(length, dtype=np.uint64)
        covered = 1
        while 2 * covered <= span:
            least = np.minimum(least[:-covered], least[covered:])
            covered *= 2
        if covered < span:
            least = np.minimum(least[: -(span - covered)], least[span - covered :])
        anchor = (least & low).astype(np.int64)
        for start, end in zip(self.starts.tolist(), self.ends.tolist()):
            anchor[max(start, end - self.window + 1) : end] = -1  # these windows would leave the text
        turns = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first = np.concatenate([[0], turns])
        last = np.concatenate([turns - 1, [count - 1]])
        valid = anchor[first] >= 0
        first, last = first[valid], last[valid]
        at = anchor[first]
        # Windows that begin before this hold the gram before the anchor, the others the one behind it.
        turn = at - (self.window - GRAM - self.beside_at)
        left, right = first < turn, last >= turn
        return {
            "first": np.concatenate([first[left], np.maximum(first, turn)[right]]),
            "last": np.concatenate([np.minimum(last, turn - 1)[left], last[right]]),
            "at": np.concatenate([at[left], at[right]]),
        }

    def digits(self, found: dict[str, np.ndarray]) -> np.ndarray:
        """A hash of the two grams that all windows of a stretch hold: the anchor and the one beside it."""
        at = found["at"]
        before = found["last"] < at - (self.window - GRAM - self.beside_at)
        low = np.where(before, at - self.beside_at, at)
        return _mix(self.grams[low], self.grams[low + self.beside_at] ^ before.astype(np.uint64))

    def window_hash(self, at: np.ndarray, lane: int) -> np.ndarray:
        """A hash of the window's bytes at each place."""
        offsets = [*range(0, self.window - 2 * GRAM, 2 * GRAM), self.window - 2 * GRAM]
        grams = self.beside if lane else self.grams
        total = np.full(len(at), _K[3 - lane], dtype=np.uint64)
        for offset in offsets:
            here = at + offset
            total = _mix(total, _mix(grams[here], grams[here + GRAM], lane), lane)
        return total

    def surroundings(self, found: dict[str, np.ndarray], lane: int) -> np.ndarray:
        """A hash of all bytes of a stretch's windows and of the place of its anchor; never 0."""
        first, last = found["first"], found["last"]
        shape = ((last - first) << 32 | (found["at"] - first)).astype(np.uint64)
        both = _mix(self.window_hash(first, lane), self.window_hash(last, lane), lane)
        return _mix(both, shape, lane) | np.uint64(1)

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, offset in the text) of places in the batch."""
        piece = np.searchsorted(self.starts, at, side="right") - 1
        return self.rows[piece], at - self.starts[piece] + self.bases[piece]


def _open(path: str) -> pq.ParquetFile:
    if "://" in path or path.startswith("file:"):
        system, place = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    else:
        system, place = pafs.LocalFileSystem(), path
    return pq.ParquetFile(system.open_input_file(place))


def part_rows(path: str, group: int) -> Iterator[tuple[int, int | None, bytes]]:
    """(row, id, text as UTF-8) of one stored part."""
    row = 0
    with _open(path) as stored:
        for batch in stored.iter_batches(batch_size=256, row_groups=[group]):
            ids = batch.column(0).to_pylist()
            for number, data in zip(ids, batch.column(1)):
                yield row, number, data.as_py()
                row += 1


def part_batches(path: str, group: int, window: int, keys: np.ndarray) -> Iterator[tuple[Batch, np.ndarray]]:
    """The part in batches, each with the ids of its pieces."""
    pieces: list[tuple[int, int, bytes]] = []
    ids: list[int] = []
    size = 0
    for row, number, data in part_rows(path, group):
        for base in range(0, max(len(data) - window + 1, 1), BATCH_BYTES):
            pieces.append((row, base, data[base : base + BATCH_BYTES + window - 1]))
            ids.append(_NO_ID if number is None else number)
            size += len(pieces[-1][2])
            if size >= BATCH_BYTES:
                yield Batch(pieces, window, keys), np.array(ids, dtype=np.int64)
                pieces, ids, size = [], [], 0
    if pieces:
        yield Batch(pieces, window, keys), np.array(ids, dtype=np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each run of equal keys in that order)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else order


def digit_groups(grams: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, how many, surroundings that all share or ``_MIXED``) for each different gram."""
    order, starts = _runs(grams)
    if not len(order):
        return grams, np.zeros(0, dtype=np.int64), around
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    ranked = around[order]
    least, most = np.minimum.reduceat(ranked, starts), np.maximum.reduceat(ranked, starts)
    return grams[order][starts], sizes, np.where(least == most, least, _MIXED)


def later_members(high: np.ndarray, low: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which records have an equal key and a smaller (id, start) among the others."""
    order = np.lexsort((starts, ids, low, high))
    h, l, i, s = high[order], low[order], ids[order], starts[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    later = np.zeros(len(order), dtype=bool)
    later[order] = (i != i[head]) | (s != s[head])
    return later


def _blobs(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The columns cut by bucket, as bytes."""
    order, starts = _runs(bucket)
    ends = np.append(starts[1:], len(order))
    for start, end in zip(starts.tolist(), ends.tolist()):
        mine = order[start:end]
        yield int(bucket[mine[0]]), [column[mine].tobytes() for column in columns]


def _joined(column: pa.ChunkedArray, kind: str | np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def packed_spots(spots: np.ndarray, owner: np.ndarray) -> bytes:
    """Places and their documents' ids in few bytes: steps from place to place are small, and a document
    has many places."""
    at = spots["row"].astype(np.int64) << 40 | spots["start"]
    steps = np.diff(at, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T
    rows, first = np.unique(spots["row"], return_index=True)
    data = steps.tobytes() + spots["length"].tobytes() + rows.tobytes() + owner[first].tobytes()
    return np.array([len(spots), len(rows)], dtype="<u4").tobytes() + zlib.compress(data, 1)


def unpacked_spots(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    count, rows = np.frombuffer(blob[:8], dtype="<u4").astype(int)
    data = zlib.decompress(blob[8:])
    steps = np.frombuffer(data[: 8 * count], dtype=np.uint8).reshape(8, count)
    at = np.cumsum(np.ascontiguousarray(steps.T).view(np.int64)[:, 0])
    spots = np.zeros(count, dtype=_SPOT)
    spots["row"], spots["start"] = at >> 40, at & ((1 << 40) - 1)
    spots["length"] = np.frombuffer(data[8 * count : 12 * count], dtype="<u4")
    known = np.frombuffer(data[12 * count : 12 * count + 4 * rows], dtype="<u4")
    ids = np.frombuffer(data[12 * count + 4 * rows :], dtype="<i8")
    return spots, ids[np.searchsorted(known, spots["row"])]


def merged_spots(spots: np.ndarray) -> bytes:
    """The same bytes covered by as few places as can be, compressed."""
    found = removed_spans(spots)
    out = np.zeros(sum(map(len, found.values())), dtype=_SPOT)
    if len(out):
        runs = np.concatenate(list(found.values()))
        out["row"] = np.repeat(np.array(list(found), dtype=np.int64), [len(x) for x in found.values()])
        out["start"], out["length"] = runs[:, 0], runs[:, 1] - runs[:, 0]
    return zlib.compress(out.tobytes(), 1)


def removed_spans(spots: np.ndarray) -> dict[int, np.ndarray]:
    """Row -> maximal runs (start, end) of the bytes that the spots cover."""
    spots = spots[np.lexsort((spots["start"], spots["row"]))]
    rows, starts = spots["row"].astype(np.int64), spots["start"]
    ends = starts + spots["length"]
    found: dict[int, np.ndarray] = {}
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else []
    for head, tail in zip(heads, np.append(heads[1:], len(rows))):
        s, e = starts[head:tail], np.maximum.accumulate(ends[head:tail])
        fresh = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
        found[int(rows[head])] = np.stack([s[fresh], e[np.append(fresh[1:], len(s)) - 1]], axis=1)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, ``n_bytes``, ``n_removed``, ``spans``, ``kept``) of every row of ``docs``.

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a row with a
    smaller id, or at a smaller offset of a row with the same id. Strings are those of the input;
    overlapping ones count. ``spans`` are the maximal removed runs (start, end), ``kept`` the bytes
    that are left. Texts are whole, matches never cross texts.

    Nulls and edges: a null text is empty; texts shorter than the window lose nothing; a null id is
    larger than every id; rows that repeat an id count as one document (equal offsets are not
    earlier, so neither of two equal rows loses the other's bytes); an empty table gives an empty
    table. Only the id and text columns are read.

    The corpus is stored once in parts of about ``PART_BYTES`` (a row group of a file). What a part
    tells a bucket is at most one record per gram, so a passage that every document has costs a bucket
    one record per part. Records of suffixes are collapsed per batch in the same way.
    """
    if window < 2 * GRAM:
        raise ValueError(f"a window has at least {2 * GRAM} bytes")
    spark = docs.sparkSession
    folder = new_folder(spark, "repeats-texts")
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), data.alias("data"))
    texts.write.option("compression", "zstd").option("parquet.block.size", PART_BYTES).parquet(folder)
    stored = spark.read.schema("id long, data binary").parquet(folder)
    paths = sorted(stored.inputFiles())

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    meta = file.metadata
                    rows = [(path, at, meta.row_group(at).total_byte_size) for at in range(meta.num_row_groups)]
                yield _table(rows, ["path", "part_group", "size"], [pa.string(), pa.int32(), pa.int64()])

    listed = spark.createDataFrame([(path,) for path in paths], "path string").repartition(max(1, min(len(paths), 200)))
    found = listed.mapInArrow(groups, "path string, part_group int, size long").collect()
    where = sorted((row["path"], row["part_group"]) for row in found)
    size = sum(row["size"] for row in found)
    result = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    if not where:
        return spark.createDataFrame([], result).withColumnRenamed("id", id_col)
    parts = spark.sparkContext.broadcast(where)
    keys = drawn_keys()
    tasks = len(where)
    buckets = max(MIN_BUCKETS, size // BUCKET_BYTES)
    every_part = spark.range(0, tasks, 1, tasks).select(F.col("id").cast("int").alias("part"))

    def first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked in batches:
            for part in asked.column("part").to_pylist():
                grams, around = [], []
                for batch, _ in part_batches(*parts.value[part], window, keys):
                    anchors = batch.anchors()
                    grams.append(batch.digits(anchors))
                    around.append(batch.surroundings(anchors, 0))
                none = np.zeros(0, dtype=np.uint64)
                gram, _, shared = digit_groups(np.concatenate([none, *grams]), np.concatenate([none, *around]))
                bucket = (gram % np.uint64(buckets)).astype(np.int32)
                rows = [(number, part, *blobs) for number, blobs in _blobs(bucket, gram, shared)]
                yield _table(rows, ["bucket", "part", "grams", "around"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def repeated_digits(group: pa.Table) -> pa.Table:
        """The grams that several parts have, told to each of these parts."""
        gram, around = _joined(group["grams"], "<u8"), _joined(group["around"], "<u8")
        sizes = [len(blob) // 8 for blob in group["grams"].to_pylist()]
        part = np.repeat(np.array(group["part"].to_pylist(), dtype=np.int32), sizes)
        order, starts = _runs(gram)
        counts = np.diff(np.concatenate([starts, [len(order)]])) if len(order) else np.zeros(0, dtype=np.int64)
        ranked = around[order]
        mixed = np.minimum.reduceat(ranked, starts) != np.maximum.reduceat(ranked, starts) if len(order) else ranked == 0
        mixed = mixed | (ranked[starts] == _MIXED)
        several = np.repeat(counts > 1, counts)
        told, kind, to = gram[order][several], np.repeat(mixed, counts)[several].astype(np.uint8), part[order][several]
        rows = [(number, *blobs) for number, blobs in _blobs(to, told, kind)]
        return pa.Table.from_batches([_table(rows, ["part", "grams", "mixed"], [pa.int32(), pa.binary(), pa.binary()])])

    answers = (
        every_part.mapInArrow(first_digits, "bucket int, part int, grams binary, around binary")
        .repartition(buckets, "bucket")
        .groupBy("bucket")
        .applyInArrow(repeated_digits, "part int, grams binary, mixed binary")
    )
    silent = every_part.select("part", F.lit(b"").alias("grams"), F.lit(b"").alias("mixed"))

    record_names = ["bucket", "part", "high", "low", "spots"]
    record_types = [pa.int32(), pa.int32(), *[pa.binary()] * 3]

    def suffixes(group: pa.Table) -> Iterator[pa.RecordBatch]:
        """Records of the suffixes whose anchor occurs again, by bucket. Those that are not the first of
        their key in the batch are settled already: their places go to a bucket of the part's own."""
        part = group["part"][0].as_py()
        heard, kind = _joined(group["grams"], "<u8"), _joined(group["mixed"], np.uint8)
        order = np.argsort(heard, kind="stable")
        heard, kind = heard[order], kind[order].astype(bool)
        kept, grams, around = [], [], []
        for batch, _ in part_batches(*parts.value[part], window, keys):
            anchors = batch.anchors()
            kept.append(anchors)
            grams.append(batch.digits(anchors))
            around.append(batch.surroundings(anchors, 0))
        none = np.zeros(0, dtype=np.uint64)
        own, sizes, shared = digit_groups(np.concatenate([none, *grams]), np.concatenate([none, *around]))
        repeated, mixed = sizes > 1, shared == _MIXED
        if len(heard):
            at = np.minimum(np.searchsorted(heard, own), len(heard) - 1)
            hit = heard[at] == own
            repeated, mixed = repeated | hit, mixed | (hit & kind[at])
        for number, (batch, ids) in enumerate(part_batches(*parts.value[part], window, keys)):
            anchors, place = kept[number], np.searchsorted(own, grams[number])
            whole = {name: values[repeated[place] & ~mixed[place]] for name, values in anchors.items()}
            split = {name: values[repeated[place] & mixed[place]] for name, values in anchors.items()}
            counts = split["last"] - split["first"] + 1
            each = np.repeat(split["first"] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            at = np.concatenate([whole["first"], each])
            if not len(at):
                continue
            high = np.concatenate([batch.surroundings(whole, 0), batch.window_hash(each, 0)])
            low = np.concatenate([batch.surroundings(whole, 1), batch.window_hash(each, 1)])
            spots = np.zeros(len(at), dtype=_SPOT)
            spots["row"], spots["start"] = batch.places(at)
            spots["length"] = np.concatenate([whole["last"] - whole["first"], np.zeros(len(each), dtype=np.int64)]) + window
            owner = ids[np.searchsorted(batch.starts, at, side="right") - 1]
            later = later_members(high, low, owner, spots["start"])
            first = ~later
            high, low, owner, told, spots = high[first], low[first].astype("<u2"), owner[first], spots[later], spots[first]
            order, starts = _runs((high % np.uint64(buckets)).astype(np.int32))
            rows = []
            for start, end in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist()):
                mine = order[start:end]
                place = packed_spots(spots[mine], owner[mine])
                rows.append((int(high[mine[0]] % np.uint64(buckets)), part, high[mine].tobytes(), low[mine].tobytes(), place))
            rows.append((buckets + part, part, b"", b"", merged_spots(told)))
            yield _table(rows, record_names, record_types)

    def per_part(rows: DataFrame) -> DataFrame:
        """One group per part, in as many tasks as there are parts, however small the rows are."""
        return rows.repartition(tasks, "part").groupBy("part")

    records = per_part(answers.unionByName(silent)).applyInArrow(
        _whole_groups(suffixes, record_names, record_types),
        "bucket int, part int, high binary, low binary, spots binary",
    )

    def repeats(group: pa.Table) -> pa.Table:
        """The places of records that are not the first of their key."""
        if group["bucket"][0].as_py() >= buckets:
            return group.select(["part", "spots"])
        known = [unpacked_spots(blob) for blob in group["spots"].to_pylist()]
        spots, ids = (np.concatenate([pair[at] for pair in known]) for at in (0, 1))
        part = np.repeat(np.array(group["part"].to_pylist(), dtype=np.int32), [len(pair[0]) for pair in known])
        later = later_members(_joined(group["high"], "<u8"), _joined(group["low"], "<u2"), ids, spots["start"])
        spots, part = spots[later], part[later]
        rows = [(int(number), merged_spots(spots[part == number])) for number in np.unique(part)]
        return pa.Table.from_batches([_table(rows, ["part", "spots"], [pa.int32(), pa.binary()])])

    later = (
        records.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(repeats, "part int, spots binary")
    )
    unmarked = every_part.select("part", F.lit(b"").alias("spots"))
    out_names = ["id", "n_bytes", "n_removed", "spans", "kept"]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out_types = [pa.int64(), pa.int64(), pa.int64(), span_type, pa.binary()]

    def cut(group: pa.Table) -> Iterator[pa.RecordBatch]:
        part = group["part"][0].as_py()
        told = [zlib.decompress(blob) for blob in group["spots"].to_pylist() if blob]
        spans = removed_spans(np.frombuffer(b"".join(told), dtype=_SPOT))
        rows, held = [], 0
        for row, number, data in part_rows(*parts.value[part]):
            gone = spans.get(row)
            if gone is None:
                rows.append((number, len(data), 0, [], data))
            else:
                edges = [0, *gone.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                runs = [{"start": a, "end": b} for a, b in gone.tolist()]
                rows.append((number, len(data), len(data) - len(kept), runs, kept))
            held += len(data)
            if held >= BATCH_BYTES:
                yield _table(rows, out_names, out_types)
                rows, held = [], 0
        yield _table(rows, out_names, out_types)

    marked = later.unionByName(unmarked)
    return per_part(marked).applyInArrow(_whole_groups(cut, out_names, out_types), result).withColumnRenamed("id", id_col)


def _whole_groups(function, names: list[str], types: list[pa.DataType]):
    """A grouped function that may give its rows in several batches."""

    def run(group: pa.Table) -> pa.Table:
        schema = pa.schema(list(zip(names, types)))
        return pa.Table.from_batches(list(function(group)), schema)

    return run
