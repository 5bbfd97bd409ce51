"""Near duplicates by SimHash: every pair of fingerprints is compared in tiles, exactly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.llm.common import join_back, small_table, staged
from clinspark.llm.components import components

TILE = 16_384
LEFT_AT_A_TIME, RIGHT_AT_A_TIME = 64, 2_048  # comparisons whose working set stays in a core's cache
SHINGLES_AT_A_TIME = 65_536
_LOWER = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a whole text, in arrays of bounded size.

    A-Z are lower-cased, words are runs of non-space characters, shingles are ``width`` words joined
    by single spaces (all words if there are fewer), repeats included. No word: no shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = min(width, len(words)) - 1
    starts, ends = starts[: len(words) - last], ends[last:]
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_A_TIME):
        part = slice(at, at + SHINGLES_AT_A_TIME)
        values = [hashed(joined[a:b], seed) for a, b in zip(starts[part].tolist(), ends[part].tolist())]
        yield np.array(values, dtype="<u8")


def _spread(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 hash bits of shingles for ``lane`` > 0 (the finalizer of SplitMix64)."""
    if not lane:
        return hashes
    out = hashes + np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def fingerprint(text: str | None, width: int, lanes: int = 1, seed: int = 42) -> np.ndarray:
    """SimHash of a whole text, ``lanes`` times 64 bits: a bit is 1 if it is set in over half of the
    shingle hashes."""
    return majority(shingle_hashes(text, width, seed), lanes)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted different shingle hashes of a whole text."""
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *shingle_hashes(text, width)]))


def majority(parts: Iterable[np.ndarray], lanes: int) -> np.ndarray:
    counts, total = np.zeros((lanes, 64), dtype=np.int64), 0
    for hashes in parts:
        for lane in range(lanes):
            octets = _spread(hashes, lane).view(np.uint8).reshape(-1, 8)
            counts[lane] += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, ``fingerprint`` as a signed long), whole texts, one pass without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text.as_py(), width)[0] for text in batch.column("text")]
            marks = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks)], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


def linked_in_tile(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``left`` then ``right`` (both (n, lanes)) whose links connect what the pairs within
    ``radius`` bits connect, fewer than there are positions.

    All pairs are compared; a group of m alike fingerprints then needs m - 1 links, not m * m. The
    first two lanes rule out most pairs, the others are looked at for the rest.
    """
    label = np.arange(len(left) + len(right))
    lanes = [(left[:, lane].copy(), right[:, lane].copy()) for lane in range(left.shape[1])]
    for top in range(0, len(left), LEFT_AT_A_TIME):
        for at in range(0, len(right), RIGHT_AT_A_TIME):
            rows, columns = slice(top, top + LEFT_AT_A_TIME), slice(at, at + RIGHT_AT_A_TIME)
            differ = np.bitwise_count(lanes[0][0][rows, None] ^ lanes[0][1][None, columns])
            for one, two in lanes[1:2]:
                differ += np.bitwise_count(one[rows, None] ^ two[None, columns])
            near = differ <= radius
            if not near.any():
                continue
            i, j = np.nonzero(near)
            bits = differ[i, j].astype(np.int64)
            i, j = i + top, j + at
            for one, two in lanes[2:]:
                bits += np.bitwise_count(one[i] ^ two[j])
            i, j = i[bits <= radius], j[bits <= radius] + len(left)
            heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
            for head, tail in zip(heads, np.append(heads[1:], len(i))):
                classes = np.unique(np.append(label[j[head:tail]], label[i[head]]))
                if len(classes) > 1:
                    label[np.isin(label, classes)] = classes[0]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def tile_links(marks: DataFrame, met: list[tuple[int, int]], counts: dict[int, int], lanes: int, radius: int, tile: int) -> DataFrame:
    """Links (``left``, ``right``) between nodes that connect what fingerprints within ``radius`` bits
    connect.

    ``marks`` are (``node`` long, ``mark`` binary, ``cell`` int) with different marks; ``met`` are the
    pairs of cells (first <= second) that can hold such fingerprints, ``counts`` the nodes per cell.
    Cells are dealt to tiles of about ``tile`` nodes, and each pair of tiles of meeting cells is
    compared once, in a task of its own size.
    """
    spark = marks.sparkSession
    parts = {cell: -(-count // tile) for cell, count in counts.items()}
    cells = small_table(spark, list(parts.items()), {"cell": pa.int32(), "parts": pa.int32()})
    reach = small_table(spark, [(one, two, parts[two]) for one, two in met], dict.fromkeys(("cell", "to_cell", "to_parts"), pa.int32()))
    tiles = (
        marks.join(F.broadcast(cells), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int"))
        .groupBy("cell", "tile")
        .agg(F.collect_list(F.struct("node", "mark")).alias("members"))
    )
    tiles = staged(tiles, "simhash-tiles")
    sources = (
        tiles.join(F.broadcast(reach), "cell")
        .select("cell", "tile", F.col("members").alias("sources"), "to_cell", F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)).alias("to_tile"))
        .filter("to_cell > cell or to_tile >= tile")
    )
    targets = tiles.select(F.col("cell").alias("to_cell"), F.col("tile").alias("to_tile"), F.col("members").alias("targets"))

    def bits(members: pa.StructArray) -> np.ndarray:
        blob = b"".join(members.field("mark").to_pylist())
        return np.frombuffer(blob, dtype=">u8").astype(np.uint64).reshape(-1, lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, target in zip(batch.column("sources"), batch.column("targets")):
                one, two = source.values, target.values
                a, b = linked_in_tile(bits(one), bits(two), radius)
                nodes = np.concatenate([one.field("node").to_numpy(), two.field("node").to_numpy()])
                keep = nodes[a] != nodes[b]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a][keep]), pa.array(nodes[b][keep])], ["left", "right"])

    meeting = sources.join(targets, ["to_cell", "to_tile"]).select("sources", "targets")
    return meeting.mapInArrow(run, "left long, right long")


def near_links(marks: DataFrame, radius: int) -> DataFrame:
    """Links (``left``, ``right``) whose components are those of "at most ``radius`` bits differ".

    ``marks`` holds different 64-bit fingerprints. They are sorted into cells by the population counts
    of their two halves; a change of one bit changes one of the two counts by one, so cells whose
    counts differ by more than ``radius`` in sum hold no pair and their tiles never meet. The driver
    sees the number of fingerprints per cell, 33 x 33 numbers.
    """
    low = F.bit_count(F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned("fingerprint", 32))
    mark = F.unhex(F.lpad(F.hex("fingerprint"), 16, "0"))
    celled = marks.select(F.col("fingerprint").alias("node"), mark.alias("mark"), (low * 33 + high).cast("int").alias("cell"))
    counts = {row["cell"]: row["count"] for row in celled.groupBy("cell").count().collect()}
    met = [
        (one, two)
        for one in counts
        for two in counts
        if two >= one and abs(two // 33 - one // 33) + abs(two % 33 - one % 33) <= radius
    ]
    return tile_links(celled, met, counts, 1, radius, TILE)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """(id, ``fingerprint`` long, ``component_id``): the smallest id reachable over links between
    fingerprints that differ in at most ``radius`` bits.

    Texts with one fingerprint are one node, so a group of copies costs as much as one text. Tiles
    give spanning links, components are joined out by stored tables, and ids come back through a
    look-up that splits hot fingerprints.

    Nulls and edges: a null text and a text without words have fingerprint 0 and are linked like any
    other; a null id gets the component of its fingerprint (null if no row there has an id); repeated
    rows come back as often as they came; an empty table gives an empty table. Only the id and text
    columns are read, so other columns' names do not matter.
    """
    rows = staged(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = staged(
        rows.groupBy("fingerprint").agg(F.min(id_col).alias("_first"), F.count("*").alias("_rows")), "simhash-nodes"
    )
    linked = components(near_links(nodes.select("fingerprint"), radius))
    members = nodes.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), "_first", "_rows"
    )
    members = staged(members, "simhash-members")
    heads = members.groupBy("component").agg(F.min("_first").alias("component_id"))
    named = staged(members.join(heads, "component").select("fingerprint", "component_id", "_rows"), "simhash-named")
    return join_back(rows, named, "fingerprint", "_rows", id_col, "inner").select(
        id_col, "fingerprint", "component_id"
    )
