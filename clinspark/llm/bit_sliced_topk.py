"""Exact top-k by inner product over a bit-sliced index: bitmap arithmetic instead of row scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.llm.common import staged

BLOCK_ROWS = 32_768
QUERIES_PER_CHUNK = 4_096


def quantised(vector: str, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of every component as a long; null unless all components are finite."""
    finite = f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    scaled = f"transform({vector}, x -> cast(floor(cast({scale!r} as double) * cast(x as double)) as bigint))"
    return F.expr(f"CASE WHEN {finite} THEN {scaled} END")


class SlicedBlock:
    """Rows of one block as bitmaps: bit i of word w of a slice stands for row 64 * w + i.

    Per attribute the values are kept relative to their least one, so slices are unsigned; for queries
    with a negative weight there are the complements (greatest minus value).
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low, self.high = self.values.min(axis=0), self.values.max(axis=0)
        rows, width = self.values.shape
        self.words = -(-rows // 64)
        self.up = [self._slices(self.values[:, j] - self.low[j]) for j in range(width)]
        self.down = [self._slices(self.high[j] - self.values[:, j]) for j in range(width)]
        valid = np.zeros(self.words * 64, dtype=np.uint8)
        valid[:rows] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def _slices(self, column: np.ndarray) -> list[np.ndarray]:
        padded = np.zeros(self.words * 64, dtype=np.int64)
        padded[: len(column)] = column
        depth = int(padded.max()).bit_length()
        return [
            np.packbits(((padded >> bit) & 1).astype(np.uint8), bitorder="little").view(np.uint64)
            for bit in range(depth)
        ]

    def scores(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the non-negative weighted sum of all rows, and the constant to add to it.

        The weights' bits are taken from the most significant down (Horner): the sum is doubled by
        moving its slices up one place, then the attributes whose weight has the bit are added.
        """
        base = int((np.where(weights >= 0, self.low, self.high) * weights).sum())
        operands = [self.up[j] if weight >= 0 else self.down[j] for j, weight in enumerate(weights)]
        sizes = np.abs(weights)
        total: list[np.ndarray] = []
        spare = np.empty(self.words, dtype=np.uint64)
        for bit in range(int(sizes.max(initial=0)).bit_length() - 1, -1, -1):
            if total:
                total.insert(0, np.zeros(self.words, dtype=np.uint64))
            for j in np.flatnonzero((sizes >> bit) & 1):
                self._add(total, operands[j], spare)
        return total, base

    @staticmethod
    def _add(total: list[np.ndarray], slices: list[np.ndarray], spare: np.ndarray) -> None:
        """``total += slices`` for all rows at once: a ripple of full adders over bitmaps."""
        carry = None
        for place, addend in enumerate(slices):
            if place == len(total):
                total.append(addend.copy() if carry is None else addend ^ carry)
                carry = None if carry is None else addend & carry
                continue
            here = total[place]
            np.bitwise_xor(here, addend, out=spare)
            both = here & addend
            if carry is None:
                here[:] = spare
                carry = both
            else:
                np.bitwise_xor(spare, carry, out=here)
                spare &= carry
                both |= spare
                carry = both
        place = len(slices)
        while carry is not None and carry.any():
            if place == len(total):
                total.append(carry)
                return
            here = total[place]
            both = here & carry
            here ^= carry
            carry = both
            place += 1

    def top(self, weights: np.ndarray, k: int, exclude: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows, ties to the smaller id, ``exclude`` left out."""
        total, base = self.scores(weights)
        left = self.valid
        if exclude is not None:
            first, last = np.searchsorted(self.ids, [exclude, exclude + 1])
            if last > first:
                own = np.zeros(self.words * 64, dtype=np.uint8)
                own[first:last] = 1
                left = left & ~np.packbits(own, bitorder="little").view(np.uint64)
        sure = np.zeros(self.words, dtype=np.uint64)
        found = 0
        for piece in reversed(total):
            ones = left & piece
            count = int(np.bitwise_count(ones).sum())
            if found + count > k:
                left = ones  # more than enough rows have this bit: the rest is out
            else:
                sure |= ones  # all of them are in; the others compete on lower slices
                found += count
                left = left & ~piece
            if found == k:
                break
        rows = self._rows(sure)
        if found < k:  # the boundary: rows of one equal score, ids ascend with the row
            rows = np.concatenate([rows, self._rows(left)[: k - found]])
        return self.ids[rows], self.values[rows] @ weights

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
) -> DataFrame:
    """(``query_id``, ``rank`` from 1, id, ``score``): each query's ``k`` best rows by the inner
    product of the vectors quantised to ``floor(scale * x)``, the row itself left out.

    Rows are dealt evenly to blocks of at most ``BLOCK_ROWS`` and indexed as bit slices; queries are
    packed into chunks and every chunk meets every block once (a query set against all rows, in
    blocks). A block answers a query with bitmap sums and a descent from the most significant slice;
    rows that tie at the boundary are settled by id. The best of all blocks are then ranked.

    A quantised component outside int32 (``abs(x)`` from 2^23 on at the scale of 256) is an error.

    Nulls and edges: rows whose vector or id is null or has a null or non-finite component take no
    part; vectors of different lengths never meet (a query sees the rows of its own length); rows
    that repeat an id are candidates as often as they come, but never for a query with that id, and a
    query that is repeated is answered once; fewer than ``k`` candidates give fewer rows.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), is_query.alias("q")
    ).filter("id is not null and v is not null and size(v) > 0")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(width: int, parts: list) -> pa.RecordBatch:
            ids = np.concatenate([ids for ids, _ in parts])
            values = np.concatenate([values for _, values in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array([width]), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())],
                ["width", "ids", "vals"],
            )

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            lengths = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            starts = np.cumsum(lengths) - lengths
            for width in np.unique(lengths):
                mine = np.flatnonzero(lengths == width)
                values = flat[starts[mine][:, None] + np.arange(width)]
                if (values != values.astype(np.int32)).any():
                    raise OverflowError("a quantised component is outside int32")
                values = values.astype(np.int32)
                for at in range(0, len(mine), BLOCK_ROWS):
                    part = slice(at, at + BLOCK_ROWS)
                    parts = held.setdefault(int(width), [])
                    parts.append((ids[mine[part]], values[part]))
                    if sum(len(x) for x, _ in parts) >= BLOCK_ROWS:
                        yield block(int(width), held.pop(int(width)))
        for width, parts in held.items():
            yield block(width, parts)

    count = rows.count()
    blocks = max(1, -(-count // BLOCK_ROWS))
    kinds = "width long, ids binary, vals binary"
    stored = staged(
        rows.select("id", "v").repartition(blocks).mapInArrow(index, kinds).withColumn("block", F.monotonically_increasing_id()),
        "sliced-blocks",
    )
    asked = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    queries = asked.count()
    # Enough pieces of work for all cores if the table is small, full chunks if it is large.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-queries // QUERIES_PER_CHUNK), min(queries, -(-2 * cores // blocks)))
    packed = (
        asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
        .groupBy("chunk", F.size("v").cast("long").alias("width"))
        .agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    )
    packed = staged(packed, "query-chunks")
    # Every block goes to every chunk of its width as one piece of work of bounded size.
    sites = stored.select("block", "width").join(packed.select("chunk", "width"), "width").select("block", "chunk")
    sites = staged(sites, "query-sites")
    work = (
        sites.join(packed.select("chunk", "asked", F.col("width").alias("_wide")), "chunk")
        .join(stored, "block")
        .filter("width = _wide")
        .repartition(blocks * chunks, "block", "chunk")
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sliced = None, None
        for batch in batches:
            for place in range(batch.num_rows):
                number = batch.column("block")[place].as_py()
                if number != last:
                    ids = np.frombuffer(batch.column("ids")[place].as_py(), dtype=np.int64)
                    values = np.frombuffer(batch.column("vals")[place].as_py(), dtype=np.int32)
                    sliced = SlicedBlock(ids, values.reshape(len(ids), -1).astype(np.int64))
                    last = number
                out: tuple[list, list, list] = ([], [], [])
                for item in batch.column("asked")[place].as_py():
                    weights = np.array(item["v"], dtype=np.int64)
                    best, scores = sliced.top(weights, k, item["id"])
                    out[0].extend([item["id"]] * len(best))
                    out[1].extend(best.tolist())
                    out[2].extend(scores.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "id", "score"])

    found = work.select("block", "ids", "vals", "asked").mapInArrow(answer, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
