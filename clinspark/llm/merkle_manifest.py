"""Merkle manifest of a data set: few stored levels, inner nodes made again where a proof needs them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.llm.common import staged

FAN = 16  # nodes that become one
KEEP_EVERY = 2  # levels between two stored ones: a stored node stands for FAN ** KEEP_EVERY stored nodes
BLOCK = FAN**KEEP_EVERY
ROWS_PER_RANGE = 500_000
IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: the lower 33 bits count the rows of a partition
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# One entry per level, from the leaf up: the node's place in its run and the digests of the run's other nodes.
PATH = "array<struct<at: int, others: binary>>"
PATH_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(value) for value in values]).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def joined_digest(digests: list[bytes]) -> bytes:
    """The node over ``digests``: the hash of their lower-case hexadecimal digits."""
    return hashlib.sha256("".join(map(bytes.hex, digests)).encode()).digest()


def inner_levels(digests: list[bytes]) -> list[list[bytes]]:
    """The levels from ``digests`` up to where ``KEEP_EVERY`` of them are done or one node is left."""
    levels = [digests]
    while len(levels) <= KEEP_EVERY:
        below = levels[-1]
        levels.append([joined_digest(below[at : at + FAN]) for at in range(0, len(below), FAN)])
    return levels


def steps(size: int) -> int:
    """How many levels lie between the nodes of a tree with ``size`` of them and its next stored level."""
    done = 0
    while done < KEEP_EVERY and size > 1:
        size, done = -(-size // FAN), done + 1
    return done


def siblings(levels: list[list[bytes]], at: int, count: int) -> list[tuple[int, bytes]]:
    """The path of node ``at`` through the first ``count`` levels of its subtree."""
    path = []
    for level in levels[:count]:
        first = at - at % FAN
        path.append((at % FAN, b"".join(level[first:at] + level[at + 1 : first + FAN])))
        at //= FAN
    return path


def proof_digest(path: list[tuple[int, bytes]]) -> str:
    return hashlib.sha256("".join(others.hex() for _, others in path).encode()).hexdigest()


def folded(leaf: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for at, others in path:
        cut = 32 * at
        leaf = hashlib.sha256((others[:cut].hex() + leaf.hex() + others[cut:].hex()).encode()).digest()
    return leaf


def placed(nodes: DataFrame, order: list[str], rows: int, name: str) -> DataFrame:
    """``nodes`` (``tree``, ...) with ``pos``, their place in the ``order`` of their tree, and ``size``,
    the tree's number of nodes.

    Nodes are dealt to ranges of (tree, order), whatever share of them one tree holds, counted inside
    the range as it is written and shifted by what earlier ranges hold of the tree. Nodes that agree in
    tree and order may come in any order among themselves, so ``order`` should end in the digest.
    """
    ranges = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    dealt = nodes.repartitionByRange(ranges, "tree", *order).sortWithinPartitions("tree", *order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION))
    dealt = staged(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_local", local), name)
    # As many rows as there are ranges and trees.
    spans = dealt.groupBy("tree", "_range").agg(F.min("_local").alias("_first"), F.count("*").alias("_rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = spans.select(
        "tree",
        "_range",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(tree).alias("size"),
    )
    found = dealt.join(shifts, ["tree", "_range"]).withColumn("pos", F.col("_local") + F.col("_shift"))
    return found.drop("_range", "_local", "_shift")


def _blocks(nodes: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """The aligned subtrees below the next stored level: at most ``BLOCK`` nodes a row."""
    return (
        nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
        .groupBy("tree", "size", "block")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *carried))).alias("nodes"))
    )


def _risen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests = [], []
        for size, nodes in zip(batch.column("size").to_pylist(), batch.column("nodes")):
            done = steps(size)
            digests.append(inner_levels(nodes.values.field("digest").to_pylist())[done][0])
            sizes.append(-(-size // FAN**done))
        columns = [batch.column("tree"), pa.array(sizes, pa.int64()), batch.column("block"), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "size", "pos", "digest"])


def stored_levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` (``tree``, ``size``, ``pos``, ``digest``) and every ``KEEP_EVERY``-th level over them, as
    tables. A tree ends with its row of ``size`` 1.

    The driver sees one truth value per stored level.
    """
    levels = [nodes]
    while len(levels) == 1 or not levels[-1].filter("size > 1").isEmpty():
        below = nodes if len(levels) == 1 else levels[-1].filter("size > 1")
        risen = _blocks(below).mapInArrow(_risen, "tree string, size long, pos long, digest binary")
        levels.append(staged(risen, name))
    return levels


def ends(levels: list[DataFrame]) -> DataFrame:
    """(``tree``, ``digest``): what remains of each tree."""
    found = levels[1].filter("size = 1")
    for level in levels[2:]:
        found = found.unionByName(level.filter("size = 1"))
    return found.select("tree", "digest")


def _block_paths(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes, pa.StructArray, list]]:
    """Tree, its end, nodes and their paths of each aligned subtree. The inner nodes are made again from
    the stored ones, their digests given out as siblings, and dropped with the subtree."""
    names = ("tree", "size", "nodes", "above", "end")
    for tree, size, nodes, above, end in zip(*(batch.column(name) for name in names)):
        levels = inner_levels(nodes.values.field("digest").to_pylist())
        count = steps(size.as_py())
        upper = [(step["at"], step["others"]) for step in above.as_py()]
        paths = [siblings(levels, at, count) + upper for at in range(len(levels[0]))]
        yield tree.as_py(), end.as_py(), nodes.values, paths


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (tree, pos, [{"at": at, "others": others} for at, others in path], end)
            for tree, end, nodes, paths in _block_paths(batch)
            for pos, path in zip(nodes.field("pos").to_pylist(), paths)
        ]
        kinds = (pa.string(), pa.int64(), PATH_ARROW, pa.binary())
        columns = [pa.array([row[at] for row in rows], kind) for at, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "pos", "above", "end"])


def blocks_with_paths(levels: list[DataFrame], roots: DataFrame, carried: tuple[str, ...], name: str) -> DataFrame:
    """The aligned subtrees of ``levels[0]`` with the path ``above`` them, found level by level from the
    top. ``roots`` (``tree``, ``above``, ``end``) has the path over each tree and the tree's end."""
    lower = None
    for depth in range(len(levels) - 1, 0, -1):
        paths = levels[depth].filter("size = 1").select("tree", "pos").join(roots, "tree")
        paths = paths if lower is None else paths.unionByName(lower)
        below = levels[depth - 1] if depth == 1 else levels[depth - 1].filter("size > 1")
        blocks = _blocks(below, carried if depth == 1 else ()).withColumnRenamed("block", "pos").join(paths, ["tree", "pos"])
        if depth > 1:
            lower = staged(blocks.mapInArrow(_lowered, f"tree string, pos long, above {PATH}, end binary"), name)
    return blocks


@dataclass(frozen=True)
class Manifest:
    """The stored levels of the trees of all sources and of the tree over their ends, and its root."""

    sources: list[DataFrame]
    top: list[DataFrame]
    root: bytes

    def nodes(self) -> DataFrame:
        """All stored nodes: (``forest``, ``depth``, ``tree``, ``size``, ``pos``, ``digest``)."""
        found = None
        for forest, levels in (("sources", self.sources), ("top", self.top)):
            for depth, level in enumerate(levels):
                rows = level.select(
                    F.lit(forest).alias("forest"), F.lit(depth * KEEP_EVERY).alias("depth"), "tree", "size", "pos", "digest"
                )
                found = rows if found is None else found.unionByName(rows)
        return found


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: (``source``, ``id``, ``digest`` binary, further columns to carry).

    Leaves of a source ascend by id (null first), those that share an id by digest; every ``FAN``
    consecutive nodes become one until one is left, and so do the sources' ends, by source (null first,
    bytewise). Only every ``KEEP_EVERY``-th level is written. Rows that are the same leaf are told apart
    by their place alone, so which of them comes first does not matter.
    """
    tree = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    stored = staged(leaves.withColumn("tree", tree).drop("source"), "merkle-leaves")
    nodes = staged(placed(stored, ["id", "digest"], stored.count(), "merkle-ranges"), "merkle-placed")
    sources = stored_levels(nodes, "merkle-level")
    found = ends(sources).select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest")
    found = staged(found, "merkle-ends")
    over = staged(placed(found, ["id"], found.count(), "merkle-top-ranges"), "merkle-top")
    top = stored_levels(over, "merkle-top-level")
    last = ends(top).first()
    return Manifest(sources, top, last["digest"] if last else b"")


def proofs(manifest: Manifest, tampered: str) -> DataFrame:
    """(``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``) per leaf.

    A proof lists the digests of the run's other nodes, level by level from the leaf to the root; the
    folded root is made from them and the digest in the carried column ``tampered`` (null: the leaf's
    own). Paths come down level by level; below a stored node the inner ones are made again.
    """
    spark = manifest.top[0].sparkSession
    root = manifest.root
    kind = manifest.sources[0].schema["id"].dataType.simpleString()
    start = spark.createDataFrame([("", [], root)], f"tree string, above {PATH}, end binary")

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, nodes, paths in _block_paths(batch):
                above = pa.array([[{"at": at, "others": others} for at, others in path] for path in paths], PATH_ARROW)
                yield pa.RecordBatch.from_arrays([nodes.field("id"), above, nodes.field("digest")], ["tree", "above", "end"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, end, nodes, paths in _block_paths(batch):
                leaves = nodes.field("digest").to_pylist()
                given = [one or leaf for one, leaf in zip(nodes.field(tampered).to_pylist(), leaves)]
                roots = [folded(leaf, path) for leaf, path in zip(given, paths)]
                texts = (
                    [leaf.hex() for leaf in leaves],
                    [end.hex()] * len(leaves),
                    [root.hex()] * len(leaves),
                    [proof_digest(path) for path in paths],
                    [one.hex() for one in roots],
                )
                columns = [nodes.field("id"), *(pa.array(text, pa.string()) for text in texts), pa.array([one == root for one in roots], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [column.split()[0] for column in OUT])

    over = blocks_with_paths(manifest.top, start, ("id",), "merkle-top-paths")
    roots = staged(over.mapInArrow(sources, f"tree string, above {PATH}, end binary"), "merkle-sources")
    blocks = blocks_with_paths(manifest.sources, roots, ("id", tampered), "merkle-paths")
    return blocks.mapInArrow(rows, f"id {kind}, " + ", ".join(OUT[1:]))


OUT = ("id", "leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string", "verified boolean")


def merkle_proofs(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tamper: Column | None = None,
) -> DataFrame:
    """The manifest of ``docs`` and a proof for every row (see ``proofs``; ``id`` under the name ``id_col``).

    A leaf is the hash of its ``fields``. Where ``tamper`` (over columns of ``docs``) holds, the proof is
    folded from the row with A-Z of the text lower-cased.

    Nulls and edges: a null field is ``-``; a null id comes first in its source, a null source is a
    source of its own before all others; repeated rows are leaves of their own; an empty table has no
    root and gives an empty table. Only the named columns are read.
    """
    names = dict.fromkeys((id_col, source_col, text_col, *fields))
    own = {name: F.col(f"`{name}`") for name in names}
    changed = own | {text_col: lower_ascii(own[text_col])}
    leaves = docs.select(
        own[source_col].alias("source"),
        own[id_col].alias("id"),
        leaf_digest(*(own[name] for name in fields)).alias("digest"),
        F.when(F.lit(False) if tamper is None else tamper, leaf_digest(*(changed[name] for name in fields))).alias("tampered"),
    )
    return proofs(build(leaves), "tampered").withColumnRenamed("id", id_col)
