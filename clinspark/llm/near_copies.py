"""Near duplicates by similarity of shingle sets: SimHash groups first, an exact complement after them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.llm.common import discard, join_back, staged
from clinspark.llm.components import components
from clinspark.llm.simhash_tiles import majority, near_links, shingle_set

RADIUS = 8  # differing bits of 64 that put documents into one SimHash group
LOCAL_SHINGLES = 2_000_000  # shingle hashes that one task compares among themselves
BLOCK_SHINGLES = 250_000  # of open groups with more, blocks of about so many meet each other
HASHES_AT_A_TIME = 250_000  # shingle hashes that a task holds before it sends them
PART_BYTES = 16 << 20  # about so much text per part of the shingle hashes
QUICK_TESTS = 8  # tries to connect a document with its latest neighbours before all others are listed
SINGLE_TESTS = 300  # up to so many open pairs of a document are tested one by one


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(``id``, ``fingerprint``, ``_set``) of (``id``, ``_text``): SimHash over the different shingles, and
    their sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("id"), batch.column("_text")):
                different = shingle_set(text.as_py(), width)
                mark = majority([different], 1).view(np.int64)
                held = pa.array([np.sort(different.view(np.int64))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.int64()), pa.array(mark), held], ["id", "fingerprint", "_set"])

    return rows.select("id", "_text").mapInArrow(run, "id long, fingerprint long, _set array<long>")


def _shared_counts(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """(``id``, ``size``, ``shared``): for rows (``id``, ``text``) the number of different shingles, and
    how many of them, at least, another row has. Rows that share none are left out.

    Shingle hashes travel packed: the remainder by ``parts`` names the part, the upper 32 bits are
    compared in it. Two shingles that agree in both count as one, which can only raise ``shared``. A
    text without a shingle has the hash 0.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0

        def packed() -> pa.RecordBatch:
            sizes = np.array([len(one) for one in sets], dtype=np.int32)
            owner = np.repeat(np.arange(len(sets)), sizes)
            flat, names = np.concatenate(sets), np.array(ids, dtype=np.int64)
            part = (flat % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            owner, keys, part = owner[order], (flat[order] >> np.uint64(32)).astype("<u4"), part[order]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            out = []
            for start, end in zip(at, np.append(at[1:], len(part))):
                firsts = np.flatnonzero(np.diff(owner[start:end], prepend=-1))
                who = owner[start:end][firsts]
                lengths = np.diff(np.append(firsts, end - start)).astype(np.int32)
                out.append((int(part[start]), *(x.tobytes() for x in (names[who], sizes[who], lengths, keys[start:end]))))
            kinds = (pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "ids", "sizes", "lengths", "keys"])

        for batch in batches:
            for name, text in zip(batch.column("id"), batch.column("text")):
                different = shingle_set(text.as_py(), width)
                ids.append(name.as_py())
                sets.append(different if len(different) else np.zeros(1, dtype="<u8"))
                held += len(sets[-1])
                if held >= HASHES_AT_A_TIME:
                    yield packed()
                    ids, sets, held = [], [], 0
        if ids:
            yield packed()

    def count(group: pa.Table) -> pa.Table:
        def column(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(group[name].to_pylist()), dtype=kind)

        lengths, keys = column("lengths", "<i4"), column("keys", "<u4")
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        common = np.zeros(len(keys), dtype=np.int32)
        common[order[1:]] = same
        common[order[:-1]] |= same
        shared = np.add.reduceat(common, np.cumsum(lengths) - lengths)
        some = shared > 0
        columns = [column("ids", "<i8")[some], column("sizes", "<i4")[some], shared[some].astype(np.int32)]
        return pa.Table.from_arrays([pa.array(one) for one in columns], ["id", "size", "shared"])

    sent = rows.select("id", "text").mapInArrow(spread, "part long, ids binary, sizes binary, lengths binary, keys binary")
    counted = sent.groupBy("part").applyInArrow(count, "id long, size int, shared int")
    return counted.groupBy("id", "size").agg(F.sum("shared").alias("shared"))


def agree(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity; two empty ones have."""
    short, long = (one, two) if len(one) <= len(two) else (two, one)
    if len(short) < similarity * len(long):
        return False
    at = np.minimum(np.searchsorted(long, short), len(long) - 1) if len(long) else np.zeros(0, dtype=np.int64)
    shared = int(np.count_nonzero(long[at] == short)) if len(long) else 0
    return shared >= similarity * (len(one) + len(two) - shared)


def crossing(
    ids: np.ndarray, classes: np.ndarray, sets: list[np.ndarray], similarity: float, sides: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that, with the classes already known, connect what all pairs of at least ``similarity`` connect
    (of documents on different ``sides``, if they are given).

    Sets of that similarity share one of the first ``size - ceil(similarity * size) + 1`` shingles in
    any common order; rare ones first leaves few pairs. A pair is tested only while its two documents
    are not connected, and first a document meets its latest neighbours: in a group of alike
    documents each then costs one test, and every pair between different classes is still tested.
    """
    label = np.unique(classes, return_inverse=True)[1]
    if len(ids) < 2 or label.max() == 0:
        return []
    links: list[tuple[int, int]] = []
    sizes = np.array([len(one) for one in sets])

    def link(at: int, other: int) -> None:
        links.append((int(ids[at]), int(ids[other])))
        label[label == label[other]] = label[at]

    empty = np.flatnonzero(sizes == 0)  # sets without a shingle are alike
    for at in empty[1:]:
        link(int(at), int(empty[0]))
    owner = np.repeat(np.arange(len(ids)), sizes)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((token, often[token], owner))
    owner, token = owner[order], token[order]
    firsts = np.cumsum(sizes) - sizes
    ahead = np.arange(len(owner)) - firsts[owner] < (sizes - np.ceil(similarity * sizes - 1e-9) + 1)[owner]

    def postings(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return who[np.argsort(what, kind="stable")], np.searchsorted(np.sort(what), np.arange(len(often) + 1))

    every: tuple[np.ndarray, np.ndarray] | None = None
    front, front_at = postings(owner[ahead], token[ahead])
    met_until = front_at[:-1].copy()  # of each token, where the documents end that came before
    for at in range(len(ids)):
        mine = slice(firsts[at], firsts[at] + sizes[at])
        lead = token[mine][ahead[mine]]
        lead = lead[often[lead] > 1]
        tests = 0
        for latest in met_until[lead] - 1:
            other = int(front[latest])
            if other < at and tests < QUICK_TESTS and label[other] != label[at] and (sides is None or sides[other] != sides[at]):
                tests += 1
                if agree(sets[at], sets[other], similarity):
                    link(at, other)
        parts = (front[front_at[one] : until] for one, until in zip(lead, met_until[lead]))
        open_ones = [part[label[part] != label[at]] for part in parts]
        met_until[lead] += 1
        met = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *open_ones]))
        if sides is not None:
            met = met[sides[met] != sides[at]]
        small, large = np.minimum(sizes[met], sizes[at]), np.maximum(sizes[met], sizes[at])
        met = met[small >= similarity * large]
        if len(met) > SINGLE_TESTS:
            every = every or postings(owner, token)
            listed = [every[0][every[1][t] : every[1][t + 1]] for t in token[mine]]
            shared = np.bincount(np.concatenate(listed), minlength=len(ids))[met]
            met = met[shared >= similarity * (sizes[met] + sizes[at] - shared)]
        for other in met.tolist():
            if label[other] != label[at] and agree(sets[at], sets[other], similarity):
                link(at, other)
    return links


def _block_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (id, leader) that are missing between the classes of large components.

    ``members`` are (``id``, ``_component``, ``_class``, ``_set``). Classes of over ``BLOCK_SHINGLES``
    hashes are cut into blocks of their own, the others of a component share blocks; every two blocks
    of a component meet in a task, but for those of one class.
    """
    weight = F.size("_set") + 1
    weights = members.groupBy("_component", "_class").agg(F.sum(weight).alias("_weight"), F.count("*").alias("_rows"))
    open_ones = weights.groupBy("_component").agg(F.count("*").alias("_n")).filter("_n > 1").select("_component")
    weights = weights.join(open_ones, "_component")
    weights = weights.withColumn("_own", F.when(F.col("_weight") > BLOCK_SHINGLES, F.col("_class")))
    cuts = weights.groupBy("_component", "_own").agg(F.ceil(F.sum("_weight") / F.lit(BLOCK_SHINGLES)).cast("int").alias("_parts"))
    cuts = cuts.withColumnRenamed("_component", "_at").withColumnRenamed("_own", "_as")
    same = (F.col("_component") == F.col("_at")) & F.col("_own").eqNullSafe(F.col("_as"))
    known = weights.join(cuts, same).select("_class", F.col("_component").alias("_whole"), "_own", "_parts", "_rows")
    known = staged(known, "near-classes")
    blocks = (
        join_back(members.select("id", "_class", "_set"), known, "_class", "_rows", "id", "inner")
        .withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
        .groupBy("_whole", "_own", "_part")
        .agg(F.collect_list(F.struct("id", "_class", "_set")).alias("members"))
        .withColumn("block", F.monotonically_increasing_id())
    )
    blocks = staged(blocks, "near-blocks")
    keys = blocks.select("block", "_whole", "_own")
    other = keys.select(F.col("block").alias("to"), F.col("_whole").alias("_to_whole"), F.col("_own").alias("_to_own"))
    pairs = keys.join(other, (F.col("_whole") == F.col("_to_whole")) & (F.col("block") <= F.col("to"))).filter(
        "_own is null or _to_own is null or _own <> _to_own"
    )
    sources = blocks.select("block", F.col("members").alias("sources"))
    targets = blocks.select(F.col("block").alias("to"), F.col("members").alias("targets"))
    meeting = pairs.select("block", "to").join(sources, "block").join(targets, "to").select("block", "to", "sources", "targets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, to, source, target in zip(*batch.columns):
                held = [source.values] if block.as_py() == to.as_py() else [source.values, target.values]
                ids, classes = (np.concatenate([part.field(name).to_numpy() for part in held]) for name in ("id", "_class"))
                sets = [np.array(one.values) for part in held for one in part.field("_set")]
                sides = np.repeat(np.arange(2), [len(part) for part in held]) if len(held) > 1 else None
                links = crossing(ids, classes, sets, similarity, sides)
                columns = [pa.array([link[at] for link in links], pa.int64()) for at in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "leader"])

    return meeting.mapInArrow(run, "id long, leader long")


def _links_within(members: DataFrame, similarity: float) -> DataFrame:
    """Links between the documents of each (``_group``, ``_part``) of (``id``, ``_class``, ``_set``)."""

    def run(group: pa.Table) -> pa.Table:
        ids, classes = group["id"].to_numpy(), group["_class"].to_numpy()
        sets = [np.array(one.values) for part in group["_set"].chunks for one in part]
        links = crossing(ids, classes, sets, similarity)
        columns = [pa.array([link[at] for link in links], pa.int64()) for at in (0, 1)]
        return pa.Table.from_arrays(columns, ["id", "leader"])

    return members.select("_group", "_part", "id", "_class", "_set").groupBy("_group", "_part").applyInArrow(run, "id long, leader long")


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``_group``, ``_part``), with parts of up to about ``LOCAL_SHINGLES`` hashes, and the sizes
    (``_group``, ``_rows``, ``_parts``) of groups with several documents. ``members`` are (``id``,
    ``_group``, ``_weight``)."""
    parts = F.ceil(F.sum("_weight") / F.lit(max(LOCAL_SHINGLES, 1))).cast("int").alias("_parts")
    sizes = staged(members.groupBy("_group").agg(F.count("*").alias("_rows"), parts).filter("_rows > 1"), "near-sizes")
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_part")
    return join_back(members, sizes, "_group", "_rows", "id", "inner").select("id", "_group", part), sizes


def _classes(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(``id``, ``_class``) of all ``ids``: the least id that the links connect one with."""
    found = components(links.select(F.col("id").alias("left"), F.col("leader").alias("right")))
    known = found.select(F.col("node").alias("id"), F.col("component").alias("_class"))
    return staged(ids.select("id").join(known, "id", "left").select("id", F.coalesce("_class", "id").alias("_class")), "near-classes")


def _simhash_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links inside SimHash groups: documents whose fingerprints are connected over steps of at
    most ``RADIUS`` bits. Parts of large groups are compared in themselves, then the least documents of
    the classes of all their parts meet."""
    marks = staged(sets.groupBy("fingerprint").agg(F.count("*").alias("_rows")), "near-marks")
    linked = components(near_links(marks.select("fingerprint"), RADIUS))
    groups = marks.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "_rows", F.coalesce("component", "fingerprint").alias("_group")
    )
    weighed = sets.select("id", "fingerprint", (F.size("_set") + 1).alias("_weight"))
    members = join_back(weighed, staged(groups, "near-groups"), "fingerprint", "_rows", "id", "inner")
    dealt, sizes = _dealt(staged(members.select("id", "_group", "_weight"), "near-members"))
    dealt = staged(dealt, "near-dealt")
    own = F.col("id").alias("_class")
    first = staged(_links_within(sets.join(dealt, "id").select("*", own), similarity), "near-first")
    several = sizes.filter("_parts > 1").select("_group")
    if several.isEmpty():
        return first
    heads = _classes(dealt, first).filter("id = _class").select("id").join(dealt, "id").select("id", "_group")
    heads = heads.join(several, "_group", "left_semi").join(weighed.select("id", "_weight"), "id")
    again, _ = _dealt(staged(heads.select("id", "_group", "_weight"), "near-heads"))
    second = _links_within(sets.join(staged(again, "near-again"), "id").select("*", own), similarity)
    return first.unionByName(staged(second, "near-second"))


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(``id``, ``hash``): the shingles of each document that a similar one must share one of.

    Shingles are ordered by how many documents have them, rare ones first. Those that no other document
    has stand at the front and link nobody, so of the others only as many are needed as the document
    has beyond ``similarity`` of its size.
    """
    spread = sets.select("id", F.size("_set").alias("_size"), F.explode("_set").alias("hash"))
    often = staged(spread.groupBy("hash").agg(F.count("*").alias("_rows")).filter("_rows > 1"), "near-often")
    common = join_back(spread, often, "hash", "_rows", "id", "inner")
    listed = common.groupBy("id", "_size").agg(F.array_sort(F.collect_list(F.struct("_rows", "hash"))).alias("_shared"))
    needed = F.size("_shared") - F.ceil(F.lit(similarity) * F.col("_size") - 1e-9).cast("int") + 1
    return listed.select("id", F.explode(F.slice("_shared", 1, F.greatest(needed, F.lit(0)))).alias("_one")).select("id", F.col("_one.hash").alias("hash"))


def _open_links(sets: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Links between classes that are still apart, exactly.

    Two similar documents of different classes both have a prefix shingle of a posting that holds
    several classes. Only documents with such a shingle go on; the postings tie their classes into open
    groups, and the documents of an open group are compared in one task, or in pairs of blocks.
    """
    ahead = staged(_prefixes(sets, similarity).join(classes, "id"), "near-ahead")
    posted = ahead.groupBy("hash").agg(F.min("_class").alias("_least"), F.max("_class").alias("_most"), F.count("*").alias("_rows"))
    posted = staged(posted.filter("_least <> _most").select("hash", "_least", "_rows"), "near-open")
    met = staged(join_back(ahead, posted, "hash", "_rows", "id", "inner").select("id", "_class", "_least").distinct(), "near-met")
    tied = components(met.select(F.col("_class").alias("left"), F.col("_least").alias("right")).distinct())
    groups = tied.select(F.col("node").alias("_class"), F.col("component").alias("_group"))
    counts = met.select("id", "_class").distinct()
    rows = staged(counts.groupBy("_class").agg(F.count("*").alias("_rows")).join(groups, "_class"), "near-tied")
    members = staged(join_back(counts, rows, "_class", "_rows", "id", "inner").select("id", "_class", "_group"), "near-open-members")
    weighed = staged(members.join(sets.select("id", (F.size("_set") + 1).alias("_weight")), "id"), "near-weighed")
    dealt, sizes = _dealt(weighed)
    dealt = staged(dealt.join(members.select("id", "_class"), "id"), "near-open-dealt")
    small = sizes.filter("_parts <= 1").select("_group", "_rows")
    here = join_back(dealt, small, "_group", "_rows", "id", "left_semi")
    links = staged(_links_within(here.join(sets, "id"), similarity), "near-third")
    large = sizes.filter("_parts > 1").select("_group", "_rows")
    if large.isEmpty():
        return links
    there = join_back(dealt, large, "_group", "_rows", "id", "left_semi").join(sets, "id")
    blocks = staged(there.select("id", F.col("_group").alias("_component"), "_class", "_set"), "near-large")
    return links.unionByName(_block_links(blocks, similarity))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """(id, ``keep_id``) of the documents that share a group with another id; ids are longs.

    A group is what pairs of at least ``similarity`` connect, measured on the sets of ``width``-word
    shingles; no pair is lost, whatever the fingerprints say:

    1. Documents of that similarity share at least ``similarity`` of the shingles of each, so a document
       of which fewer occur in another one is out (``_shared_counts``, one shuffle of packed hashes).
    2. SimHash tiles group the others, and links inside the groups are verified (``_simhash_links``). This
       connects nearly all copies of a text at one test a document.
    3. What can still be missing are links between different classes of step 2. They are found by
       prefix filtering, rare shingles first (``_open_links``), and verified.

    There are no rounds: the number of jobs does not follow the size of a group but for the rounds of
    ``components``, which grow with the logarithm of a chain. Every pair is tested by the sets
    themselves, which are stored once; stages are deleted as soon as what follows them is written.

    Copies are found as well. Texts without words are alike. Rows with a null id are left out; rows
    that repeat an id are one document with the least of its texts; an empty table gives an empty one.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = max(16, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    shared = _shared_counts(rows, width, parts)
    asked = staged(shared.filter(F.col("shared") >= F.ceil(F.lit(similarity) * F.col("size") - 1e-9)).select("id").distinct(), "near-asked")
    one = rows.join(asked, "id").groupBy("id").agg(F.min("text").alias("_text"))
    sets = staged(_sets(one, width), "near-sets")
    discard(asked)
    blank = sets.filter(F.size("_set") == 0).select("id")
    same = blank.join(F.broadcast(blank.agg(F.min("id").alias("leader"))), F.col("id") > F.col("leader"))  # one row
    links = _simhash_links(sets, similarity).unionByName(staged(same, "near-blank"))
    classes = _classes(sets, links)
    links = links.unionByName(staged(_open_links(sets, classes, similarity), "near-rest"))
    discard(sets, classes)
    found = components(links.select(F.col("id").alias("left"), F.col("leader").alias("right")))
    return found.select(F.col("node").alias(id_col), F.col("component").alias("keep_id"))
