"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.llm.common import SPACES, Hidden, join_back, staged

PREFIX_CHARS = 64
# One bit per class of a refinement step; 2**26 bits are at most 17 MB of (word, mask) rows.
MIN_BITS, MAX_BITS, WORD = 2**20, 2**26, 63


def normalised(text: str) -> Column:
    """Every run of white space as one space; null as the empty text. Single spaces are no match, so a
    text that has nothing else comes back as it is."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"[\x09-\x0D][{SPACES}]*|\x20[{SPACES}]+", " ")


def _bit(number: Column, bits: int) -> Column:
    return F.pmod(number, F.lit(bits).cast("long"))


def class_marks(classes: DataFrame, number: Column, bits: int) -> DataFrame:
    """The classes with more than one row as bit masks: ``bits / WORD`` rows at most."""
    bit = _bit(number, bits)
    mask = F.expr(f"shiftleft(1L, cast(_place % {WORD} as int))")
    return (
        classes.filter("_rows > 1")
        .select(bit.alias("_place"))
        .select((F.expr(f"_place div {WORD}")).alias("_word"), mask.alias("_mask"))
        .groupBy("_word")
        .agg(F.bit_or("_mask").alias("_mask"))
    )


def with_mark(df: DataFrame, marks: DataFrame, number: Column, bits: int, out: str) -> DataFrame:
    """Flag the rows whose class is marked. The masks are bounded by ``bits``, so broadcast."""
    found = df.withColumn("_place", _bit(number, bits)).withColumn("_word", F.expr(f"_place div {WORD}"))
    hit = F.expr(f"(shiftright(_mask, cast(_place % {WORD} as int)) & 1) = 1")
    return (
        found.join(F.broadcast(marks), "_word", "left")
        .withColumn(out, F.coalesce(hit, F.lit(False)))
        .drop("_word", "_place", "_mask")
    )


def bits_for(classes: DataFrame) -> int:
    several = classes.filter("_rows > 1").count()
    bits = MIN_BITS
    while bits < MAX_BITS and bits < 8 * several:
        bits *= 2
    return bits


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_all: bool = False,
    with_text: bool = True,
) -> DataFrame:
    """Adds ``keep_id``, ``group_size``, ``kept`` and ``full_hash`` to every row of ``docs``.

    Texts are equal if they are the same after replacing each run of white space by one space; the
    row with the smallest id stays. 1. Rows are counted per length. 2. Rows of a length that occurs
    more than once are counted per (length, hash of the first characters). 3. Only rows of a pair
    that occurs more than once have their whole text hashed (SHA-256) and grouped. The classes that
    go on to the next step are broadcast as bit masks of bounded size: two classes that share a bit
    both go on, which costs a hash and changes nothing. Texts themselves are never shuffled unless
    they go through step 3.

    Nulls and edges: a null text is the empty text; a null id counts as larger than every id; rows
    that repeat the smallest id with the same text are all kept (they are one document); an empty
    table gives an empty table. Input columns named like the added ones are replaced.
    ``full_hash`` is null for rows that were told apart earlier unless ``hash_all`` asks for it.
    Without ``with_text`` the text column is left out of the result; the rows with their hashes are then
    stored once, and texts are read twice instead of four times.
    """
    hidden = Hidden(docs, ("keep_id", "group_size", "kept", "full_hash"))
    carried = [name for column, name in hidden.own.items() if with_text or column != text_col]
    base = docs.select(*hidden.columns())
    own, text = F.col(hidden.own[id_col]), normalised(hidden.own[text_col])
    length = F.length(text).cast("long")
    prefix = F.xxhash64(length, F.substring(text, 1, PREFIX_CHARS))

    sizes = staged(base.select(length.alias("_length"), prefix.alias("_prefix")), "dedup-sizes")
    lengths = staged(sizes.groupBy("_length").agg(F.count("*").alias("_rows")), "dedup-lengths")
    bits = bits_for(lengths)
    by_length = class_marks(lengths, F.col("_length"), bits)
    prefixes = (
        with_mark(sizes, by_length, F.col("_length"), bits, "_go")
        .filter("_go")
        .groupBy("_length", "_prefix")
        .agg(F.count("*").alias("_rows"))
    )
    prefixes = staged(prefixes, "dedup-prefixes")
    bits = bits_for(prefixes)
    by_prefix = staged(class_marks(prefixes, F.col("_prefix"), bits), "dedup-marks")
    full = F.sha2(F.encode(text, "UTF-8"), 256)
    if with_text:
        rows = with_mark(base, by_prefix, prefix, bits, "_go")
    else:
        # The normalised text is one column, which prefix and hash share.
        read = base.select(*carried, text.alias("_body"))
        length = F.length("_body").cast("long")
        marked = with_mark(read, by_prefix, F.xxhash64(length, F.substring("_body", 1, PREFIX_CHARS)), bits, "_go")
        whole = F.sha2(F.encode("_body", "UTF-8"), 256)
        narrow = marked.select(*carried, "_go", (whole if hash_all else F.when(F.col("_go"), whole)).alias("_hash"))
        rows, full = staged(narrow, "dedup-hashed"), F.col("_hash")
    hashed = rows.filter("_go").withColumn("full_hash", full).drop("_go")
    groups = hashed.groupBy("full_hash").agg(F.min(own).alias("keep_id"), F.count("*").alias("group_size"))
    groups = staged(groups, "dedup-groups")
    alone = rows.filter("not _go").select(
        *carried,
        own.alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        (full if hash_all else F.lit(None).cast("string")).alias("full_hash"),
    )
    grouped = join_back(hashed, groups, "full_hash", "group_size", own, "inner").select(
        *carried, "keep_id", "group_size", own.eqNullSafe(F.col("keep_id")).alias("kept"), "full_hash"
    )
    back = [F.col(own).alias(name) for name, own in hidden.own.items() if own in carried]
    return alone.unionByName(grouped).select(*back, "keep_id", "group_size", "kept", "full_hash")
