"""Benchmark decontamination: windows of test words in a broadcast hash set, verified hits, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.llm.common import staged

WINDOW = 10
# Beyond this the windows are joined without a broadcast: a hash relation takes about 100 bytes a row.
BROADCAST_BYTES, ROW_BYTES = 128 << 20, 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates words: all of ASCII but digits and letters.
GAPS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and no other letter; pure ASCII text takes the quicker way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words; null has none."""
    cut = F.split(lower_ascii(F.coalesce(text, F.lit(""))), f"[{GAPS}]+")
    return F.array_remove(cut, "")


def windows_of(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(``item``, ``length``, ``gram``): every ``window`` consecutive words of an item, all words of an item
    that has fewer (but not none). Words hold no space, so a gram is its words joined by spaces."""
    listed = items.select(F.col(f"`{item_col}`").alias("item"), words(F.col(f"`{text_col}`")).alias("w")).filter("size(w) > 0")
    length = listed.withColumn("length", F.least(F.size("w"), F.lit(window)))
    each = length.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)))
    return each.select("item", "length", F.expr("array_join(slice(w, at, length), ' ')").alias("gram")).distinct()


def scan(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (``at`` 0) per document with ``n_words`` and ``text_key``, and one per verified hit: ``row``,
    ``at`` (its first word, from 1), ``length`` and ``gram``.

    Documents are read once. Each window's hash is looked up in the hash set of ``grams`` (``length``,
    ``gram``, different); where it is found the words themselves are compared.
    """
    size = grams.agg(F.coalesce(F.sum(F.octet_length("gram") + ROW_BYTES), F.lit(0)), F.collect_set("length")).first()
    lengths = F.array(*[F.lit(n) for n in sorted(size[1])]) if size[1] else F.array().cast("array<int>")
    known = grams.select(F.col("gram").alias("known"), F.xxhash64(F.split("gram", " ")).alias("key"))
    known = F.broadcast(known) if size[0] <= BROADCAST_BYTES else known
    text = F.col(f"`{text_col}`")
    listed = docs.select(F.col(f"`{id_col}`").alias("id"), words(text).alias("w"), text.alias("body"))
    numbered = listed.select("id", "w", "body", F.monotonically_increasing_id().alias("row"))
    # Length 0 stands for the document itself.
    sized = numbered.withColumn("length", F.explode(F.concat(F.array(F.lit(0)), lengths)))
    last = F.when(F.col("length") == 0, 0).otherwise(F.size("w") - F.col("length") + 1)
    first = F.when(F.col("length") == 0, 0).otherwise(1)
    places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    each = sized.withColumn("at", F.explode(places))
    each = each.withColumn("key", F.when(F.col("at") > 0, F.expr("xxhash64(slice(w, greatest(at, 1), length))")))
    met = each.join(known, "key", "left")
    # A shared hash is not yet a hit: the words decide.
    here = F.array_join(F.expr("slice(w, at, length)"), " ")
    found = met.filter(F.when(F.col("at") > 0, F.col("known").isNotNull() & (here == F.col("known"))).otherwise(True))
    alone = F.col("at") == 0
    return found.select(
        "row",
        "id",
        "at",
        "length",
        F.when(alone, F.size("w").cast("long")).alias("n_words"),
        F.when(alone, F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256)).alias("text_key"),
        F.col("known").alias("gram"),
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``items``
    (ids of the items that have one, as sorted strings), ``spans`` (merged hits: ``first`` word, from 1,
    and the word after the last) and ``text_key`` (SHA-256 of the text).

    The windows are a hash set that every task holds (``BROADCAST_BYTES``; a larger test set is joined by
    a shuffle of the windows), the documents are read once, and what is stored of them are a narrow row
    each and one row per verified hit. Hits of a row are merged by a window over that row.

    Nulls and edges: a null text has no words; an item without words has no window; an item without an id
    marks words but is not listed; rows of ``items`` that repeat an id are one item; rows that repeat a
    document are looked at one by one; empty tables on either side give no hits. Only the named columns
    are read.
    """
    known = staged(windows_of(items, item_col, item_text, window), "clean-windows")
    grams = known.select("length", "gram").distinct()
    seen = staged(scan(docs, grams, id_col, text_col), "clean-hits")
    by_place = Window.partitionBy("row").orderBy("at", "length")
    reach = F.max(F.col("at") + F.col("length")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    hits = seen.filter("at > 0").select("row", "at", "length", F.coalesce(F.col("at") > reach, F.lit(True)).cast("int").alias("opens"))
    runs = hits.withColumn("run", F.sum("opens").over(by_place)).groupBy("row", "run").agg(
        F.min("at").alias("first"), F.max(F.col("at") + F.col("length")).alias("after")
    )
    merged = runs.groupBy("row").agg(
        F.sum(F.col("after") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "after"))).alias("spans")
    )
    met = seen.filter("at > 0").select("row", "gram").distinct()
    named = met.join(known.select("gram", F.col("item").cast("string").alias("item")), "gram").filter("item is not null")
    listed = named.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = seen.filter("at = 0").select("row", "id", "n_words", "text_key").join(merged, "row", "left").join(listed, "row", "left")
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first: int, after: int>>")).alias("spans"),
        "text_key",
    )


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and what stands before each of them."""
    units = F.regexp_extract_all(text, F.lit(f"[{GAPS}]*[^{GAPS}]+|[{GAPS}]+$"), 0)

    def kept(number: Column) -> Column:
        start = F.when(number == 0, 1).otherwise(F.get(spans, number - 1)["after"])
        end = F.when(number == F.size(spans), F.size(units) + 1).otherwise(F.get(spans, number)["first"])
        return F.slice(units, start, end - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), kept)), "")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    remove: str = "spans",
    id_col: str = "doc_id",
    text_col: str = "text",
    **options: object,
) -> DataFrame:
    """``docs`` without the words that ``contamination`` finds (``remove="spans"``) or without the documents
    that hold any (``remove="documents"``); all other rows and columns as they came.

    Findings meet their rows by id and SHA-256 of the text, so rows that repeat an id or have none are
    served each by its own text.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    found = contamination(docs, items, id_col, text_col, **options).filter("n_hit > 0")
    found = staged(found.select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")), "clean-found")
    found = found.dropDuplicates(["_id", "_key"])
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256) == F.col("_key"))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    cleaned = F.when(F.col("_spans").isNull(), text).otherwise(without_spans(text, F.col("_spans")))
    return docs.join(found, same, "left").select(*[cleaned.alias(name) if name == text_col else F.col(f"`{name}`") for name in docs.columns])
