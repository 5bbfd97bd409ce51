"""Mappings: minting replacements, counters, edits, renumbering, table form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.functions.text import as_column, entity_key, trim_spaces
from clinspark.operators.ordering import ordinal_within

TAG_SHAPE = r"^\[[A-Z]+_[0-9]+\]\z"
TAG_NUMBER = r"_([0-9]+)\]\z"


def tag(entity_type: Column | str, number: Column | str) -> Column:
    return F.format_string("[%s_%d]", as_column(entity_type), as_column(number))


def first_sightings(detections: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per entity (ignoring case) and scope; spelling, type and position of the first one."""
    return (
        detections.withColumn("entity", trim_spaces("entity"))
        .withColumn("_key", entity_key("entity"))
        .groupBy(*keys, "_key")
        .agg(F.min(F.struct(*order, "entity", "type")).alias("_first"))
        .select(*keys, "_first.*")
    )


def new_entities(detections: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Detections whose entity the mapping of their scope does not have yet, whatever its type."""
    known = mapping.select(*keys, entity_key("entity").alias("_key")).distinct()
    keyed = detections.withColumn("_key", entity_key("entity"))
    return keyed.join(known, [*keys, "_key"], "left_anti").drop("_key")


def rebuild_counters(mapping: DataFrame, keys: list[str]) -> DataFrame:
    """The highest number in use per scope and type."""
    number = F.regexp_extract("replacement", TAG_NUMBER, 1)
    return (
        mapping.withColumn("_number", F.nullif(number, F.lit("")).cast("bigint"))
        .filter(F.col("_number").isNotNull())
        .groupBy(*keys, "type")
        .agg(F.max("_number").alias("last_number"))
    )


def mint_replacements(
    sightings: DataFrame,
    keys: list[str],
    order: list[str],
    counters: DataFrame | None = None,
    small_scopes: bool = False,
) -> DataFrame:
    """Number the entities of each scope and type in order of first sighting.

    ``counters`` (keys, type, last_number) continues existing numbers. There are only about ten
    types, so numbering a large scope with a window would put a tenth of all rows into one task;
    ``ordinal_within`` does not. ``small_scopes`` asserts that a scope is one document or row, where
    a plain window is cheaper.
    """
    group = [*keys, "type"]
    if small_scopes:
        window = Window.partitionBy(*group).orderBy(*order)
        numbered = sightings.withColumn("number", F.row_number().over(window).cast("bigint"))
    else:
        numbered = ordinal_within(sightings, group, order, "number")
    if counters is not None:
        numbered = (
            numbered.join(counters, group, "left")
            .withColumn("number", F.col("number") + F.coalesce("last_number", F.lit(0)))
            .drop("last_number")
        )
    return numbered.withColumn("replacement", tag("type", "number"))


def _matching_column(names: list[str], words: tuple[str, ...]) -> str | None:
    return next(
        (name for name in names if any(word in name.lower().strip() for word in words)), None
    )


def mapping_from_table(df: DataFrame, row: str, seed_from_existing: bool = True) -> DataFrame:
    """A mapping from a table whose headers contain entity/original, type and optionally
    replacement/replace; ``row`` gives the row order.

    Types are upper-cased, blank rows skipped, blank replacements numbered per type in row order, and
    the last row of an entity wins. Numbers start after the highest number the table itself uses
    (``seed_from_existing=False`` starts at 1 and may repeat a number).
    """
    names = [name for name in df.columns if name != row]
    entity = _matching_column(names, ("entity", "original"))
    kind = _matching_column(names, ("type",))
    given = _matching_column(names, ("replacement", "replace"))
    if entity is None or kind is None:
        raise ValueError("a mapping table needs an entity column and a type column")

    def text(name: str | None) -> Column:
        return trim_spaces(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name else F.lit("")

    rows = df.select(
        F.col(row).alias("seq"),
        text(entity).alias("entity"),
        F.upper(text(kind)).alias("type"),
        text(given).alias("replacement"),
    ).filter((F.col("entity") != "") & (F.col("type") != ""))
    blank = rows.filter(F.col("replacement") == "").drop("replacement")
    named = rows.filter(F.col("replacement") != "")
    counters = rebuild_counters(named, []) if seed_from_existing else None
    minted = mint_replacements(blank, [], ["seq"], counters)
    every = named.unionByName(minted.select(*named.columns))
    return every.groupBy("entity").agg(
        F.max_by("type", "seq").alias("type"),
        F.max_by("replacement", "seq").alias("replacement"),
        F.min("seq").alias("seq"),
    )


def entity_inventory(mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Every replacement in use with its type (that of its first entry) and its number of entries."""
    return mapping.groupBy(*keys, "replacement").agg(
        F.min_by("type", "seq").alias("type"), F.count("*").alias("entities")
    )


def lookup_replacement_type(edits: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Edits with the type of the replacement group they alias; unaliased edits keep their type."""
    groups = entity_inventory(mapping, keys).select(
        *keys, "replacement", F.col("type").alias("_group_type")
    )
    joined = edits.join(groups, [*keys, "replacement"], "left")
    return joined.withColumn("type", F.coalesce("_group_type", "type")).drop("_group_type")


def edit_mapping(mapping: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Apply ordered edits (``edit_no``, ``op``, ``entity``, ``type``, ``replacement``) to a mapping.

    ``clear`` empties the scope, ``delete`` drops an entity, ``add`` sets type and replacement (at
    least two characters, not itself a tag), ``replace`` changes a replacement (blank is ignored),
    ``retype`` changes a type. A replacement that already names a group adopts that group's type.
    Only the last effect per entity counts, so the edits fold with one aggregation per table and no
    replay: clear and delete become cut-off numbers, the rest is ``max_by`` on the edit number.
    ``keys`` names the scope and must not be empty.
    """
    entity = trim_spaces(F.coalesce("entity", F.lit("")))
    wanted = trim_spaces(F.coalesce("replacement", F.lit("")))
    clean = edits.select(
        *keys,
        "edit_no",
        "op",
        entity.alias("entity"),
        F.upper(trim_spaces(F.coalesce("type", F.lit("MISC")))).alias("type"),
        F.nullif(wanted, F.lit("")).alias("replacement"),
    ).filter(
        (F.col("op").isin("clear", "delete", "retype"))
        | ((F.col("op") == "replace") & F.col("replacement").isNotNull())
        | (
            (F.col("op") == "add")
            & (F.length("entity") >= 2)
            & ~F.col("entity").rlike(TAG_SHAPE)
        )
    )
    # Numbers for additions without a replacement continue after the highest one in use.
    additions = clean.filter((F.col("op") == "add") & F.col("replacement").isNull())
    minted = mint_replacements(
        additions.drop("replacement"), keys, ["edit_no"], rebuild_counters(mapping, keys)
    ).select(*clean.columns)
    others = clean.filter((F.col("op") != "add") | F.col("replacement").isNotNull())
    named = lookup_replacement_type(
        others.filter(F.col("op").isin("add", "replace")), mapping, keys
    ).select(*clean.columns)
    groups = mapping.select(*keys, "replacement").distinct()
    aliased = others.join(groups, [*keys, "replacement"], "left_semi").select(*keys, "edit_no", F.lit(True).alias("aliased"))
    plain = others.filter(~F.col("op").isin("add", "replace"))
    every = (
        minted.unionByName(named)
        .unionByName(plain)
        .join(aliased, [*keys, "edit_no"], "left")
        .withColumn("aliased", F.coalesce("aliased", F.lit(False)))
    )

    def last(condition: Column, value: str) -> Column:
        return F.max_by(F.when(condition, F.col(value)), F.when(condition, F.col("edit_no")))

    cleared = every.filter("op = 'clear'").groupBy(*keys).agg(F.max("edit_no").alias("_cleared"))
    live = (
        every.filter("op <> 'clear'")
        .join(cleared, keys, "left")
        .filter(F.col("_cleared").isNull() | (F.col("edit_no") > F.col("_cleared")))
    )
    op, edit_no = F.col("op"), F.col("edit_no")
    window = [*keys, "entity"]
    deleted = live.filter("op = 'delete'").groupBy(*window).agg(F.max("edit_no").alias("_deleted"))
    after = live.filter("op <> 'delete'").join(deleted, window, "left").filter(
        F.col("_deleted").isNull() | (edit_no > F.col("_deleted"))
    )
    sets_tag = op.isin("add", "replace")
    sets_type = op.isin("add", "retype") | ((op == "replace") & F.col("aliased"))
    effects = after.groupBy(*window).agg(
        F.min(F.when(op == "add", edit_no)).alias("_added"),
        last(sets_tag, "replacement").alias("_replacement"),
        last(sets_type, "type").alias("_type"),
    )
    base = mapping.join(deleted, window, "left_anti")
    base = base.join(cleared, keys, "left_anti")
    merged = base.select(*keys, "entity", "type", "replacement", "seq").join(
        effects, window, "full_outer"
    )
    # An edit of an entity that neither exists nor is added changes nothing.
    exists = F.col("replacement").isNotNull() | F.col("_added").isNotNull()
    return merged.filter(exists).select(
        *keys,
        "entity",
        F.coalesce("_type", "type").alias("type"),
        F.coalesce("_replacement", "replacement").alias("replacement"),
        F.coalesce(F.col("seq"), F.col("_added") + F.lit(1_000_000_000_000)).alias("seq"),
    )


def renumber(
    mapping: DataFrame, texts: DataFrame, keys: list[str], text: str = "text"
) -> DataFrame:
    """Contiguous numbers per scope and type, in order of first (case-sensitive) occurrence in the
    scope's text. Entries that share a replacement keep sharing one; absent groups come last. A mapping
    that all texts share goes through ``renumber_shared``, which needs no text."""
    if not keys:
        raise ValueError("renumber needs a scope; see renumber_shared")
    never = F.lit(2**62)
    located = mapping.join(texts.select(*keys, text), keys, "left").withColumn(
        "_at", F.coalesce(F.nullif(F.instr(F.col(text), F.col("entity")), F.lit(0)).cast("bigint"), never)
    )
    groups = located.groupBy(*keys, "replacement").agg(
        F.min_by("type", "seq").alias("type"),
        F.min("_at").alias("_at"),
        F.min("seq").alias("_seq"),
    )
    numbered = ordinal_within(groups, [*keys, "type"], ["_at", "_seq"], "number")
    new_tags = numbered.select(*keys, "replacement", tag("type", "number").alias("_new"))
    return (
        mapping.join(new_tags, [*keys, "replacement"])
        .withColumn("replacement", F.col("_new"))
        .select(*mapping.columns)
    )


def renumber_shared(mapping: DataFrame, detections: DataFrame, order: list[str]) -> DataFrame:
    """Contiguous numbers per type in a mapping that all texts share, in the order in which ``detections``
    (entity and ``order`` columns) first name an entity, whatever its case.

    Entries that share a replacement keep sharing one; entries that no detection names come last. No text
    is read and nothing is joined into one: first places are minima that combine before the shuffle.
    """
    first = detections.groupBy(entity_key("entity").alias("_key")).agg(
        F.min(F.struct(*order)).alias("_first")
    )
    located = mapping.withColumn("_key", entity_key("entity")).join(first, "_key", "left")
    groups = located.groupBy("replacement").agg(
        F.min_by("type", "seq").alias("type"),
        F.min("_first").alias("_first"),
        F.min("seq").alias("_seq"),
    )
    places = [F.col(f"_first.{name}").alias(f"_at{number}") for number, name in enumerate(order)]
    placed = groups.select(
        "replacement", "type", F.col("_first").isNull().alias("_absent"), *places, "_seq"
    )
    by = ["_absent", *[f"_at{number}" for number in range(len(order))], "_seq"]
    numbered = ordinal_within(placed, ["type"], by, "number")
    new_tags = numbered.select("replacement", tag("type", "number").alias("_new"))
    return (
        mapping.join(new_tags, "replacement")
        .withColumn("replacement", F.col("_new"))
        .select(*mapping.columns)
    )


def mapping_table(mapping: DataFrame) -> DataFrame:
    """Entity, Type, Replacement; ordered by type."""
    return mapping.select(
        F.col("entity").alias("Entity"),
        F.col("type").alias("Type"),
        F.col("replacement").alias("Replacement"),
    ).orderBy("Type", "Entity")
