"""Applying a mapping to texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.functions.text import as_column, let, quoted
from clinspark.session import cut_lineage, shuffled

_LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
# Private-use characters that stand for a tag while a single-pass rewrite is under way. None of them
# is a letter or digit, so word boundaries next to them behave like boundaries next to punctuation.
_OPEN, _CLOSE = "\ue000", "\ue001"
_DIGITS = "".join(chr(0xE010 + digit) for digit in range(10))


def entity_pattern(entity: Column | str) -> Column:
    """Case-insensitive pattern of an entity, with letter/digit boundaries on the sides where the
    entity itself has a letter or digit."""
    entity = as_column(entity)
    before = F.when(entity.rlike(f"^{_LETTER_OR_DIGIT}"), f"(?<!{_LETTER_OR_DIGIT})").otherwise("")
    after = F.when(entity.rlike(rf"{_LETTER_OR_DIGIT}\z"), f"(?!{_LETTER_OR_DIGIT})").otherwise("")
    return F.concat(F.lit("(?iu)"), before, quoted(entity), after)


def _literal_replacement(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def _token(index: Column) -> Column:
    digits = F.translate(index.cast("string"), "0123456789", _DIGITS)
    return F.concat(F.lit(_OPEN), digits, F.lit(_CLOSE))


def longest_first(entries: Column) -> Column:
    """An array of (entity, replacement, seq, …) structs by descending length, then ``seq``."""
    keyed = F.transform(
        entries,
        lambda item: F.struct(
            (-F.length(item["entity"])).alias("shorter"),
            item["seq"].alias("seq"),
            item["entity"].alias("entity"),
            item["replacement"].alias("replacement"),
        ),
    )
    return F.array_sort(keyed)


def anonymize_text(text: Column | str, entries: Column | str, mode: str = "sequential") -> Column:
    """Rewrite ``text`` with an array of (entity, replacement, seq) structs, longest entity first.

    ``sequential`` rewrites entry by entry, so a short entity can also match inside a tag inserted
    earlier (entity ``PERSON`` inside ``[PERSON_1]``); ``single_pass`` protects inserted tags.
    """
    text, ordered = as_column(text), longest_first(as_column(entries))
    if mode == "sequential":
        return F.aggregate(
            ordered,
            text,
            lambda result, item: F.regexp_replace(
                result, entity_pattern(item["entity"]), _literal_replacement(item["replacement"])
            ),
        )
    if mode != "single_pass":
        raise ValueError(f"unknown mode {mode!r}")
    numbered = F.transform(
        ordered,
        lambda item, index: F.struct(
            entity_pattern(item["entity"]).alias("pattern"),
            _token(index).alias("token"),
            item["replacement"].alias("replacement"),
        ),
    )

    def rewrite(items: Column) -> Column:
        protected = F.aggregate(
            items,
            text,
            lambda result, item: F.regexp_replace(result, item["pattern"], item["token"]),
        )
        return F.aggregate(
            items,
            protected,
            lambda result, item: F.replace(result, item["token"], item["replacement"]),
        )

    return let(numbered, rewrite)


def entries_by_key(mapping: DataFrame, keys: list[str], out: str = "entries") -> DataFrame:
    """One row per scope with the array ``anonymize_text`` takes."""
    entry = F.struct("entity", "replacement", "seq")
    return mapping.groupBy(*keys).agg(F.collect_list(entry).alias(out))


def apply_scoped_mapping(
    texts: DataFrame,
    mapping: DataFrame,
    keys: list[str],
    text: str = "text",
    out: str = "anonymized_text",
    mode: str = "sequential",
) -> DataFrame:
    """Rewrite every text with the entries of its own scope (one equi-join on the scope).

    Use this where a scope is a document, row or session, so that a scope's entries fit in a row.
    """
    joined = texts.join(entries_by_key(mapping, keys), keys, "left")
    rewritten = anonymize_text(F.col(text), F.col("entries"), mode)
    return joined.withColumn(
        out, F.when(F.col("entries").isNull(), F.col(text)).otherwise(rewritten)
    ).drop("entries")


def letter_runs(text: Column | str) -> Column:
    """The runs of letters and digits of a text in lower case, in order."""
    return F.array_remove(F.split(F.lower(as_column(text)), r"[^\p{L}\p{N}]+"), "")


# An entity is looked up by its first runs, at most LEAD of them, and compared on up to COMPARED.
LEAD, COMPARED = 3, 16
# Bits of the mask that prunes places before anything is shuffled: about 64 bytes per 63 bits at most.
MIN_MASK_BITS, MAX_MASK_BITS, MASK_WORD = 2**16, 2**24, 63


def _word_and_pattern(keyed: DataFrame, bits: int) -> DataFrame:
    """The word of the mask that a ``_key`` belongs to, and the bits (three at most) that it sets there."""
    place = F.pmod("_key", F.lit(bits // MASK_WORD + 1).cast("bigint"))
    ones = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_key, {shift}) % {MASK_WORD} as int))") for shift in (25, 38, 51)]
    return keyed.withColumn("_word", place).withColumn("_ones", ones[0].bitwiseOR(ones[1]).bitwiseOR(ones[2]))


def _mask(keys: DataFrame, bits: int) -> DataFrame:
    """The lookup keys as ``bits / MASK_WORD`` rows at most."""
    return _word_and_pattern(keys.select("_key"), bits).groupBy("_word").agg(F.bit_or("_ones").alias("_mask"))


def _through_mask(keyed: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The rows whose ``_key`` may be one of ``keys`` (``count`` rows with a ``_key``); no row is shuffled."""
    bits = MIN_MASK_BITS
    while bits < min(MAX_MASK_BITS, 32 * count):
        bits *= 2
    met = _word_and_pattern(keyed, bits).join(F.broadcast(_mask(keys, bits)), "_word")
    return met.filter(F.col("_mask").bitwiseAND(F.col("_ones")) == F.col("_ones"))


def lookup_entities(mapping: DataFrame) -> DataFrame:
    """Entities with a letter or digit, with their runs (``COMPARED`` at most) and the key they are looked up by."""
    entities = mapping.select("entity", "replacement", "seq", F.slice(letter_runs("entity"), 1, COMPARED).alias("_runs")).filter("size(_runs) > 0")
    entities = entities.withColumn("_lead", F.least(F.size("_runs"), F.lit(LEAD)))
    return entities.withColumn("_key", F.xxhash64(F.slice("_runs", 1, F.col("_lead"))))


def likely_places(texts: DataFrame, entities: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, _key, _next): the places of the texts that the mask of the entities lets through, with the runs
    that are to be compared: those the key was made of if no entity of that key can be longer."""
    shape = entities.agg(F.collect_set("_lead"), F.count("*"), F.max(F.size("_runs"))).first()
    leads, longest = sorted(shape[0]) or [1], shape[2] or 1
    listed = texts.select(*keys, letter_runs(text).alias("_text"))
    # Places whose first run no entity begins with go before all their lengths are looked up.
    begun = listed.select(*keys, "_text", F.posexplode("_text").alias("_at", "_first")).withColumn("_key", F.xxhash64("_first"))
    firsts = entities.select(F.xxhash64(F.get("_runs", F.lit(0))).alias("_key"))
    likely = _through_mask(begun, firsts, shape[1]).select(*keys, "_text", (F.col("_at") + 1).alias("_at"))
    places = likely.withColumn("_lead", F.explode(F.array(*[F.lit(n) for n in leads]))).filter(F.col("_at") + F.col("_lead") <= F.size("_text") + 1)
    keyed = places.withColumn("_key", F.xxhash64(F.slice("_text", F.col("_at"), F.col("_lead"))))
    through = _through_mask(keyed, entities, shape[1])
    compared = F.when(F.col("_lead") < LEAD, F.col("_lead")).otherwise(F.lit(longest))
    return through.select(*keys, "_key", F.slice("_text", F.col("_at"), compared).alias("_next")).distinct()


def sequence_matches(texts: DataFrame, mapping: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, entity, replacement, seq) of the entities whose letter/digit runs follow each other
    somewhere in the text, whatever stands between them.

    An entity with a letter or digit can only match there, so what is found is a hit up to its
    separators. The first runs of every entity (``LEAD`` at most) are hashed; each place of a text looks
    its own hashes up in a bit mask of bounded size, and only places that the mask lets through carry
    their next runs to the join with the mapping, where they are compared.
    """
    entities = lookup_entities(mapping)
    through = likely_places(texts, entities, keys, text)
    met = through.join(entities, "_key").filter(F.slice("_next", F.lit(1), F.size("_runs")) == F.col("_runs"))
    return met.select(*keys, "entity", "replacement", "seq").distinct()


def _sign_matches(texts: DataFrame, mapping: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The same for entities without a letter or digit, which meet texts on their first sign."""
    only = mapping.filter(F.size(letter_runs("entity")) == 0)
    signs = F.array_distinct(F.split(F.regexp_replace(text, _LETTER_OR_DIGIT, ""), ""))
    listed = texts.select(*keys, F.explode(signs).alias("_sign"))
    return listed.join(only.withColumn("_sign", F.substring("entity", 1, 1)), "_sign").select(*keys, "entity", "replacement", "seq")


def _set_matches(text_runs: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entity, replacement, seq) of the entities all of whose runs are among ``text_runs`` (keys,
    ``run``): they meet on the run that the fewest entities contain, then all are counted."""
    runs = mapping.select("entity", "replacement", "seq", F.explode(F.array_distinct(letter_runs("entity"))).alias("run"))
    frequency = runs.groupBy("run").agg(F.count("*").alias("_n"))
    rarest = runs.join(shuffled(frequency), "run").groupBy("entity", "replacement", "seq").agg(
        F.min_by("run", F.struct("_n", "run")).alias("run"), F.collect_set("run").alias("_all")
    )
    met = text_runs.join(shuffled(rarest), "run").select(*keys, "entity", "replacement", "seq", F.explode("_all").alias("run"), F.size("_all").alias("_of"))
    return (
        met.join(shuffled(text_runs), [*keys, "run"])
        .groupBy(*keys, "entity", "replacement", "seq", "_of")
        .agg(F.count("*").alias("_n"))
        .filter("_n = _of")
        .select(*keys, "entity", "replacement", "seq")
    )


def _runs_of(entries: DataFrame) -> DataFrame:
    return entries.select("entity", "replacement", "seq", F.explode(F.array_distinct(letter_runs("entity"))).alias("run"))


def _wanted_runs(texts: DataFrame, entries: DataFrame, keys: list[str], text: str) -> DataFrame | None:
    """(keys, run) of the texts, once a text: all runs that the entities hold and maybe a few others, stored; None
    if the entities hold none."""
    wanted = cut_lineage(_runs_of(entries).select(F.xxhash64("run").alias("_key")).distinct())
    count = wanted.count()
    if not count:
        return None
    listed = texts.select(*keys, F.explode(F.array_distinct(letter_runs(text))).alias("run"))
    met = _through_mask(listed.withColumn("_key", F.xxhash64("run")), wanted, count)
    return cut_lineage(met.select(*keys, "run"))


def shortlist(
    texts: DataFrame, mapping: DataFrame, keys: list[str], text: str = "text", mode: str = "single_pass"
) -> DataFrame:
    """(keys, entity, replacement, seq) pairs that can possibly match in each text.

    In a single pass these are the entities whose runs follow each other in the text. Rewriting one after
    the other also matches what earlier replacements put in: entities that hold a run of such a
    replacement, and otherwise runs of the text or of replacements, join until none is new. If a
    replacement has no letter or digit at all, runs on both of its sides become neighbours; then every
    entity counts whose runs the text has.
    """
    found = sequence_matches(texts, mapping, keys, text)
    if not mapping.filter(F.size(letter_runs("entity")) == 0).isEmpty():
        found = found.unionByName(_sign_matches(texts, mapping, keys, text))
    if mode == "single_pass":
        return found
    if not mapping.filter(F.size(letter_runs("replacement")) == 0).isEmpty():
        own = _wanted_runs(texts, mapping, keys, text)
        found = found if own is None else found.unionByName(_set_matches(own, mapping, keys)).distinct()
    # No other entity can be reached by what is put in, and of the texts only runs of these matter.
    touched = _runs_of(mapping)
    any_put_in = mapping.select(F.explode(letter_runs("replacement")).alias("run")).distinct()
    reachable = touched.join(shuffled(any_put_in), "run", "left_semi").select("entity", "replacement", "seq").distinct()
    own = _wanted_runs(texts, reachable, keys, text)
    if own is None:
        return found
    found = cut_lineage(found)
    size = found.count()
    while True:
        put_in = found.select(*keys, F.explode(letter_runs("replacement")).alias("run")).distinct()
        able = put_in.join(shuffled(touched), "run").select("entity", "replacement", "seq").distinct()
        reached = _set_matches(own.unionByName(put_in).distinct(), able, keys)
        found = cut_lineage(found.unionByName(reached).distinct())
        before, size = size, found.count()
        if size == before:
            return found


def effective_entries(mapping: DataFrame, mode: str = "single_pass") -> DataFrame:
    """(entity, replacement, seq) without entries to which an equal one before them leaves nothing.

    Of equal entities the first by ``seq`` replaces every match. In a single pass tags are protected, and no
    match can begin only where another has gone, so the later ones have no effect. One after the other, they
    have one only if replacements bring the entity back: what is put in overlaps it, so that it has the first or
    last character of a replacement or lies within one, or an empty replacement joins what was apart. Later ones
    stay where that is possible, and wherever characters beyond ASCII leave case open.
    """
    entries = mapping.select("entity", "replacement", "seq")

    def firsts(some: DataFrame) -> DataFrame:
        first = some.groupBy("entity").agg(F.min(F.struct("seq", "replacement")).alias("_first"))
        return first.select("entity", "_first.replacement", "_first.seq")

    if mode == "single_pass":
        return firsts(entries)
    ascii_only = r"^[\x00-\x7F]*\z"
    replacement = F.coalesce("replacement", F.lit(""))
    ends = F.array(F.lower(F.substring(replacement, 1, 1)), F.lower(F.substring(replacement, -1, 1)))
    plain = (replacement != "") & replacement.rlike(ascii_only)
    # One row: at most the signs of ASCII, and an empty one for any other replacement.
    edge = F.explode(F.when(plain, ends).otherwise(F.array(F.lit("")))).alias("_edge")
    edges = entries.select(edge).agg(F.collect_set("_edge").alias("_edges"), F.lit(1).alias("_one"))
    repeated = entries.groupBy("entity").agg(F.count("*").alias("_n")).filter("_n > 1")
    runs = repeated.select("entity", F.explode(F.array_distinct(letter_runs("entity"))).alias("run"))
    put_in = entries.select(F.explode(letter_runs("replacement")).alias("run")).distinct()
    absent = runs.join(shuffled(put_in), "run", "left_anti").select("entity", F.lit(1).alias("_one")).distinct()
    apart = ~F.arrays_overlap(F.split(F.lower("entity"), ""), "_edges") & ~F.array_contains("_edges", "")
    inert = absent.join(F.broadcast(edges), "_one").filter(apart & F.col("entity").rlike(ascii_only)).select("entity")
    return firsts(entries.join(shuffled(inert), "entity", "left_semi")).unionByName(entries.join(shuffled(inert), "entity", "left_anti"))


def apply_global_mapping(
    texts: DataFrame,
    mapping: DataFrame,
    keys: list[str],
    text: str = "text",
    out: str = "anonymized_text",
    mode: str = "single_pass",
) -> DataFrame:
    """Rewrite every text with one mapping shared by all of them.

    Entries that only repeat an entity without effect go first, however many there are; each text is then paired with only those entries that can match in it, so the array beside a text is
    as small as the text, however large the mapping is; of those, entries that are no substring of the
    text never become a pattern. ``single_pass`` protects tags: with a large shared mapping almost any
    number is also somebody's tag number. ``sequential`` is the contract of a document's own mapping:
    longest entity first, each over what the ones before it left.
    """
    mapping = cut_lineage(effective_entries(mapping, mode))
    entries = entries_by_key(shortlist(texts, mapping, keys, text, mode), keys)
    joined = texts.join(entries, keys, "left")
    held = F.col("entries") if mode == "sequential" else present_entries(F.col(text), F.col("entries"))
    return joined.withColumn(
        out, F.when(F.col("entries").isNull(), F.col(text)).otherwise(anonymize_text(F.col(text), held, mode))
    ).drop("entries")


def present_entries(text: Column, entries: Column) -> Column:
    """The entries that occur in ``text``, ignoring case; substring search is far cheaper than the
    patterns it saves."""
    return let(
        F.lower(text),
        lambda lowered: F.filter(
            entries, lambda item: F.contains(lowered, F.lower(item["entity"]))
        ),
    )
