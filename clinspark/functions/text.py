"""Text columns: trimming, splitting, counting, labels, sizes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspark.fixed_values import SPACE_CHARS, SPACE_CLASS

SPACES = f"[{SPACE_CLASS}]"
NOT_WORD_BEFORE = "(?<![A-Za-z0-9_])"
NOT_WORD_AFTER = "(?![A-Za-z0-9_])"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst does not share subexpressions below higher-order functions, so an expensive array used
    several times would be rebuilt each time.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def in_blocks(values: Column) -> Column:
    """An array as an array of runs, about as many as each is long."""

    def dealt(array: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(array))).cast("int"))
        firsts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), width))
        return F.transform(F.coalesce(firsts, F.array().cast("array<int>")), lambda first: F.slice(array, first, width))

    return let(values, dealt)


def running_sums(sizes: Column) -> Column:
    """For every element of an array of whole numbers, the sum of those before it.

    An array grows by being copied, so sums are gathered in runs and the runs then joined.
    """
    numbers, runs = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def within(start: Column, run: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(start.alias("total"), numbers.alias("sums")),
            lambda done, size: F.struct(
                (done["total"] + size).alias("total"), F.concat(done["sums"], F.array(done["total"])).alias("sums")
            ),
        )

    joined = F.aggregate(
        in_blocks(sizes),
        F.struct(F.lit(0).alias("total"), runs.alias("sums")),
        lambda done, run: let(
            within(done["total"], run),
            lambda one: F.struct(one["total"].alias("total"), F.concat(done["sums"], F.array(one["sums"])).alias("sums")),
        ),
        lambda done: F.flatten(done["sums"]),
    )
    return joined


def quoted(literal: Column) -> Column:
    """A regex that matches ``literal`` as it stands."""
    inner = F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.concat(F.lit(r"\Q"), inner, F.lit(r"\E"))


def whole_word(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries; for patterns that start and end with [A-Za-z0-9_].

    ``\\b`` of java.util.regex also counts accented letters as word characters, so it cannot be used.
    """
    return f"{NOT_WORD_BEFORE}(?:{pattern}){NOT_WORD_AFTER}"


def trim_spaces(text: Column | str) -> Column:
    """Strip the Unicode white-space set (``trim`` alone strips only U+0020)."""
    return F.btrim(as_column(text), F.lit(SPACE_CHARS))


def is_blank(text: Column | str) -> Column:
    return trim_spaces(F.coalesce(as_column(text), F.lit(""))) == ""


def clean_text(text: Column | str) -> Column:
    """Collapse every white-space run to one space and trim."""
    return trim_spaces(F.regexp_replace(as_column(text), f"{SPACES}+", " "))


def normalize_entity(text: Column | str) -> Column:
    """The comparison form of an entity: trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(trim_spaces(text)), f"{SPACES}+", " ")


def entity_key(text: Column | str) -> Column:
    """The identity form of an entity: trimmed and lower case."""
    return F.lower(trim_spaces(text))


def _trimmed_pieces(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, trim_spaces), lambda piece: piece != "")


def split_paragraphs(text: Column | str) -> Column:
    return _trimmed_pieces(F.split(as_column(text), "\n+"))


def split_sentences(text: Column | str) -> Column:
    return _trimmed_pieces(F.split(as_column(text), "[.!?]+"))


def split_words(text: Column | str) -> Column:
    return F.filter(F.split(as_column(text), f"{SPACES}+"), lambda word: word != "")


def document_stats(text: Column | str) -> dict[str, Column]:
    """Counts of paragraphs, sentences, words, characters and non-space characters."""
    text = as_column(text)
    return {
        "paragraphs": F.size(split_paragraphs(text)).cast("bigint"),
        "sentences": F.size(split_sentences(text)).cast("bigint"),
        "words": F.size(split_words(text)).cast("bigint"),
        "characters": F.length(text).cast("bigint"),
        "characters_no_spaces": F.length(F.regexp_replace(text, SPACES, "")).cast("bigint"),
    }


def preview_text(text: Column | str, length: int = 200) -> Column:
    text = as_column(text)
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def route_by_length(text: Column | str, limit: int) -> Column:
    return F.when(F.length(as_column(text)) <= limit, "single").otherwise("multi")


def sanitize_path(name: Column | str) -> Column:
    """One safe path component; empty becomes ``unknown``."""
    safe = F.regexp_replace(as_column(name), r'[<>:"/\\|?*\x00-\x1f]', "_")
    safe = trim_spaces(F.regexp_replace(safe, "_+", "_"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown"))


def sanitize_pdf_name(name: Column | str) -> Column:
    """A file name with a ``.pdf`` suffix; empty becomes ``merged.pdf``."""
    base = F.coalesce(F.nullif(trim_spaces(as_column(name)), F.lit("")), F.lit("merged.pdf"))
    base = F.regexp_replace(base, r'[\\/:*?"<>|]', "_")
    return F.when(base.rlike(r"(?i)\.pdf\z"), base).otherwise(F.concat(base, F.lit(".pdf")))


def format_dicom_date(value: Column | str) -> Column:
    """``YYYYMMDD…`` to ``YYYY-MM-DD``; shorter values stay as they are, NULL becomes empty."""
    value = F.coalesce(as_column(value), F.lit(""))
    dashed = F.concat_ws(
        "-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2)
    )
    return F.when(F.length(value) >= 8, dashed).otherwise(value)


def human_size(size: Column | str, with_gigabytes: bool = True) -> Column:
    """1024-step sizes. The PDF tools stop at MB (``with_gigabytes=False``)."""
    size = as_column(size)

    def scaled(power: int, decimals: int, unit: str) -> Column:
        return F.format_string(f"%.{decimals}f {unit}", size / F.lit(float(1024**power)))

    label = F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
    label = label.when(size < 1024**2, scaled(1, 1, "KB"))
    if not with_gigabytes:
        return label.otherwise(scaled(2, 1, "MB"))
    return label.when(size < 1024**3, scaled(2, 1, "MB")).otherwise(scaled(3, 2, "GB"))


def format_seconds(seconds: Column | str) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from one hour on."""
    whole = F.floor(as_column(seconds)).cast("bigint")

    def two(value: Column) -> Column:
        text = value.cast("string")
        return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)

    hours = F.floor(whole / 3600).cast("bigint")
    minutes = F.floor((whole % 3600) / 60).cast("bigint")
    parts = [two(hours), two(minutes), two(whole % 60)]
    return F.when(hours > 0, F.concat_ws(":", *parts)).otherwise(F.concat_ws(":", *parts[1:]))


def file_extension(name: Column | str) -> Column:
    """Lower-cased text after the last dot; the whole name if there is no dot."""
    return F.lower(F.substring_index(as_column(name), ".", -1))


def translatable(text: Column | str, source_lang: str, target_lang: str) -> Column:
    """Only non-blank text between two different languages goes to a model."""
    return ~is_blank(text) if source_lang != target_lang else F.lit(False)
