"""Yes/no rules about entities, transcripts, file names and pages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspark import fixed_values as fixed
from clinspark.functions.text import SPACES, as_column, let, split_words, trim_spaces, whole_word

_NOT_SPACE_OR_AT = f"[^{fixed.SPACE_CLASS}@]"
_CAPITAL = "[A-ZÀ-ÖØ-Þ]"
_SMALL = "[a-zà-öø-ÿ.'-]"

# Shapes that count as strong personal data.
EMAIL_SHAPE = rf"{_NOT_SPACE_OR_AT}+@{_NOT_SPACE_OR_AT}+\.{_NOT_SPACE_OR_AT}+"
PHONE_SHAPE = rf"\+?[0-9][0-9{fixed.SPACE_CLASS}().-]{{6,}}[0-9]"
POSTCODE_SHAPE = f"[0-9]{{4}}{SPACES}?[A-Z]{{2}}"
HOUSE_NUMBER_SHAPE = "[0-9]+[a-z]?"
NAME_SHAPE = (
    f"(?:^|{SPACES}){_CAPITAL}{_SMALL}+(?:{SPACES}+(?:{'|'.join(fixed.NAME_PARTICLES)}))*"
    f"{SPACES}+{_CAPITAL}{_SMALL}+"
)
PLACE_SHAPE = f"{_CAPITAL}{_SMALL}{{2,}}"


def _has_word(text: Column, words: tuple[str, ...] | str) -> Column:
    pattern = words if isinstance(words, str) else "|".join(words)
    return text.rlike("(?i)" + whole_word(pattern))


# "dr." ends in a dot, so its right edge is a boundary only before a word character; plain "dr" already
# matches everywhere "dr." does, therefore the dot can be left out.
_CARE_WORDS = (
    *(title.removesuffix(r"\.?") for title in fixed.CARE_TITLES),
    *fixed.MEDICAL_ORGANISATIONS,
)


def has_strong_pii_signal(entity: Column | str, entity_type: Column | str) -> Column:
    """True if an entity must never be dropped by a reviewer (blank entities: false).

    Most texts have neither a digit nor an at sign, so these cheap tests guard the costly patterns.
    """
    text = trim_spaces(F.coalesce(as_column(entity), F.lit("")))
    kind = F.coalesce(as_column(entity_type), F.lit(""))
    numeric = (
        kind.isin("ID_NUMBER", "DATE", "AGE")
        | text.rlike(PHONE_SHAPE)
        | _has_word(text, POSTCODE_SHAPE)
        | (_has_word(text, HOUSE_NUMBER_SHAPE) & _has_word(text, fixed.STREET_WORDS))
    )
    signal = (
        kind.isin("EMAIL", "PHONE", "ADDRESS")
        | (F.contains(text, F.lit("@")) & text.rlike(EMAIL_SHAPE))
        | (text.rlike("[0-9]") & numeric)
        | ((kind == "DATE") & _has_word(text, fixed.DUTCH_MONTHS))
        | ((kind == "PERSON") & text.rlike(NAME_SHAPE))
        | (kind.isin("LOCATION", "ORGANIZATION") & text.rlike(PLACE_SHAPE))
        | _has_word(text, _CARE_WORDS)
    )
    return (text != "") & signal


def is_obvious_garbage(entity: Column | str, entity_type: Column | str) -> Column:
    """Zero-shot detections that need no review: chit-chat and shapeless identifiers."""
    entity, kind = as_column(entity), as_column(entity_type)
    plain = trim_spaces(F.regexp_replace(F.lower(entity), f"{SPACES}+", " "))
    digit = entity.rlike("[0-9]")
    openings = "^(?:" + "|".join(fixed.CONVERSATION_OPENINGS) + ")(?![A-Za-z0-9_])"
    pieces = F.split(entity, f"{SPACES}+")
    capitalised = F.exists(pieces, lambda piece: piece.rlike("^[A-ZÀ-ɏ]"))
    return (
        plain.isin(*fixed.STOP_PHRASES)
        | ((kind == "ID_NUMBER") & ~digit)
        | ((kind == "LOCATION") & (F.length(entity) < 3) & ~digit)
        | plain.rlike(openings)
        | (kind.isin("PERSON", "ORGANIZATION") & (F.size(pieces) > 1) & ~capitalised)
    )


def is_valid_span(
    entity: Column | str,
    entity_type: Column | str,
    score: Column | str,
    threshold: float | None = None,
) -> Column:
    """At least two characters, a type, and a score above the floor (and the threshold, if any)."""
    entity, kind = as_column(entity), as_column(entity_type)
    score = F.coalesce(as_column(score), F.lit(0.0))
    valid = (
        (F.length(F.coalesce(entity, F.lit(""))) >= 2)
        & (F.coalesce(kind, F.lit("")) != "")
        & (score > fixed.MIN_SPAN_SCORE)
    )
    return valid if threshold is None else valid & (score >= threshold)


def is_invented_transcript(text: Column | str) -> Column:
    """True for transcripts that speech models make up on silence or noise."""
    text = F.coalesce(as_column(text), F.lit(""))
    known = "|".join(
        "(?:" + pattern.replace("SPACE", SPACES).replace("$", r"\z") + ")"
        for pattern in fixed.INVENTED_TRANSCRIPTS
    )

    def longest_run(words: Column) -> Column:
        # Occurrences of the most frequent word: sort, then follow the runs of equal words.
        start = F.struct(
            F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best")
        )

        def step(state: Column, word: Column) -> Column:
            run = F.when(word == state["word"], state["run"] + 1).otherwise(F.lit(1))
            return F.struct(
                word.alias("word"),
                run.alias("run"),
                F.greatest(state["best"], run).alias("best"),
            )

        return F.aggregate(F.array_sort(words), start, step, lambda state: state["best"])

    def repeats(words: Column, length: int) -> Column:
        # Every word equals the word ``length`` places before it.
        rest = F.greatest(F.size(words) - length, F.lit(0))
        pairs = F.arrays_zip(
            F.slice(words, length + 1, rest).alias("later"),
            F.slice(words, 1, rest).alias("earlier"),
        )
        return F.forall(pairs, lambda pair: pair["later"] == pair["earlier"])

    def repetitive(words: Column) -> Column:
        count = F.size(words)
        dominated = (count >= 3) & (longest_run(words) / count > fixed.REPEAT_SHARE)
        looped = repeats(words, 1) | repeats(words, 2) | repeats(words, 3)
        return dominated | ((count >= 4) & looped)

    return (
        (F.length(text) < 2)
        | text.rlike(f"(?i)(?:{known})")
        | let(split_words(F.lower(text)), repetitive)
    )


def is_quality_transcript(text: Column | str) -> Column:
    return ~is_invented_transcript(text)


def _starts_with(name: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(or_, [F.startswith(name, F.lit(prefix)) for prefix in prefixes])


def looks_like_image(name: Column | str, size: Column | str) -> Column:
    """Ordered rules on the file name, then on the size."""
    big = as_column(size) > fixed.MIN_IMAGE_BYTES

    def rules(name: Column) -> Column:
        dotted = F.contains(name, F.lit("."))
        extension = F.substring_index(name, ".", -1)
        return (
            F.when(dotted & extension.isin(*fixed.IMAGE_EXTENSIONS), True)
            .when(~dotted & big, True)
            .when(_starts_with(name, fixed.IMAGE_NAME_PREFIXES), True)
            .when(big & F.substring_index(name, ".", 1).rlike(r"^[0-9]+\z"), True)
            .when(dotted & extension.isin(*fixed.OTHER_EXTENSIONS), False)
            .otherwise(big)
        )

    # Bound once: a pushed-down filter would otherwise repeat whatever computes the name per rule.
    return let(F.lower(as_column(name)), rules)


def guess_modality(name: Column | str) -> Column:
    """The modality hinted at by the start of the file name, else NULL."""

    def rules(name: Column) -> Column:
        guess = None
        for modality, prefixes in fixed.MODALITY_PREFIXES:
            matches = _starts_with(name, prefixes)
            guess = F.when(matches, modality) if guess is None else guess.when(matches, modality)
        return guess

    return let(F.lower(as_column(name)), rules)


def page_kind(text: Column | str) -> Column:
    """Pages with hardly any text are scans and need character recognition."""
    return F.when(F.length(trim_spaces(text)) < fixed.MIN_TEXT_CHARS, "ocr").otherwise("text")
