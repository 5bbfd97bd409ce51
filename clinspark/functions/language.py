"""Language detection by counting function words."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspark import fixed_values as fixed
from clinspark.functions.text import as_column, let

_ASCII_WORD = "[A-Za-z0-9_]"


def _is_plain(word: str) -> bool:
    return word.isascii()


def _boundary_pattern(word: str) -> str:
    """``word`` between ASCII word boundaries, whatever its first and last letters are."""
    left = f"(?<!{_ASCII_WORD})" if word[0].isascii() else f"(?<={_ASCII_WORD})"
    right = f"(?!{_ASCII_WORD})" if word[-1].isascii() else f"(?={_ASCII_WORD})"
    return left + word + right


def _tokens(sample: Column) -> Column:
    return F.regexp_extract_all(sample, F.lit(f"{_ASCII_WORD}+"), F.lit(0))


def _plain_score(tokens: Column, words: tuple[str, ...]) -> Column:
    plain = [word for word in words if _is_plain(word)]
    return F.size(F.filter(tokens, lambda token: token.isin(*plain)))


def _accented_score(text: Column, words: tuple[str, ...]) -> Column:
    counts = [
        F.regexp_count(text, F.lit(_boundary_pattern(word)))
        for word in words
        if not _is_plain(word)
    ]
    return reduce(add, counts) if counts else F.lit(0)


def _sample(text: Column, chars: int | None) -> Column:
    return F.lower(text if chars is None else F.substring(text, 1, chars))


def detect_language_nl_en(text: Column | str, sample_chars: int | None = None) -> Column:
    """``Dutch``, ``English`` or the neutral phrase used in prompts.

    Judges the whole text, or its first ``sample_chars`` characters (``LANGUAGE_SAMPLE_NL_EN`` is a
    usual choice where texts are very long).
    """
    sample = _sample(as_column(text), sample_chars)
    margin = F.lit(fixed.LANGUAGE_MARGIN_NL_EN)

    def scores(tokens: Column) -> Column:
        extra = F.size(F.filter(tokens, lambda token: token == fixed.DUTCH_TRIPLE_WORD)) * 2
        return F.struct(
            (_plain_score(tokens, fixed.DUTCH_WORDS) + extra).alias("dutch"),
            _plain_score(tokens, fixed.ENGLISH_WORDS).alias("english"),
        )

    def verdict(score: Column) -> Column:
        return (
            F.when(score["dutch"] > score["english"] * margin, "Dutch")
            .when(score["english"] > score["dutch"] * margin, "English")
            .when(sample.rlike("|".join(fixed.DUTCH_DIGRAPHS)), "Dutch")
            .otherwise("the same language as the source text")
        )

    return let(let(_tokens(sample), scores), verdict)


def detect_language_five(text: Column | str, sample_chars: int | None = None) -> Column:
    """``eng``, ``nld``, ``deu``, ``fra``, ``spa``, or NULL if there is too little evidence.

    Judges the whole text, or its first ``sample_chars`` characters (``LANGUAGE_SAMPLE_FIVE`` is a
    usual choice); texts under 40 characters have no language.
    """
    text = as_column(text)
    sample = _sample(text, sample_chars)
    codes = list(fixed.FIVE_LANGUAGE_WORDS)

    def scores(tokens: Column) -> Column:
        return F.array(
            *[
                (_plain_score(tokens, words) + _accented_score(sample, words)).cast("int")
                for words in fixed.FIVE_LANGUAGE_WORDS.values()
            ]
        )

    def verdict(score: Column) -> Column:
        best = F.array_max(score)
        winner = F.element_at(
            F.array(*map(F.lit, codes)), F.array_position(score, best).cast("int")
        )
        return (
            F.when((best != score[0]) & (best < score[0] * fixed.LANGUAGE_MARGIN_FIVE), codes[0])
            .when(best < fixed.LANGUAGE_MIN_SCORE_FIVE, F.lit(None).cast("string"))
            .otherwise(winner)
        )

    return F.when(
        F.length(text) >= fixed.LANGUAGE_MIN_CHARS_FIVE, let(let(_tokens(sample), scores), verdict)
    )
