"""Person names: given names and surname, and whether two names may be the same person."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspark.fixed_values import SURNAME_PARTICLES
from clinspark.functions.text import as_column, let, split_words

NAME_SCHEMA = "struct<given:array<string>,surname:string>"


def split_name(full: Column | str) -> Column:
    """``given`` tokens and ``surname``; the surname starts at the first particle that is not the
    last token, otherwise it is the last token."""

    def parts(tokens: Column) -> Column:
        head = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
        marks = F.transform(head, lambda token: F.lower(token).isin(*SURNAME_PARTICLES))
        particle = F.array_position(marks, F.lit(True)).cast("int")
        first = F.when(particle > 0, particle).otherwise(F.greatest(F.size(tokens), F.lit(1)))
        return F.struct(
            F.slice(tokens, 1, first - 1).alias("given"),
            F.array_join(F.slice(tokens, first, F.size(tokens)), " ").alias("surname"),
        )

    return let(split_words(full), parts)


def is_initial(token: Column | str) -> Column:
    """A single capital, or a token that starts with a capital and a dot."""
    return as_column(token).rlike(r"^[A-Z](?:\.|\z)")


def initial_letter(token: Column | str) -> Column:
    return F.lower(F.substring(F.regexp_replace(as_column(token), "[^A-Za-z]", ""), 1, 1))


def names_compatible(left: Column, right: Column) -> Column:
    """Whether two ``split_name`` structs may name the same person."""

    def token_pair(pair: Column) -> Column:
        one, two = pair["one"], pair["two"]
        by_letter = is_initial(one) | is_initial(two)
        return F.when(by_letter, initial_letter(one) == initial_letter(two)).otherwise(
            F.lower(one) == F.lower(two)
        )

    shared = F.least(F.size(left["given"]), F.size(right["given"]))
    pairs = F.arrays_zip(
        F.slice(left["given"], 1, shared).alias("one"),
        F.slice(right["given"], 1, shared).alias("two"),
    )
    return (F.lower(left["surname"]) == F.lower(right["surname"])) & F.forall(pairs, token_pair)
