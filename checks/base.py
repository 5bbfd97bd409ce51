"""Small helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.fixed_values import SPACE_CHARS, SPACE_CLASS

SPACES = f"[{SPACE_CLASS}]"
Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    query: Query
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# White space as a DuckDB expression: built from code points so that the SQL stays printable.
SQL_SPACES = " || ".join(f"chr({ord(char)})" for char in dict.fromkeys(SPACE_CHARS))


def sql_trim(value: str) -> str:
    return f"trim({value}, {SQL_SPACES})"


def sql_words(words) -> str:
    return "|".join(words)


def joined(values: Column, separator: str = "|") -> Column:
    """An array as one string, so that results compare as plain text."""
    return F.array_join(values, separator)


def rounded(value: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, digits)
