"""Tables as sheets: text columns, text cells, previews and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspark.functions.text import is_blank
from clinspark.operators.ordering import join_ordered


def text_columns(df: DataFrame, wanted: list[str] | None = None) -> list[str]:
    """String columns of a table, or ``wanted`` after checking that they exist and are strings."""
    strings = [field.name for field in df.schema if isinstance(field.dataType, T.StringType)]
    if wanted is None:
        return strings
    bad = [name for name in wanted if name not in strings]
    if bad:
        raise ValueError(f"not text columns: {', '.join(bad)}")
    return wanted


def header_names(headers: list[str | None]) -> list[str]:
    """Display names; unnamed columns become ``Column n``."""
    return [name if name else f"Column {number}" for number, name in enumerate(headers, 1)]


def text_cells(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, col_no, col, value) of the non-blank text cells, a projection without shuffle."""
    cells = F.array(
        *[
            F.struct(
                F.lit(number).alias("col_no"), F.lit(name).alias("col"), F.col(name).alias("value")
            )
            for number, name in enumerate(text_columns(df, columns))
        ]
    )
    return df.select(F.col(row), F.inline(cells)).filter(~is_blank("value"))


def sheet_text(cells: DataFrame) -> DataFrame:
    """Text of a workbook from long ``cells`` (book, sheet_no, row, col, value, is_text): cells of a
    row joined by spaces, rows and sheets by line breaks."""
    keys = ["book", "sheet_no", "row"]
    texts = cells.filter("is_text")
    rows = join_ordered(texts, keys, ["col"], "value", " ", "line")
    return join_ordered(rows, ["book"], ["sheet_no", "row"], "line", "\n", "text")


def preview_rows(df: DataFrame, row: str, columns: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of the chosen columns, blanks as empty strings (a top-k by row)."""
    shown = [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in columns]
    return df.orderBy(row).limit(n).select(row, *shown)


def sheet_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, columns, header and emptiness flags, and non-blank text cells of chosen columns."""
    filled: Column = F.lit(0)
    for name in text_columns(df, columns):
        filled = filled + F.when(~is_blank(name), 1).otherwise(0)
    return df.agg(
        F.count("*").cast("bigint").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(bool(df.columns)).alias("has_headers"),
        (F.count("*") == 0).alias("is_empty"),
        F.coalesce(F.sum(filled), F.lit(0)).cast("bigint").alias("text_cells"),
    )


def cells_to_table(cells: DataFrame, book: str, sheet: str, headers: list[str]) -> DataFrame:
    """One sheet of long cells as a table with the given headers in column order."""
    chosen = cells.filter((F.col("book") == book) & (F.col("sheet") == sheet))
    aggregates = [
        F.max(F.when(F.col("col") == number, F.col("value"))).alias(name)
        for number, name in enumerate(headers)
    ]
    return chosen.groupBy("row").agg(*aggregates)
