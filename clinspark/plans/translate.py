"""Translation: line by line, each distinct line once, reassembled in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspark.functions.text import is_blank, trim_spaces
from clinspark.operators.inference import ModelFn, infer
from clinspark.operators.ordering import join_ordered
from clinspark.operators.sheets import text_cells
from clinspark.session import cut_lineage

EMPTY_OUTPUT = "the model returned an empty text"


def text_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line, line_id); ``line_id`` is a digest that stands for the text in joins."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn(
        "line_id", F.when(~is_blank("line"), F.sha2("line", 256))
    )


def translate_lines(lines: DataFrame, src: str, tgt: str, model_fn: ModelFn) -> DataFrame:
    """(line_id, translated, error) of every distinct non-blank line.

    The model sees each line once, however often it occurs; ``error`` marks failed or empty answers.
    """
    distinct = (
        lines.filter("line_id IS NOT NULL")
        .groupBy("line_id")
        .agg(F.min("line").alias("line"))
        .withColumn("src_lang", F.lit(src))
        .withColumn("tgt_lang", F.lit(tgt))
    )
    answered = infer(
        distinct,
        model_fn,
        "line_id string, line string, src_lang string, tgt_lang string, reply string, error string",
    )
    reply = trim_spaces(F.coalesce("reply", F.lit("")))
    return answered.select(
        "line_id",
        reply.alias("translated"),
        F.coalesce("error", F.when(reply == "", EMPTY_OUTPUT)).alias("error"),
    )


def translate(
    docs: DataFrame,
    src: str,
    tgt: str,
    model_fn: ModelFn,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    paragraphs_only: bool = False,
    persist_lines: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(translations, failures)``: (keys, translated) per document, (line_id, error) per bad line.

    Blank lines are kept; ``paragraphs_only`` drops them and joins with a blank line instead. Equal
    source and target return the input. A failed line stays in its original wording. The join back
    carries digests, not texts, and its right side has one row per distinct line, so a line that
    makes up a third of all rows is split by the skew-join rule.
    """
    keys = list(keys)
    if src == tgt:
        same = docs.select(*keys, F.col(text).alias("translated"))
        return same, docs.sparkSession.createDataFrame([], "line_id string, error string")
    lines = text_lines(docs, keys, text)
    if paragraphs_only:
        lines = lines.filter("line_id IS NOT NULL")
    answers = translate_lines(lines, src, tgt, model_fn)
    if persist_lines:
        answers = cut_lineage(answers)
    good = answers.filter("error IS NULL").select("line_id", "translated")
    joined = lines.join(good, "line_id", "left").withColumn(
        "_line", F.coalesce("translated", "line")
    )
    separator = "\n\n" if paragraphs_only else "\n"
    translations = join_ordered(joined, keys, ["line_no"], "_line", separator, "translated")
    return translations, answers.filter("error IS NOT NULL").select("line_id", "error")


def translate_columns(
    df: DataFrame, row: str, columns: list[str], src: str, tgt: str, model_fn: ModelFn
) -> tuple[DataFrame, DataFrame]:
    """``(table, failures)``: the table with a ``<name> (Translated)`` column per chosen column;
    blank cells give empty strings."""
    cells = text_cells(df, row, columns)
    translated, failures = translate(
        cells, src, tgt, model_fn, keys=(row, "col_no"), text="value"
    )
    wide = translated.groupBy(row).agg(
        *[
            F.max(F.when(F.col("col_no") == number, F.col("translated"))).alias(f"_new_{number}")
            for number in range(len(columns))
        ]
    )
    joined = df.join(wide, row, "left")
    new = [
        F.coalesce(f"_new_{number}", F.lit("")).alias(f"{name} (Translated)")
        for number, name in enumerate(columns)
    ]
    return joined.select(*df.columns, *new), failures
