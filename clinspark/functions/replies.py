"""Reading model replies: think blocks, JSON lists of entities, sub-word surfaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspark.functions.text import SPACES, as_column, is_blank, trim_spaces

FIRST_LIST = r"(?s)\[.*?\]"
WIDEST_LIST = r"(?s)\[.*\]"
ENTITY_SCHEMA = "array<struct<entity:string,type:string>>"
REJECT_SCHEMA = "array<struct<entity:string,text:string,value:string,name:string>>"


def strip_think(reply: Column | str) -> Column:
    return trim_spaces(F.regexp_replace(as_column(reply), "(?s)<think>.*?</think>", ""))


def _first_list(reply: Column | str, greedy: bool) -> Column:
    return F.regexp_extract(strip_think(reply), WIDEST_LIST if greedy else FIRST_LIST, 0)


def parse_entity_json(reply: Column | str, greedy: bool = False) -> Column:
    """Entities of the first JSON list in a reply; anything unreadable gives an empty list.

    The list ends at the first ``]``; ``greedy`` takes the last one instead, which keeps entities
    that themselves contain a bracket.
    """
    items = F.from_json(_first_list(reply, greedy), ENTITY_SCHEMA)
    kept = F.filter(
        items,
        lambda item: item["entity"].isNotNull() & item["type"].isNotNull() & ~is_blank(item["entity"]),
    )
    return F.coalesce(kept, F.array().cast(ENTITY_SCHEMA))


def parse_reject_json(reply: Column | str, greedy: bool = False) -> Column:
    """Rejected surfaces named in a reply, under any of four keys; unreadable replies reject none."""
    items = F.from_json(_first_list(reply, greedy), REJECT_SCHEMA)
    names = F.transform(
        items,
        lambda item: F.coalesce(
            *[F.nullif(item[key], F.lit("")) for key in ("entity", "text", "value", "name")]
        ),
    )
    kept = F.filter(names, lambda name: name.isNotNull() & ~is_blank(name))
    return F.coalesce(kept, F.array().cast("array<string>"))


def surface_from_span(
    text: Column | str, start: Column | str, end: Column | str, word: Column | str
) -> Column:
    """The surface of a token-class span: the text between its offsets, or the cleaned model word.

    Offsets win unless the text they cover is only digits and punctuation while the word has letters.
    """
    text, start, end = as_column(text), as_column(start), as_column(end)
    has_offsets = start.isNotNull() & end.isNotNull() & (end > start)
    covered = F.when(has_offsets, trim_spaces(F.substring(text, start + 1, end - start)))
    covered = F.coalesce(covered, F.lit(""))
    cleaned = F.regexp_replace(F.coalesce(as_column(word), F.lit("")), "[Ġ▁]", " ")
    cleaned = F.regexp_replace(F.replace(cleaned, F.lit("##"), F.lit("")), f"{SPACES}+", " ")
    cleaned = trim_spaces(cleaned)
    letters = r"[\p{L}@]"
    numeric = covered.rlike(f"^[0-9.,:/+\\-{SPACES[1:-1]}]+$")
    prefer_word = cleaned.rlike(letters) & (numeric | ~covered.rlike(letters))
    return (
        F.when(cleaned == "", covered)
        .when(prefer_word, cleaned)
        .when(has_offsets, covered)
        .otherwise(cleaned)
    )
