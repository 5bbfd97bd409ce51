"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside or add themselves.
CLASHING = "kept string, shard string, size string, component string, mark string, _rows string, _salt string, id string, key string, page string, row string, part string, length string, cell string, rank string, score string"


def words(rng: random.Random, count: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(count))


def awkward_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = words(rng, 120)
    near = base.split()
    near[5] = "changed"
    long = words(rng, 30_000)
    texts = [
        None, "", " \t\n", "a", "A", "!?.", base, base, base.replace(" ", "  \n"), " ".join(near), base.upper(),
        long, long + " tail", "été " * 40, "日本語 テキスト", base[:150], base[:99], base[:100], "x" * 300, "x" * 300,
        words(rng, 60), words(rng, 60), "\x00\x1c weird \x85   end", "\U0001f600" * 30,
    ]
    rows = [(n, text, "en" if n % 2 else "fr", None if n % 7 == 0 else f"src{n % 3}", None) for n, text in enumerate(texts)]
    rows.append((3, "a", "en", "src0", 1))  # a repeated row
    rows.append((None, base, None, None, None))
    rows.append((None, None, None, None, None))
    return rows


def frame(spark: SparkSession, rows: list[tuple], clashing: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        for column in CLASHING.split(", "):
            name = column.split()[0]
            df = df.selectExpr("*", f"'extra' as `{name}`")
    return df
