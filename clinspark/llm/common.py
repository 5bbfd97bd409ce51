"""What several of the pipeline operators need: staging, skew-safe look-ups and gapless ranks."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinspark.session import checkpoint_folder

# A key with more than 1/HOT_SHARE of all rows is hot, so fewer than HOT_SHARE keys can be.
HOT_SHARE = 200
SALTS = 64
ROWS_PER_PIECE = 20_000
# The white space of the contracts, as a Java regular expression class.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """A few rows of the driver's as a table. They go as Arrow: a list of rows would be read by Python
    workers of another kind than those of the operators, which stay beside them on every executor."""
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], names=list(kinds)))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder; removed when the application ends."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, any
    executor can be lost afterwards, and columns can still be pruned."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stage_folder = path
    return stored


def discard(*stages: DataFrame) -> None:
    """Delete tables that ``staged`` returned, once everything that reads them is written."""
    for stage in stages:
        jvm = stage.sparkSession.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(stage.stage_folder)
        place.getFileSystem(stage.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def utf8(text: str) -> Column:
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")


class Hidden:
    """Columns of a caller under names of our own, so that no name of theirs can clash with ours."""

    def __init__(self, df: DataFrame, added: tuple[str, ...]):
        self.names = [name for name in df.columns if name not in added]
        self.own = {name: f"_c{place}" for place, name in enumerate(self.names)}

    def columns(self) -> list[Column]:
        return [F.col(f"`{name}`").alias(own) for name, own in self.own.items()]

    def back(self) -> list[Column]:
        return [F.col(own).alias(name) for name, own in self.own.items()]


def hot_keys(facts: DataFrame, key: str, count: str) -> list:
    """The keys that hold more than ``1/HOT_SHARE`` of the rows: fewer than ``HOT_SHARE`` values."""
    total = facts.agg(F.sum(count)).first()[0] or 0
    rows = facts.filter(F.col(count) > max(total / HOT_SHARE, 1)).select(key).limit(HOT_SHARE)
    return [row[0] for row in rows.collect()]


def join_back(
    rows: DataFrame, facts: DataFrame, key: str, count: str, spread: str | Column, how: str = "left"
) -> DataFrame:
    """Join one fact row per ``key`` (never null) onto ``rows``, however many rows a key has.

    Rows of hot keys are dealt to ``SALTS`` salts by a hash of ``spread``, and the few facts of hot
    keys are repeated per salt, so that no key is one task. ``facts`` should be a stored table: it
    is read twice.
    """
    hot = hot_keys(facts, key, count)
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    spread = F.col(spread) if isinstance(spread, str) else spread
    salted = rows.withColumn(
        "_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    )
    every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    one = F.array(F.lit(0).cast("long"))
    repeated = facts.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(one)))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... without a task that holds a whole key.

    Rows of a key are cut into pieces by a hash of ``order``, numbered inside the piece and shifted
    by the sizes of the key's earlier pieces. ``rows`` (how many there are) sets the number of
    pieces. The numbering is the same on every run, but it follows the pieces, not ``order`` alone.
    """
    pieces = max(8, -(-rows // ROWS_PER_PIECE))
    cut = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    within = Window.partitionBy(*keys, "_piece").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(*keys, "_piece")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    return (
        cut.withColumn("_local", F.row_number().over(within))
        .join(shifts, [*keys, "_piece"])
        .withColumn(out, (F.col("_local") + F.col("_shift") - 1).cast("long"))
        .drop("_piece", "_local", "_shift")
    )
