"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.llm.common import Hidden, gapless


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of (key, shard): the smallest score wins."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard-{shard}")), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(unit) / F.lit(float(weight))


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard of a key: each shard bids for the key, the best bid wins.

    A bid depends on key, shard number and that shard's weight alone. With one more shard a key
    moves only if the new shard outbids all others, so rows move only into the new shard. A null key
    is a key like any other (all such rows go to one shard). Shards of weight 0 or less get nothing.
    """
    bids = [
        F.struct(_score(F.coalesce(key.cast("string"), F.lit("\0null")), shard, weight).alias("bid"), F.lit(shard).alias("shard"))
        for shard, weight in enumerate(weights)
        if weight > 0
    ]
    if not bids:
        raise ValueError("no shard has a positive weight")
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def shard_records(
    docs: DataFrame,
    key: str = "doc_id",
    weights: list[float] | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Adds ``shard``, ``grown_shard`` (with one more shard of weight 1) and ``slot``, the record's
    place in its shard (0, 1, 2, ... without gaps).

    Slots come from two levels of numbering, so no task holds a whole shard. Rows that repeat a key
    lie in the same shard in slots of their own; ``order`` (the key by default) should tell
    repeated rows apart where it matters which of them gets which slot. Null keys share one shard.
    Input columns named like the added ones are replaced; an empty table gives an empty table.
    """
    weights = weights or [1.0] * 8
    hidden = Hidden(docs, ("shard", "grown_shard", "slot"))
    placed = docs.select(
        *hidden.columns(),
        rendezvous_shard(F.col(key), weights).cast("int").alias("shard"),
        rendezvous_shard(F.col(key), [*weights, 1.0]).cast("int").alias("grown_shard"),
    )
    places = [hidden.own[name] for name in order or [key]]
    slots = gapless(placed, ["shard"], places, "slot", docs.select(key).count())
    return slots.select(*hidden.back(), "shard", "grown_shard", "slot")
