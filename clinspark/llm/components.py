"""Connected components of links between fingerprints, as joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clinspark.llm.common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of the links (``left``, ``right``); the component is
    its least node.

    In each round a node takes the least of its own label, its neighbours' labels and its label's
    label, so labels travel along paths of doubling length. Inputs of the joins are stored tables
    behind a plain exchange, which lets the adaptive skew join split a node with very many links, and
    minima are combined before they are shuffled. A round is one job; it goes on until a round changes
    nothing, and only that number of changes reaches the driver.
    """
    pairs = links.select("left", "right").filter("left <> right")
    both = pairs.union(pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    edges = staged(both.distinct(), "links")
    labels = staged(
        edges.groupBy(F.col("left").alias("node")).agg(F.least(F.min("right"), F.first("left")).alias("component")),
        "labels",
    )
    changed = 1
    while changed:
        of_label = labels.select(F.col("node").alias("_at"), F.col("component").alias("_said"))
        own = labels.select("node", F.col("component").alias("_said"), F.col("component").alias("_old"))
        none = F.lit(None).cast("long").alias("_old")
        near = edges.join(of_label, edges["right"] == of_label["_at"]).select(F.col("left").alias("node"), "_said", none)
        ahead = labels.join(of_label, labels["component"] == of_label["_at"]).select("node", "_said", none)
        lower = own.union(near).union(ahead).groupBy("node").agg(F.min("_said").alias("component"), F.max("_old").alias("_old"))
        seen = Observation()
        watched = lower.observe(seen, F.count(F.when(F.col("component") < F.col("_old"), 1)).alias("changed"))
        before, labels = labels, staged(watched.select("node", "component"), "labels")
        changed = seen.get["changed"]
        discard(before)
    discard(edges)
    return labels
