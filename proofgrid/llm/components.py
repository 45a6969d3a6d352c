"""Connected components by minimum labels and pointer jumping, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def total(labels: DataFrame) -> object:
    return labels.agg(F.sum(F.col("label").cast("decimal(38, 0)"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): the smallest node that links reach. Labels only fall, so an equal sum ends it."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    last = total(labels)
    while last is not None:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = materialize(labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("label", "near").alias("label")), "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = materialize(lower.join(jump, lower["label"] == jump["at"]).select("node", F.least("label", "further").alias("label")), "labels")
        discard(labels, lower)
        labels, now = after, total(after)
        if now == last:
            break
        last = now
    discard(both)
    return labels
