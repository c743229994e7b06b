"""Connected components of an edge table by repeated shuffles; no group is gathered in one task."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, save


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge; columns a and b, both long.

    Each round orders the labels anew at random, hangs every label on the first one beside it and follows that one
    step further, until no edge joins two labels: a constant share of the labels goes each round, chains included.
    Firsts are minima, which are aggregated before they are shuffled; edges within a label leave.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct()
    left = save(edges, "edges")
    labels = save(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    for turn in count():
        if not left.limit(1).count():
            least = labels.groupBy("component").agg(F.min("node").alias("_least"))
            return save(labels.join(least, "component").select("node", F.col("_least").alias("component")), "components")
        # left holds edges between labels: hang each on the first label it touches, in this round's order
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("label"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("_b")).select(F.col("a").alias("_from"), F.least(rank("a"), "_b").getField("label").alias("_to"))
        step = save(first, "step")
        # two pointer jumps: what a label hangs on hangs in turn
        jump = step.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        far = step.join(jump, "_to", "left").select("_from", F.coalesce("_next", "_to").alias("_to"))
        far = save(far, "far")
        moved = labels.join(far, labels.component == far["_from"], "left").select("node", F.coalesce("_to", "component").alias("component"))
        new_labels = save(moved, "labels")
        first = far.select(F.col("_from").alias("a"), F.col("_to").alias("_a"))
        second = far.select(F.col("_from").alias("b"), F.col("_to").alias("_b"))
        joined = left.join(first, "a", "left").join(second, "b", "left")
        new_left = save(joined.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        for old in (left, labels, step, far):
            drop(edges.sparkSession, old)
        left, labels = new_left, new_labels
