"""Connected components of a graph given as a DataFrame of edges, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, *, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node that has an edge.

    Labels only fall, so the rounds end. Each takes the least label among a node's neighbours for the node and for
    the node that its label names (so whole trees are hooked at once), and then the label of its label; paths
    of any order of ids take rounds in the logarithm of their length. Aggregates are partial before they are
    shuffled; joins on a hub are left to adaptive skew splitting. Each round is checkpointed, so no lineage
    grows, and only one sum reaches the driver. Edges may repeat, point either way or be loops; null ends are
    dropped; no edges give no rows.
    """
    e = edges.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y")).dropna()
    both = cut(e.union(e.select("y", "x")).union(e.select("x", "x")).union(e.select("y", "y")).distinct())
    if both.isEmpty():
        return both.select(F.col("x").alias("node"), F.col("y").alias("component"))
    total = lambda df: df.agg(F.sum(F.col("lab").cast("decimal(38,0)"))).first()[0]
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("lab")))
    before = total(labels)
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("lab").alias("least"))
        own = near.join(labels, near["x"] == labels["node"]).select("x", "lab", F.least("lab", "least").alias("least"))
        hooked = own.select(F.col("x").alias("node"), F.col("least").alias("lab")).union(own.select("lab", "least")).groupBy("node").agg(F.min("lab").alias("lab"))
        up = hooked.select(F.col("node").alias("at"), F.col("lab").alias("up"))
        labels = cut(hooked.join(up, hooked["lab"] == up["at"]).select("node", F.least("lab", "up").alias("lab")))
        now = total(labels)
        if now == before:
            return labels.select("node", F.col("lab").alias("component"))
        before = now
