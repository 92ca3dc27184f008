"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.session import stored


def component_labels(edges: DataFrame) -> DataFrame:
    """``node, label`` (smallest node reachable) of every node that has an edge.

    Alternating star rounds: each node's larger, then smaller neighbours are attached to the
    smallest node of its neighbourhood, until every edge points at the label. The number of
    rounds is logarithmic in practice; a star of any size aggregates before it moves. Each
    round is a table in the shared folder; the driver only reads whether anything changed.
    """
    pairs = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        large = _star(pairs.select("u", "v").union(pairs.select("v", "u")), larger=True)
        small = stored(_star(large, larger=False), "stars")
        # Settled: every node on the left points at a node that is on no left side itself.
        moved = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        twice = small.groupBy("u").count().where("count > 1")
        if moved.isEmpty() and twice.isEmpty():
            ends = small.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return small.select(F.col("u").alias("node"), F.col("v").alias("label")).union(ends)
        pairs = small


def _star(directed: DataFrame, larger: bool) -> DataFrame:
    """Neighbours ``v`` of each ``u`` attached to the smallest of ``u`` and its neighbours.

    ``larger``: only neighbours above ``u`` move; else the neighbours below and ``u`` itself.
    """
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = directed.join(least, "u")
    if larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()
