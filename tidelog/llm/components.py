"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import forget, keep


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that is not the smallest of its component.

    ``edges`` has long columns ``a`` and ``b``; order, repeats and loops do not matter and
    a null end drops the edge. Rounds of large-star and small-star turn each component into
    a star around its smallest node in a number of rounds that grows with the logarithm of
    its diameter. Each round is a minimum per node (partial aggregation takes the heat off
    hubs) and a join of edges with those minima; the minima are read from a written table,
    so that adaptive execution can split a hub's partition.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e, state = keep(e, "edges"), None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)
        before, both = e, e.select("u", "v").union(e.select("v", "u"))
        low = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large-star")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large-edges")
        lower = keep(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = keep(small.union(lower.select("u", "m")).distinct(), "edges")
        forget(before, low, large, lower)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
