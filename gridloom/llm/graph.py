"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import materialize, scratch


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``edges`` (a, b) to (node, root): root is the smallest node of the component.

    Only nodes with an edge to another node appear. Each round hangs every node's larger
    neighbours, then its smaller ones, from the smallest neighbour, until nothing changes.
    Hubs are never gathered: a hub's smallest neighbour is a partial aggregate, and joins
    on hubs are plain equi-joins that adaptive execution splits.
    """
    with scratch(edges.sparkSession):
        now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        last = None
        for _ in range(limit):
            mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if mark == last:
                break
            last = mark
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        else:
            raise RuntimeError(f"components did not settle in {limit} rounds")
        return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "components", keep=True)
