"""Connected components of graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.session import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of `links` (a, b): `node` and `root`, the smallest node of its component.

    Alternates two star contractions until nothing changes: each node's larger neighbours are hung on its
    smallest neighbour, then its smaller neighbours and itself are. Rounds are logarithmic in the length
    of a chain in practice; each ends in a reliable checkpoint. A hub's neighbours are never gathered in
    one task: the smallest is an aggregate combined before the shuffle, and joined back row by row.
    Nodes compare as text. Null ends are no links; a link of a node with itself makes it a component.
    """
    fit = links.filter("a is not null and b is not null").select(F.col("a").cast("string"), F.col("b").cast("string"))
    edges = cut(fit.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())

    def both(df: DataFrame) -> DataFrame:
        return df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = signature(edges)
    for _ in range(rounds):
        near = both(edges.filter("u <> v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").distinct()
        down = large.filter("u <> v").select(F.col("v").alias("big"), F.col("u").alias("small"))  # small < big
        lowest = down.groupBy("big").agg(F.min("small").alias("m"))
        small = down.join(lowest, "big").select(F.col("m").alias("u"), F.col("small").alias("v")).union(lowest.select(F.col("m").alias("u"), F.col("big").alias("v")))
        edges = cut(small.union(edges.filter("u = v").select("u", "v")).distinct())
        now = signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    hung = edges.filter("u <> v").select(F.col("v").alias("node"), F.col("u").alias("root"))
    return hung.union(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
