"""Connected components of a table of links, wholly as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rounds after which components gives up with an error; each one at least halves the longest path to a root.
MOST_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach, for every node of a link (columns a, b).

    Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger neighbours, then to its smaller ones.  Minima combine on
    the map side and the joins can be split by AQE, so a node of very many links is
    not one task's work.  Null ends are left out; repeated links count once.  The
    result is complete: if it does not settle, an error is raised.
    """
    pairs = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(pairs.distinct())
    last = None
    for _ in range(MOST_ROUNDS):
        # larger neighbours of u get the smallest of u's neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # u and its smaller neighbours get the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
