"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens these paths by doubling until each leads to
    its end, and contracts the links. A star takes one round, a chain one round of logarithmically many doublings.
    Links are grouped with partial aggregation, so a hub costs its tasks only their own part.
    """
    rounds: list[DataFrame] = []
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "links")
    while not edges.isEmpty():
        up = stored(both(edges).groupBy("a").agg(F.min("b").alias("m"))
                    .select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "hooks")
        while True:
            nxt = up.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            step = stored(up.join(nxt, "comp").select("node", F.col("far").alias("comp"),
                                                      (F.col("far") < F.col("comp")).alias("moved")), "jumps")
            up = step.select("node", "comp")
            if step.where("moved").isEmpty():
                break
        rounds.append(up)
        for c in ("a", "b"):
            edges = edges.join(up.select(F.col("node").alias(c), F.col("comp").alias("to")), c).drop(c).withColumnRenamed("to", c)
        edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = rounds[0]
    for up in rounds[1:]:
        later = up.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        out = out.join(later, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stored(out, "components") if len(rounds) > 1 else out
