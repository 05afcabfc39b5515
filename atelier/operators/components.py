"""Connected components by contraction of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def components(edges: DataFrame, a: str, b: str, node: str = "node", label: str = "component", rounds: int = 200) -> DataFrame:
    """``node, label``: for each end of an edge the least node it is connected to.

    Each round orders the nodes that still have edges by a hash of its own and merges each into the
    first of those within two steps. In a random order a quarter of the nodes at least goes each
    round on average, whatever the ids and the shape of the graph, so rounds grow with the logarithm of the
    number of nodes. What is left of the graph and the merges of each round are written to the
    shared folder; rounds end when no edge is left. More than ``rounds`` raise an error.
    Loops and repeated edges change nothing; null ends are ignored; no edges, no rows.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    both = cut(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    every = both.count()
    live, now = both.filter("x <> y"), cut(both.select("x", F.col("x").alias("l")).distinct(), every)
    for turn in range(rounds + 1):
        if not (left := live.count()):
            break
        if turn == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
        near = cut(live.groupBy("x").agg(F.min(place("y")).alias("m")).select("x", F.least("m", place("x")).alias("m")), left)
        far = live.join(near.select(F.col("x").alias("y"), F.col("m").alias("n")), "y").groupBy("x").agg(F.min("n").alias("n"))
        to = cut(near.join(far, "x").select("x", F.least("m", "n")["v"].alias("to")), left)
        one = live.join(to, "x").select(F.col("to").alias("p"), "y")
        live = cut(one.join(to.select(F.col("x").alias("y"), F.col("to").alias("q")), "y").filter("p <> q").select(F.col("p").alias("x"), F.col("q").alias("y")).distinct(), left)
        now = cut(now.join(to.select(F.col("x").alias("l"), "to"), "l", "left").select("x", F.coalesce("to", "l").alias("l")), every)
    least = now.groupBy("l").agg(F.min("x").alias("least"))
    return cut(now.join(least, "l").select(F.col("x").alias(node), F.col("least").alias(label)), every)
