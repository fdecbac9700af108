"""Connected components by repeated contraction, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import stored

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node of the component.

    A round maps each node to the one of itself and its neighbours that comes first in an order drawn anew by hash, then
    replaces the ends of all edges by what they map to. Edges that fall together vanish, and of a chain half of the
    nodes go each round, however its ids run; the number of rounds grows with the logarithm of the longest chain. Each round's map and edges are written tables. Degrees may be
    unbounded: the minimum is pre-aggregated and the joins have one row per node on the right.
    Nulls, loops and repeated edges are ignored. An empty input gives an empty result.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    maps = []
    for turn in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b"), F.col("a")))
        drawn = lambda x, turn=turn: F.struct(F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("id"))
        firsts = ends.groupBy("node").agg(F.min(drawn("other")).alias("near"))
        to = stored(firsts.select("node", F.least(drawn("node"), "near")["id"].alias("root")), "component-map")
        maps.append(to)
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def follow(found: DataFrame, to: DataFrame) -> DataFrame:
        nxt = to.select(F.col("node").alias("at"), F.col("root").alias("next"))
        return found.join(nxt, found["root"] == nxt["at"], "left").select("node", F.coalesce("next", "root").alias("root"))

    found = reduce(follow, maps[1:], maps[0])
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))
