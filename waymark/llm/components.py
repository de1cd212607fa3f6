"""Connected components by hooking and shortcutting, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, stash


def components(edges: DataFrame, most: int = 0) -> DataFrame:
    """(a, b) links of long ids -> (node, label): label is the smallest id reachable from node.

    Each round every node and its parent take the smallest parent among the node's neighbours, then parents are
    replaced by their parents. A hub's links are dealt by a join that Spark can split and are reduced by partial
    minima, so no task holds a node's whole neighbourhood. Up to `most` nodes are joined by broadcast. Nulls link nothing; no
    links give no rows.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stash(pairs.union(pairs.select("b", "a")).toDF("u", "v").distinct())
    state = stash(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("p")))
    nodes = state.count() if most else 0
    wanted = (lambda df: few(df, nodes, most)) if most else (lambda df: df)
    while True:
        near = both.join(wanted(state), both.u == state.node).groupBy("v").agg(F.min("p").alias("m"))
        seen = wanted(state).join(near, state.node == near.v).select("node", "p", "m")
        offers = seen.select("node", F.least("p", "m").alias("val"), F.col("p").alias("old")).union(
            seen.select(F.col("p").alias("node"), F.col("m").alias("val"), F.lit(None).cast("long").alias("old"))
        )
        hooked = stash(offers.groupBy("node").agg(F.min("val").alias("p"), F.max("old").alias("old")))
        up = hooked.select(F.col("node").alias("parent"), F.col("p").alias("grand"))
        after = stash(hooked.join(wanted(up), hooked.p == up.parent).select("node", F.col("grand").alias("p"), "old"))
        changed = after.where("p <> old").limit(1).count()
        discard(state)
        discard(hooked)
        state = after.select("node", "p")
        if not changed:
            discard(both)
            return state.select("node", F.col("p").alias("label"))
