"""Connected components in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowlark.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of edges (a, b): root is the smallest node that can be reached.

    Each round takes the least root among a node's neighbours and then its root's root, so a path's length at least halves.
    Lineage is cut every round; nothing but a changed count reaches the driver.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        moved = state.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        moved = checkpointed(moved)
        heads = moved.select(F.col("node").alias("head"), F.col("root").alias("top"))
        state = checkpointed(moved.join(heads, F.col("root") == F.col("head")).select("node", F.col("top").alias("root"), (F.col("top") != F.col("was")).alias("moved")))
        if not state.where("moved").limit(1).count():
            return state.select("node", "root")
        state = state.select("node", "root")
