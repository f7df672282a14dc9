"""Connected components of a large undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); nodes share a root if a path joins them.

    Each round, every node moves to the neighbour (or itself) of least hash, with a new hash each round, and edges
    move along; an edge to the chosen neighbour stays an edge, so no link is lost, and the number of nodes falls by a
    constant factor. A node's neighbours are only reduced to their least, never gathered; each round is written, so
    it survives lost executors. Loops and repeated edges do no harm; no edges give no rows.
    """
    current = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        salt = len(maps)

        def order(name: str, salt: int = salt):
            return F.struct(F.xxhash64(F.col(name), F.lit(salt)).alias("h"), F.col(name).alias("node"))

        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = written(least.select(F.col("a").alias("node"), F.least("m", order("a"))["node"].alias("to")), "step")
        maps.append(step)
        left = current.join(step, current.a == step.node).select(F.col("to").alias("pa"), "b")
        moved = left.join(step, left.b == step.node).select("pa", F.col("to").alias("pb"))
        after = moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        after = written(after, "edges")
        discard(current)
        current = after
    discard(current)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    out = maps[0].withColumnRenamed("to", "root")
    for step in maps[1:]:
        on = step.select(F.col("node").alias("_n"), "to")
        out = out.join(on, out.root == on._n, "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
