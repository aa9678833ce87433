"""Connected components by contraction of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.session import cut_lineage


def components(edges: DataFrame, max_levels: int = 100) -> DataFrame:
    """(node, label) for nodes with an edge: ``label`` is one node of the component, the same on every run.

    On every level a node goes to the neighbour (or itself) of the smallest hash, and links between different labels
    are the links of the next, smaller level. Hashes change with the level, so a chain shrinks by a share of its
    length, not by its ends. The result is exact or an error: the limit of levels never cuts it short.
    """
    levels: list[DataFrame] = []
    links = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    for level in range(max_levels):
        if levels and links.limit(1).count() == 0:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(level)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        label = cut_lineage(best.select(F.col("a").alias("node"), F.least(rank("a"), F.col("best")).alias("t")).select("node", F.col("t.n").alias("label")))
        levels.append(label)
        left = label.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = label.select(F.col("node").alias("b"), F.col("label").alias("y"))
        ends = links.join(left, "a").join(right, "b").filter("x <> y")
        links = cut_lineage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    found = levels.pop()
    while levels:
        above = found.select(F.col("node").alias("label"), F.col("label").alias("top"))
        found = levels.pop().join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return cut_lineage(found)
