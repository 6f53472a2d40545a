"""Parent-child tables: document order, depth and ancestors, whatever the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filament.runtime import durable


def walk(nodes: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(id, parent, depth, path, chain) of every node that a root reaches; roots have a null parent.

    ``nodes`` has (id, parent, ord). ``path`` holds the ordinals from the root down, so ordering by
    it is document order; ``chain`` holds the ids. One join a level, each level written; nodes of a
    cycle are reached from no root and left out, as are those whose parent is missing.
    """
    n = durable(nodes.select("id", "parent", F.col("ord").cast("bigint").alias("ord")), "tree")
    level = n.where("parent is null").select("id", "parent", F.lit(0).alias("depth"), F.array("ord").alias("path"), F.array("id").alias("chain"))
    done = []
    for depth in range(max_depth):
        level = durable(level, "level")
        if not level.take(1):
            break
        done.append(level)
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("up"), F.col("chain").alias("ups"))
        level = n.join(up, "parent").select("id", "parent", F.lit(depth + 1).alias("depth"), F.concat("up", F.array("ord")).alias("path"), F.concat("ups", F.array("id")).alias("chain"))
    out = done[0] if done else level
    for x in done[1:]:
        out = out.union(x)
    return out
