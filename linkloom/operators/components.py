"""Connected components of an undirected edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from linkloom.functions.storage import stored


def kept(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """df stored, and how many of its rows there are (for which `what` holds), counted as they are written."""
    seen = Observation()
    table = stored(df.observe(seen, F.count(F.lit(1) if what is None else F.when(what, 1)).alias("n")), few=True)
    return table, seen.get["n"]


def roots(points: DataFrame) -> DataFrame:
    """(tree, to): where pointers (tree, to) lead in the end.

    Followed long enough each pointer comes to a pair that point at each other; the smaller one of it is the root. Pointers
    double, so the rounds are the logarithm of the longest way.
    """
    back = points.select(F.col("tree").alias("to"), F.col("to").alias("back"))
    root = F.when((F.col("back") == F.col("tree")) & (F.col("tree") < F.col("to")), F.col("tree")).otherwise(F.col("to"))
    to, moved = points.join(back, "to").select("tree", root.alias("to")), 1
    while moved:
        onward = to.select(F.col("tree").alias("to"), F.col("to").alias("next"))
        jumped, moved = kept(to.join(onward, "to").select("tree", "next", "to"), F.col("next") != F.col("to"))
        to = jumped.select("tree", F.col("next").alias("to"))
    return to


def contracted(edges: DataFrame, to: DataFrame, *more: str) -> DataFrame:
    """Edges (x, y, ...) between the roots of their trees, those inside one left out.

    Both sides of each join are stored tables, so Spark may split a tree, or a hub, that has very many edges.
    """
    ends = edges.join(to.select(F.col("tree").alias("x"), F.col("to").alias("cx")), "x").join(to.select(F.col("tree").alias("y"), F.col("to").alias("cy")), "y")
    return ends.where("cx <> cy").select(*more, F.col("cx").alias("x"), F.col("cy").alias("y"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is its smallest reachable node.

    In each round every tree points to its smallest neighbour (a minimum, aggregated before any shuffle, so that a node with
    very many edges gathers no list), trees that point to one another become one, and their number halves at least. Edges inside a
    tree leave, equal ones become one. Rows with a null end and self loops are ignored.
    """
    x, y = F.col(a), F.col(b)
    left, n = kept(edges.where(x != y).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct())
    maps: list[DataFrame] = []
    while n:
        least = left.select(F.col("x").alias("tree"), F.col("y").alias("to")).union(left.select("y", "x")).groupBy("tree").agg(F.min("to").alias("to"))
        maps.append(roots(stored(least, few=True)))
        between = contracted(left, maps[-1])
        left, n = kept(between.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    if not maps:
        return left.select(F.col("x").alias("node"), F.col("y").alias("component"))
    found = maps.pop()  # trees of the last round; those of earlier ones are led there, from few to many
    while maps:
        found = stored(maps.pop().join(found.select(F.col("tree").alias("to"), F.col("to").alias("end")), "to", "left").select("tree", F.coalesce("end", "to").alias("to")), few=True)
    least = stored(found.groupBy("to").agg(F.min("tree").alias("component")), few=True)
    return found.join(least, "to").select(F.col("tree").alias("node"), "component")
