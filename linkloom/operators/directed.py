"""Directed edge tables: strong components by trimming, contraction of chains and colours, and linearisation; each step is a join or an aggregation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.storage import stored
from linkloom.operators.components import kept


class Chains(NamedTuple):
    """Nodes with a single way on, that were merged with the node where it ends."""

    root: DataFrame  #: (node, root)
    levels: list[DataFrame]  #: (node, to) after 1, 2, 4, ... steps, no further than the root
    into: DataFrame  #: (other, node): edges from nodes that stay to merged ones


def _doubled(points: DataFrame, n: int) -> tuple[list[DataFrame], int]:
    """(node, to, least) after 1, 2, 4, ... steps along n pointers, and how many go on forever: those that come to a circle.

    A way ends at a node without a pointer; `least` is the smallest node passed.
    """
    levels, going, steps = [points.withColumn("least", F.col("node"))], n, 1
    while going and steps < 2 * n:
        now = levels[-1]
        on = now.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        further = now.join(on, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), F.least("least", "least2").alias("least"), F.col("to2").isNotNull().alias("goes"))
        table, going = kept(further, F.col("goes"))
        levels.append(table.drop("goes"))
        steps *= 2
    return levels, going


def _merged(edges: DataFrame, near: str, far: str) -> tuple[DataFrame, int, Chains | None]:
    """Edges after each node with one edge only, from `near` to `far`, is merged with the node at the end of its way.

    Such a node is in the component of that end if and only if the end comes back to it or to a node before it on a way to it
    (`_told`); among the other nodes nothing changes. A circle of such nodes ends at its smallest one.
    """
    single = edges.groupBy(F.col(near).alias("node")).agg(F.min(far).alias("to"), F.count("*").alias("n")).where("n = 1").drop("n")
    points, n = kept(single)
    if not n:
        return edges, -1, None
    levels, circling = _doubled(points, n)
    if circling:
        # After at least n steps every way stands on its circle, and the smallest node passed from there on is that of the circle.
        last = levels[-1]
        on = last.join(points.select(F.col("node").alias("to")), "to", "left_semi").select(F.col("to").alias("node")).distinct()
        ends = last.join(on, "node", "left_semi").select(F.col("least").alias("node")).distinct()
        points, n = kept(points.join(ends, "node", "left_anti"))
        levels, _ = _doubled(points, n)
    root = levels[-1].select("node", F.col("to").alias("root"))
    stay = stored(edges.join(points.select(F.col("node").alias(near)), near, "left_anti").join(root.withColumnRenamed("node", far), far, "left"), few=True)
    into = stay.where("root is not null").select(F.col(near).alias("other"), F.col(far).alias("node"))
    new = stay.select(F.col(near), F.coalesce("root", far).alias(far)).where(F.col(near) != F.col(far)).select("src", "dst").distinct()
    return *kept(new), Chains(root, [x.select("node", "to") for x in levels], into)


def _told(found: DataFrame, chains: Chains) -> DataFrame:
    """found with the merged nodes that are in a component with others; (node, component), nodes alone are not listed."""
    of = lambda k, c: found.select(F.col("node").alias(k), F.col("component").alias(c))
    home = chains.root.join(of("root", "c"), "root", "left").select("node", F.coalesce("c", "root").alias("component"))
    back = chains.into.join(home, "node").join(of("other", "c"), "other", "left").where(F.coalesce("c", "other") == F.col("component"))
    inside = stored(back.select("node").distinct(), few=True)
    for level in chains.levels:
        inside = stored(inside.union(inside.join(level, "node").select("to")).distinct(), few=True)
    return stored(found.union(home.join(inside, "node", "left_semi").select("node", "component")), few=True)


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(node, component) of one component a colour, and the edges left, with their count.

    A node's colour is the smallest node from which it is reached; those that reach the node of their colour are its component.
    Edges between colours lie on no circle. Rounds are as many as the longest of the shortest ways.
    """
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colour, changed = stored(ends.withColumn("colour", F.col("node")), few=True), 1
    while changed:
        handed = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("least"))
        new = colour.join(handed, "node", "left").select("node", F.least("colour", "least").alias("colour"), (F.col("least") < F.col("colour")).alias("new"))
        table, changed = kept(new, F.col("new"))
        colour = table.drop("new")
    tinted = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("component")), "src")
    inner = stored(tinted.join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("component")), ["dst", "component"]).select("src", "dst", "component"), few=True)
    edge, gained = stored(colour.where("node = colour").select("node", F.col("colour").alias("component")), few=True), 1
    found = edge
    while gained:
        before = inner.join(edge.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "component").distinct()
        edge, gained = kept(before.join(found, "node", "left_anti"))
        found = stored(found.union(edge), few=True) if gained else found
    gone = lambda k: found.select(F.col("node").alias(k))
    return found, *kept(inner.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"))


def strong_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that it reaches and is reached from.

    In each round edges from nodes without one coming in, or to nodes without one going out, leave; nodes with a single edge out,
    then in, are merged with the end of their way by pointers that double, so that long chains and circles take few rounds; once that
    no longer makes the graph a tenth smaller, colours settle a component each. A node with very many edges gathers no list.
    Rows with a null end are ignored, nodes of self loops alone are components of their own; an empty table gives no rows.
    """
    given = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct(), few=True)
    left, n = kept(given.where("src <> dst"))
    chains: list[Chains] = []
    found = given.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    while n:
        before = n
        comes, goes = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left, n = kept(left.join(comes, "src", "left_semi").join(goes, "dst", "left_semi").select("src", "dst"))
        for near, far in (("src", "dst"), ("dst", "src")):
            if n:
                new, m, merged = _merged(left, near, far)
                if merged:
                    left, n = new, m
                    chains.append(merged)
        if n > 0.9 * before:
            some, left, n = _coloured(left)
            # Chains merged so far may end in these components, those merged later lie in none of them.
            found = stored(found.union(some), few=True)
    for merged in reversed(chains):
        found = _told(found, merged)
    nodes = given.select(F.col("src").alias("node")).union(given.select("dst")).distinct()
    named = stored(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("of")), few=True)
    least = stored(named.groupBy("of").agg(F.min("node").alias("component")), few=True)
    return named.join(least, "of").select("node", "component")


def _longest(edges: DataFrame, at: str, other: str) -> DataFrame:
    """The edge of each node `at` to the longest, then least, node `other`; a maximum, aggregated before the shuffle."""
    best = edges.groupBy(at).agg(F.max(F.struct(F.col(f"{other}_len").alias("len"), (-F.col(other)).alias("minus"), F.col(f"{at}_len").alias("own"))).alias("best"))
    return best.select(at, (-F.col("best.minus")).alias(other), F.col("best.own").alias(f"{at}_len"), F.col("best.len").alias(f"{other}_len"))


def linearised(edges: DataFrame, short: int) -> DataFrame:
    """(src, dst): edges (src, dst, src_len, dst_len), with the lengths of both nodes, after dead ends at branches are cut off.

    A dead end is a node shorter than `short` with a single edge, from a node with others out, or to a node with others in. All dead
    ends go at once, until there are none; then each node keeps its edge to the longest node (ties: the least), and of those each
    node its edge from the longest one. Degrees are counts joined to stored edges, so a hub gathers no list and may be split.
    Rows with a null end are ignored, equal ones count once, a null length counts as 0; an empty table gives no rows.
    """
    length = lambda k: F.coalesce(F.max(f"{k}_len"), F.lit(0)).alias(f"{k}_len")
    left, n = kept(edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(length("src"), length("dst")))
    while n:
        ends = left.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(left.select("dst", F.lit(0), F.lit(1)))
        degree = stored(ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")), few=True)
        of = lambda k: degree.select(F.col("node").alias(k), F.col("out").alias(f"{k}_out"), F.col("into").alias(f"{k}_into"))
        tip = "(src_out > 1 and dst_out = 0 and dst_into = 1 and dst_len < {0}) or (dst_into > 1 and src_into = 0 and src_out = 1 and src_len < {0})".format(short)
        marked = left.join(of("src"), "src").join(of("dst"), "dst").withColumn("tip", F.expr(tip))
        table, n = kept(marked.select("src", "dst", "src_len", "dst_len", "tip"), F.col("tip"))
        left = table.where("not tip").drop("tip") if n else left
    return _longest(_longest(left, "src", "dst"), "dst", "src").select("src", "dst")
