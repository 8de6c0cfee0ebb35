"""Allele groups: maximal cliques of a link table, split down to the ploidy, a task a node's later neighbourhood."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.storage import stored
from linkloom.operators.kernels import listed


def _maximal(inside: dict, outside: dict) -> Iterator[frozenset]:
    """Sets of keys of `inside` (node -> neighbours among the keys) that are cliques no key, and no key of `outside`
    (node -> its neighbours among the keys of `inside`), can be added to."""
    near = inside | outside
    stack = [(frozenset(), frozenset(inside), frozenset(outside))]
    while stack:
        chosen, able, seen = stack.pop()
        if not able:
            if not seen:
                yield chosen
            continue
        pivot = max(able | seen, key=lambda x: len(able & near[x]))
        for x in able - near[pivot]:
            stack.append((chosen | {x}, able & near[x], frozenset(y for y in seen if x in near[y])))
            able, seen = able - {x}, seen | {x}


def _split(clique: tuple, weight: dict, ploidy: int, done: set) -> Iterator[tuple]:
    """Sorted groups of at most `ploidy` members that are left of a clique when larger ones lose either end of their weakest edge."""
    todo = [clique]
    while todo:
        group = todo.pop()
        if group in done:
            continue
        done.add(group)
        if len(group) <= ploidy:
            yield group
            continue
        weakest = min(combinations(group, 2), key=lambda e: (weight[e], e))
        todo += [tuple(x for x in group if x != end) for end in weakest]


def allele_groups(edges: DataFrame, ploidy: int, a: str = "a", b: str = "b", weight: str = "links") -> DataFrame:
    """(members array<long>), distinct: maximal cliques of two members or more, those above `ploidy` split.

    A clique that is too large loses its weakest edge (least weight, then least names), which leaves two smaller ones, each
    without one of its ends, and so on; cliques are split by themselves, so a group may lie inside another one.

    Nodes are ordered by degree, then name, and each clique is found at its first node: from the edges to its later neighbours,
    at most the root of twice the edges, those among them (triangles at their first node), and those from earlier neighbours
    (triangles at their middle node), which tell whether a clique could still grow. So each triangle is sent twice, and a hub,
    which is late in the order, gets few. Rows with a null end or weight and self loops are ignored, weights of equal pairs
    (in either direction) are added; an empty table gives no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    pairs = stored(
        edges.where(F.col(weight).isNotNull() & (x != y)).groupBy(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).agg(F.sum(F.col(weight).cast("double")).alias("w")),
        few=True,
    )
    degree = stored(pairs.select("x").union(pairs.select("y")).groupBy("x").agg(F.count("*").alias("n")), few=True)
    ranked = pairs.join(degree.withColumnRenamed("n", "nx"), "x").join(degree.select(F.col("x").alias("y"), F.col("n").alias("ny")), "y")
    low, high = F.struct(F.col("nx").alias("n"), F.col("x").alias("v")), F.struct(F.col("ny").alias("n"), F.col("y").alias("v"))
    on = stored(ranked.select(F.least(low, high).alias("p"), F.greatest(low, high).alias("q"), "w").select(F.col("p.v").alias("v"), F.col("q.v").alias("p"), F.col("q.n").alias("n"), "w"), few=True)
    far = on.select("v", F.col("p").alias("q"), F.col("n").alias("m"))
    wedges = on.drop("w").join(far, "v").where("n < m or (n = m and p < q)").select("v", "p", "q")
    triangles = stored(wedges.join(on.select(F.col("v").alias("p"), F.col("p").alias("q"), "w"), ["p", "q"]).select("v", "p", "q", "w"))
    later, among, earlier = 0, 1, 2
    kind = lambda k: F.lit(k).alias("kind")
    around = (
        on.select("v", "p", F.col("p").alias("q"), "w", kind(later))
        .union(triangles.select("v", "p", "q", "w", kind(among)))
        .union(triangles.select(F.col("p").alias("v"), F.col("q").alias("p"), F.col("v").alias("q"), "w", kind(earlier)))
    )

    def found(v: int, kinds: list, ps: list, qs: list, ws: list) -> list[tuple]:
        inside: dict = {}
        outside: dict = defaultdict(set)
        weights = {}
        for k, p, q, w in zip(kinds, ps, qs, ws):  # by kind, so that all later nodes are known first
            if k == later:
                inside[p] = set()
                weights[min(v, p), max(v, p)] = w
            elif k == among:
                inside[p].add(q)
                inside[q].add(p)
                weights[min(p, q), max(p, q)] = w
            else:
                outside[q].add(p)
        done: set = set()
        cliques = _maximal(inside, dict(outside)) if inside else ()
        return [(list(s),) for c in cliques for s in _split(tuple(sorted(c | {v})), weights, ploidy, done)]

    return listed(around, "v", ["kind"], ["kind", "p", "q", "w"], "members array<long>", found).distinct()
