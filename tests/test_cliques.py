"""Allele groups and linearised graphs against sequential kernels and plain definitions."""

import random
from itertools import combinations

from linkloom.operators import kernels as K
from linkloom.operators.cliques import allele_groups
from linkloom.operators.directed import linearised


def graphs():
    """Weighted undirected graphs over nodes of their own, small enough for brute force, then a clique, a hub and a bipartite one."""
    r, base = random.Random(3), 0
    for _ in range(60):
        n = r.randint(2, 9)
        yield {(base + a, base + b): r.randint(1, 4) for a, b in combinations(range(n), 2) if r.random() < r.choice([0.3, 0.6, 0.9])}
        base += n
    yield {(base + a, base + b): (a * 7 + b) % 5 + 1 for a, b in combinations(range(9), 2)}
    base += 9
    yield {(base, base + k): 1 for k in range(1, 400)} | {(base + k, base + k + 1): 2 for k in range(1, 399)}
    base += 400
    yield {(base + a, base + 20 + b): 1 for a in range(20) for b in range(20)}


def by_definition(weights):
    """Sets of nodes that are cliques and that no other node can join, by trying all of them."""
    nodes = sorted({x for e in weights for x in e})
    linked = lambda x, y: (min(x, y), max(x, y)) in weights
    for k in range(2, len(nodes) + 1):
        for c in combinations(nodes, k):
            if all(linked(*e) for e in combinations(c, 2)) and not any(all(linked(x, y) for y in c) for x in nodes if x not in c):
                yield c


def test_allele_groups_are_the_maximal_cliques(spark):
    parts = list(graphs())
    edges = [(b, a, w) if (a + b) % 2 else (a, b, w) for g in parts for (a, b), w in g.items()]
    df = spark.createDataFrame(edges, "a long, b long, links long")
    got = [tuple(r.members) for r in allele_groups(df, 1000).collect()]
    assert len(got) == len(set(got))
    small = {x for g in parts[:60] for e in g for x in e}
    assert {c for c in got if c[0] in small} == {c for g in parts[:60] for c in by_definition(g)}
    assert set(got) == set(K.maximal_cliques([e for g in parts for e in g]))


def test_allele_groups_split_to_the_ploidy(spark):
    weights = {e: w for g in graphs() for e, w in g.items()}
    df = spark.createDataFrame([(*e, w) for e, w in weights.items()], "a long, b long, links long").repartition(7)
    for ploidy in (2, 3, 4):
        got = [tuple(r.members) for r in allele_groups(df, ploidy).collect()]
        assert sorted(got) == K.cliques_of_ploidy(weights, ploidy) and max(map(len, got)) == ploidy


def test_a_clique_is_split_by_itself(spark):
    # 1-2-3-4 is one clique and 3-4-5 another: the weakest edge of the first, 3-4, stays in the second.
    rows = [(1, 2, 9), (1, 3, 9), (1, 4, 9), (2, 3, 9), (2, 4, 9), (3, 4, 1), (3, 5, 5), (4, 5, 5)]
    got = allele_groups(spark.createDataFrame(rows, "a long, b long, links long"), 3)
    assert sorted(tuple(r.members) for r in got.collect()) == [(1, 2, 3), (1, 2, 4), (3, 4, 5)]


def test_allele_groups_of_messy_rows(spark):
    rows = [(1, 2, 1), (2, 1, 1), (1, 2, 1), (2, 3, 1), (1, 3, 2), (4, 4, 9), (None, 1, 3), (1, None, 3), (3, 5, None), (None, None, None)]
    df = spark.createDataFrame(rows, "x long, y long, v long").selectExpr("x", "y", "v", "'?' AS w", "0 AS members")
    assert [r.members for r in allele_groups(df, 3, "x", "y", "v").collect()] == [[1, 2, 3]]
    # 1-2 weighs 3, 1-3 weighs 2, 2-3 weighs 1: it is the weakest edge.
    assert sorted(r.members for r in allele_groups(df, 2, "x", "y", "v").collect()) == [[1, 2], [1, 3]]
    assert allele_groups(df.limit(0), 2, "x", "y", "v").count() == 0


def test_linearised_as_by_the_sequential_walk(spark):
    r, edges, base = random.Random(9), set(), 0
    for _ in range(120):
        n = r.randint(2, 14)
        edges |= {(base + r.randrange(n), base + r.randrange(n)) for _ in range(r.randint(1, 2 * n))}
        base += n
    edges |= {(base, base + k) for k in range(1, 500)} | {(base + 499, base + 500)}  # a hub whose dead ends go
    lengths = {x: r.randrange(20) for e in edges for x in e}
    rows = [(a, b, lengths[a], lengths[b]) for a, b in edges]
    df = spark.createDataFrame(rows + rows[:40] + [(None, 1, 3, 3), (1, None, 3, 3)], "src long, dst long, src_len long, dst_len long")
    for short in (0, 8, 20):
        assert sorted((x.src, x.dst) for x in linearised(df, short).collect()) == K.linearise(list(edges), lengths, short)
    assert linearised(df.limit(0), 5).count() == 0
    bare = spark.createDataFrame([(1, 2, None, None)], "src long, dst long, src_len long, dst_len long")
    assert [(x.src, x.dst) for x in linearised(bare, 5).collect()] == [(1, 2)]
