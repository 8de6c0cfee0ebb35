"""Distributed forests and orders against the single-machine kernels and planted structure."""

import random

import pytest

from linkloom.operators import kernels as K
from linkloom.operators.ordering import merge_order, spanning_forest

HALVES = "a long, a_half string, b long, b_half string, n long"


def kruskal(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = set()
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, w))
    return out


def forest(spark, edges):
    return {tuple(r) for r in spanning_forest(spark.createDataFrame(edges, "a long, b long, links long")).collect()}


def test_forest_is_that_of_kruskal(spark):
    r = random.Random(3)
    edges = {(a, b): r.randint(1, 5) for a, b in ((r.randint(0, 150), r.randint(0, 150)) for _ in range(500)) if a < b}  # many ties
    edges |= {(200, k): 3 for k in range(201, 400)}  # a hub
    edges |= {(k, k + 1): k % 4 for k in range(500, 560)}  # a chain
    rows = [(a, b, w) for (a, b), w in edges.items()]
    assert forest(spark, rows) == kruskal(rows)


def test_forest_of_odd_edges(spark):
    assert forest(spark, []) == set()
    assert forest(spark, [(1, 1, 5), (2, 1, 3), (1, 2, 4), (1, 2, 4)]) == {(1, 2, 4)}


def planted(seed, chains, spread=0):
    """Lengths and half links of chains of contigs in known orders, with some far links."""
    r = random.Random(seed)
    lengths, links, truth, name = {}, {}, [], 0
    for size in chains:
        tour = []
        for _ in range(size):
            lengths[name] = r.randint(80, 160)
            tour.append((name, r.choice("+-")))
            name += 1
        truth.append(tour)
    names = list(range(name))
    r.shuffle(names)
    lengths = {names[k]: v for k, v in lengths.items()}
    truth = [[(names[c], o) for c, o in t] for t in truth]
    put = lambda x, y, n: links.__setitem__((min(x, y), max(x, y)), links.get((min(x, y), max(x, y)), 0) + n)
    for t in truth:
        for (c, o), (d, p) in zip(t, t[1:]):
            put((c, "T" if o == "+" else "H"), (d, "H" if p == "+" else "T"), r.randint(900, 1100))
            put((c, "H" if o == "+" else "T"), (d, "H" if p == "+" else "T"), r.randint(100, 150))
            put((c, "T" if o == "+" else "H"), (d, "T" if p == "+" else "H"), r.randint(100, 150))
        for k in range(spread):
            c, d = r.sample(t, 2) if len(t) > 1 else (t[0], t[0])
            if c != d:
                put((c[0], r.choice("HT")), (d[0], r.choice("HT")), r.randint(1, 20))
    return lengths, links, truth


def ordered(spark, lengths, links, **how):
    contigs = spark.createDataFrame(list(lengths.items()), "ctg long, len long")
    rows = [(a, x, b, y, n) for ((a, x), (b, y)), n in links.items()]
    tours = {}
    for r in sorted(merge_order(contigs, spark.createDataFrame(rows, HALVES), **how).collect(), key=lambda r: (r.scaffold, r.ord)):
        tours.setdefault(r.scaffold, []).append((r.ctg, r.orient))
        assert r.ord == len(tours[r.scaffold]) - 1
    return list(tours.values())


def either_way(tour):
    back = [(c, "-" if o == "+" else "+") for c, o in reversed(tour)]
    return min(map(tuple, (tour, back)))


@pytest.mark.parametrize("how", [{}, {"reach": 200.0}])
def test_planted_chains(spark, how):
    lengths, links, truth = planted(1, [40, 17, 6, 2, 1], spread=30)
    got = ordered(spark, lengths, links, **how)
    assert {either_way(t) for t in got} == {either_way(t) for t in truth}
    assert {either_way(t) for t in got} == {either_way(t) for t in K.merge_order(lengths, links, **how)}
    sizes = [sum(lengths[c] for c, _ in t) for t in got]
    assert sizes == sorted(sizes, reverse=True)


def test_rings_are_opened_where_least_sure(spark):
    lengths, links, truth = planted(5, [9])
    (c, o), (d, p) = truth[0][-1], truth[0][0]
    x, y = (c, "T" if o == "+" else "H"), (d, "H" if p == "+" else "T")
    links[min(x, y), max(x, y)] = 300
    got = ordered(spark, lengths, links)
    assert [either_way(t) for t in got] == [either_way(t) for t in K.merge_order(lengths, links)] == [either_way(truth[0])]


def test_first_rounds_are_those_of_the_kernel(spark):
    """On random links each join of the first round is one that the kernel makes."""
    r = random.Random(9)
    lengths = {k: r.randint(50, 99) for k in range(60)}
    links = {((a, r.choice("HT")), (b, r.choice("HT"))): r.randint(1, 40) for a, b in ((r.randint(0, 59), r.randint(0, 59)) for _ in range(150)) if a < b}
    got = {either_way(t) for t in ordered(spark, lengths, links, gain=0.9)}  # one round
    ends = {}
    for (x, y), n in links.items():
        d = n / (lengths[x[0]] * lengths[y[0]])
        ends.setdefault(x, []).append((d, y))
        ends.setdefault(y, []).append((d, x))
    best = {}
    for x, l in ends.items():
        l.sort(key=lambda e: -e[0])
        if len(l) == 1 or l[0][0] > l[1][0]:
            best[x] = l[0][1]
    joins = {(x, y) for x, y in best.items() if best.get(y) == x}
    left = {(c, "T" if o == "+" else "H") for t in got for c, o in t[:-1]}
    made = {((c, "T" if o == "+" else "H"), (d, "H" if p == "+" else "T")) for t in got for (c, o), (d, p) in zip(t, t[1:])}
    assert left and all(j in joins for j in made) and all(j in made or (j[1], j[0]) in made for j in joins)


def test_odd_contigs(spark):
    assert ordered(spark, {5: 7}, {}) == [[(5, "+")]]
    contigs = spark.createDataFrame([(None, 3), (1, None), (1, 4), (2, 9)], "ctg long, len long")
    got = merge_order(contigs, spark.createDataFrame([(1, "T", 2, "H", 3), (1, "T", 7, "H", 9), (None, "T", 2, "H", 3)], HALVES)).collect()
    assert sorted((r.scaffold, r.ord, r.ctg, r.orient) for r in got) == [(0, 0, 1, "+"), (0, 1, 2, "+")]
    with pytest.raises(ValueError):
        merge_order(contigs, spark.createDataFrame([], HALVES), cutoff=0.5)
