"""Strong components against the sequential walk, on one graph that holds shapes of every kind."""

import random

from linkloom.operators import kernels as K
from linkloom.operators.directed import strong_components


def shapes():
    """Edge lists over nodes of their own: random graphs, long chains and circles, hubs, circles with tails, circles that share a node."""
    r = random.Random(5)
    for _ in range(150):
        n = r.randint(2, 12)
        yield n, [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 2 * n))]
    yield 10_000, [(k, (k + 1) % 10_000) for k in r.sample(range(10_000), 10_000)]
    yield 5_000, [(k, k + 1) for k in range(4_999)]
    yield 3_000, [(k, k + 1) for k in range(2_999)] + [(2_000, 1_000), (2_999, 2_500)]
    yield 600, [(0, k) for k in range(1, 600)] + [(k, 0) for k in range(1, 600, 2)]
    yield 601, [(k, (k + 1) % 300) for k in range(300)] + [(0, 301), (600, 0)] + [(k, k + 1) for k in range(301, 600)]
    yield 64, [(8 * i + j, 8 * ((i + a) % 8) + (j + 1 - a) % 8) for i in range(8) for j in range(8) for a in (0, 1)]
    yield 80, [(r.randrange(80), r.randrange(80)) for _ in range(400)]


def test_strong_components_of_every_shape(spark):
    edges, base = [], 0
    for n, e in shapes():
        names = random.Random(base).sample(range(base, base + n), n)
        edges += [(names[a], names[b]) for a, b in e]
        base += n
    odd = [(None, 3), (3, None), (base + 5, base + 5)]
    got = strong_components(spark.createDataFrame(edges + edges[:50] + odd, "src long, dst long"))
    found = {x.node: x.component for x in got.collect()}
    assert found == K.strong_components(edges) | {base + 5: base + 5} and got.count() == len(found)


def test_no_edges(spark):
    assert strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0
