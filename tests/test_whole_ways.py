"""Ways of any length in graphs."""

from linkloom.operators import graph as G


def test_a_long_way_makes_an_edge_needless(spark):
    way = [(k, k + 1) for k in range(9)]
    df = spark.createDataFrame([*way, (0, 9), (20, 21), (0, 5)], "src long, dst long")
    assert {tuple(r) for r in G.transitive_reduction(df).collect()} == {*way, (20, 21)}


def test_chains_are_followed_to_their_end(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (99, 100)]
    got = {r.node: (r.end, r.steps) for r in G.follow_single(spark.createDataFrame(edges, "src long, dst long"), 4).collect()}
    assert {n: v for n, v in got.items() if n < 40} == {k: (40, 40 - k) for k in range(40)}
    assert got[99] == (100, 16) and got[100] == (101, 16)
