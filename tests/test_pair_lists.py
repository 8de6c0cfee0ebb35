"""Pairs of many members come from lists, neither compared with one another nor gathered by group."""

import pytest

from linkloom.operators import graph as G
from linkloom.operators import joins


@pytest.mark.parametrize("size", [2, 1024])
def test_members_of_several_groups(spark, monkeypatch, size):
    monkeypatch.setattr(joins, "LIST", size)
    members = {(c, c % 3) for c in range(12)} | {(c, 1) for c in (3, 6, 9)} | {(5, 5), (None, 1), (4, None)}
    pairs = [(0, 1), (1, 2), (0, 5), (1, 1), (2, 0)]
    m = [x for x in members if None not in x]
    want = {(min(x, y), max(x, y)) for a, b in pairs for x, g in m if g == a for y, h in m if h == b and x != y}
    df = joins.expand_members(spark.createDataFrame(pairs, "g1 long, g2 long"), spark.createDataFrame(sorted(members, key=str) + [(5, 5)], "ctg long, grp long"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # no pair is compared with the others


@pytest.mark.parametrize("size", [2, 1024])
def test_bubbles_of_a_large_group(spark, monkeypatch, size):
    monkeypatch.setattr(joins, "LIST", size)
    edges = [(0, k) for k in range(1, 8)] + [(k, 90) for k in range(1, 6)] + [(6, 91), (7, 91)]
    df = G.bubbles(spark.createDataFrame(edges, "src long, dst long"))
    got = [tuple(r) for r in df.collect()]
    want = {(x, y) for x in range(1, 6) for y in range(x + 1, 6)} | {(6, 7)}
    assert len(got) == len(want) and set(got) == want
    assert "xs" in df._jdf.queryExecution().optimizedPlan().toString()
