"""Transitive reduction by components, small ones in a kernel and large ones by rounds."""

import random

import pytest

from linkloom.operators import graph as G


def _edges():
    rng = random.Random(3)
    e = {(base + rng.randrange(9), base + rng.randrange(9)) for base in range(0, 200, 10) for _ in range(14)}  # circles and self loops too
    return sorted(e | {(500, 501), (501, 502), (500, 502), (600, 600)})


def _want(e):
    w = {(a, d) for a, b in e for c, d in e if b == c}
    while (m := w | {(a, d) for a, b in w for c, d in e if b == c}) != w:
        w = m
    return set(e) - w


@pytest.mark.parametrize("whole", [0, 12, 5000])
def test_equals_all_ways(spark, monkeypatch, whole):
    monkeypatch.setattr(G, "WHOLE", whole)
    rows = [*_edges(), (None, 500), (502, None)]
    got = [tuple(r) for r in G.transitive_reduction(spark.createDataFrame(rows + rows[:5], "src long, dst long")).collect()]
    assert len(got) == len(set(got)) and set(got) == _want(_edges()) | {(None, 500), (502, None)}


def test_small_components_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "_reduced_by_rounds", lambda *_: pytest.fail("pairs were shuffled by rounds"))
    chain = spark.createDataFrame([(k, k + d) for k in range(300) for d in (1, 2)], "src long, dst long")
    assert G.transitive_reduction(chain).where("dst <> src + 1").count() == 1  # the last one of two steps, which has no other way
