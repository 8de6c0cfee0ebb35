"""Greedy choices over components held in arrays, against the plain kernels; no component becomes a frame of all its links."""

import random

import pytest

from linkloom.operators import greedy, kernels as K


def _links(seed: int) -> dict:
    rng = random.Random(seed)
    return {(a, b): rng.choice([1, 1, 1, 2, 3, 400]) for a in range(1, 61) for b in range(a + 1, 61) if rng.random() < 0.2}


@pytest.fixture(scope="module")
def parts(spark):
    """Two groups of links, which share their names."""
    both = {7: _links(1), 9: _links(2)}
    edges = spark.createDataFrame([(g, a, b, float(n)) for g, w in both.items() for (a, b), n in w.items()], "grp long, a long, b long, links double")
    return both, edges


def _nodes(spark, both, schema, row):
    return spark.createDataFrame([(g, x, *row(x)) for g, w in both.items() for x in sorted({x for e in w for x in e})], f"grp long, ctg long, {schema}")


def test_alleles_resolved_as_by_the_kernel(parts):
    both, edges = parts
    want = {(g, x) for g, w in both.items() for x in K.resolve_alleles(sorted({x for e in w for x in e}), [e for e, n in w.items() if n >= 2], w)}
    assert {tuple(r) for r in greedy.resolved_alleles(edges, "links >= 2").collect()} == want


def test_copies_reassigned_as_by_the_kernel(spark, parts):
    both, edges = parts
    want = set()
    for g, w in both.items():
        nodes = sorted({x for e in w for x in e})
        groups = {k: [x for x in nodes if x % 3 == k and x % 4] for k in range(3)}
        got = K.reassign_copies({x: 1 + x % 4 for x in nodes if x % 4 == 0}, groups, w, {e for e, n in w.items() if n >= 3}, {x: 10 + x % 7 for x in nodes}, 1.2)
        want |= {(g, c, h) for c, hs in got.items() for h in hs}
    nodes = _nodes(spark, both, "home long, copies long, len long", lambda x: (x % 3 if x % 4 else None, None if x % 4 else 1 + x % 4, 10 + x % 7))
    found = greedy.reassigned_copies(edges.selectExpr("*", "links >= 3 AS kin"), nodes, [0, 1, 2], 1.2).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_rounds_by_density_as_by_the_kernel(spark, parts):
    both, edges = parts
    want = set()
    for g, w in both.items():
        nodes = sorted({x for e in w for x in e})
        want |= {(g, *r) for r in K.reassignment_rounds({x: x % 4 if x % 3 else None for x in nodes}, w, {x: 10 + x % 7 for x in nodes}, {x: 2 + x % 5 for x in nodes}).items()}
    nodes = _nodes(spark, both, "home long, len long, sites long", lambda x: (x % 4 if x % 3 else None, 10 + x % 7, 2 + x % 5))
    assert {tuple(r) for r in greedy.reassigned_by_density(edges, nodes).collect()} == want


@pytest.mark.parametrize("name", ["allele_resolution", "collapsed_reassignment", "reassignment_rounds"])
def test_no_component_is_one_frame(spark, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, __spark_entry__.SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
