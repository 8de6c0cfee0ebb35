"""Queries without an oracle see the whole input."""

import random

import numpy as np
import pandas as pd
import pytest

from linkloom.operators import kernels as K
from linkloom.plans import catalog

SF = "/root/testdata/sf0.001"


def _edges():
    x = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_partkey", "l_suppkey"])
    return {(int(a), int(b)) for a, b in zip(x.l_partkey, x.l_suppkey) if a != b}


def test_graph_queries_take_all_edges(spark):
    edges = _edges()
    nodes = {x for e in edges for x in e}
    got = {r.node: r.component for r in catalog.queries()["strong_components"](spark, SF).collect()}
    assert got == K.strong_components(list(edges)) and set(got) == nodes
    runs = catalog.queries()["acyclic_runs"](spark, SF).collect()
    assert sorted(r.node for r in runs) == sorted(nodes)
    line = {(r.src, r.dst) for r in catalog.queries()["linearised_edges"](spark, SF).collect()}
    assert line == set(K.linearise(list(edges), {x: x % 100 for x in nodes}, 50))


def test_cycles_are_broken_as_by_cutting_one_by_one():
    def slow(edges):
        left = dict(edges)
        while True:
            comp = K.strong_components(list(left))
            inner = [e for e in left if comp[e[0]] == comp[e[1]]]
            if not inner:
                return sorted(left)
            worst = {}
            for e in inner:
                worst[comp[e[0]]] = max(worst.get(comp[e[0]], (-1, e)), (left[e], e))
            for _, e in worst.values():
                del left[e]

    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 9)
        edges = {(r.randrange(n), r.randrange(n)): r.randrange(4) for _ in range(r.randint(1, 30))}
        assert K.break_cycles(edges) == slow(edges)


def test_link_kernels_take_all_links(spark):
    x = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_partkey", "l_suppkey", "l_linenumber"]).query("l_partkey != l_suppkey and l_linenumber >= 2")
    pairs = {(min(a, b), max(a, b)) for a, b in zip(x.l_partkey, x.l_suppkey)}
    nodes = {n for p in pairs for n in p}
    found = {(r.i, r.j) for r in catalog.queries()["balanced_matrix"](spark, SF).collect()}
    assert {(i, j) for i, j in found if i < j} == pairs
    for name in ("louvain_clusters", "linkage_clusters", "spectral_clusters", "fast_order"):
        assert {r.ctg for r in catalog.queries()[name](spark, SF).collect()} == nodes


def test_sparse_kernels_agree_with_dense_ones():
    rng = np.random.default_rng(0)
    n = 300
    m = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.05), 1)
    m += m.T
    i, j = np.nonzero(m)
    mine, whole = K.leading_vectors(i, j, m[i, j], n, 4), np.linalg.eigh(m)[1][:, -4:]
    assert np.allclose(np.abs((mine * whole).sum(0)), 1, atol=1e-6)
    m += np.eye(n)
    i, j = np.nonzero(m)
    assert np.allclose(K.balance_sparse(i, j, m[i, j], n), K.balance(m)[i, j])


def test_sketch_pairs_of_many_holders(spark):
    from pyspark.sql import functions as F

    from linkloom.operators import alignments as A

    r = random.Random(2)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    shared, copy = letters(300), letters(200)
    seqs = [(k, copy) for k in range(80)] + [(100 + k, shared + letters(r.choice((60, 250, 700)))) for k in range(90)] + [(300, "ACGT"), (301, None), (302, letters(400))]
    df = spark.createDataFrame(seqs, "ctg long, seq string").repartition(4)
    held = {}
    for x in A.minimizers(df, 9, 5).collect():
        held.setdefault(x.ctg, set()).add(x.h)
    share = {(a, b): len(held[a] & held[b]) / min(len(held[a]), len(held[b])) for a in held for b in held if a < b}
    want = {p: pytest.approx(v) for p, v in share.items() if v >= 0.5}
    classes = {x.ctg: (x.cls, x.n_links) for x in A.sketch_classes(df, 9, 5).collect()}
    assert set(classes) == {k for k, _ in seqs}
    pairs = A.sketch_pairs(df, 9, 5).select("a", "b", F.col("sim")).collect()
    like = {(x.a, x.b): x.sim for x in pairs}
    assert len(like) == len(pairs) and all(classes[c][0] == c for p in like for c in p)
    found = {}
    for a in held:
        for b in held:
            x, y = sorted((classes[a][0], classes[b][0]))
            if a < b and (x == y or (x, y) in like):
                found[a, b] = 1.0 if x == y else like[x, y]
    assert found == want
    near = {c: sum(c in p for p in want) for c in classes}
    assert {c: n for c, (_, n) in classes.items()} == near
    assert sum(b < 80 for _, b in want) == 80 * 79 // 2
