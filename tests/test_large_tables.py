"""How steps spread their work: link counting over tasks, and many small groups over batches."""

import time

import pytest
from pyspark.sql import functions as F

from linkloom.functions.storage import spread
from linkloom.operators import kernels as K
from linkloom.operators.links import both_directions, count_links
from linkloom.plans import catalog


def test_both_ends_in_one_pass(spark):
    x = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") % 3).alias("links"))
    both = both_directions(x.repartition(3))
    assert "Union" not in both._jdf.queryExecution().executedPlan().toString()
    want = {(a, a + 1, a % 3) for a in range(100)} | {(a + 1, a, a % 3) for a in range(100)}
    assert {tuple(r) for r in both.collect()} == want and both.count() == 200


def test_links_of_many_splits_take_more_tasks(spark):
    x = spark.range(0, 3000, 1, 20).select((F.col("id") % 40).alias("c1"), (F.col("id") % 70).alias("c2"), F.lit(9).alias("mapq"))
    assert spread(x, "c1").rdd.getNumPartitions() == 160 and spread(x.coalesce(2), "c1").rdd.getNumPartitions() == 2
    plan = count_links(x)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
    want: dict = {}
    for k in range(3000):
        e = tuple(sorted((k % 40, k % 70)))
        want[e] = want.get(e, 0) + (e[0] != e[1])
    assert {(r.a, r.b): r.links for r in count_links(x).collect()} == {e: n for e, n in want.items() if n}


def test_small_groups_go_in_batches(spark):
    """`listed` orders rows by its columns, nulls last, and gives each group's rows by themselves; no group is a call of pandas."""
    rows = [(k % 7 if k % 7 else None, None if k % 5 == 0 else -k, k) for k in range(100)]
    x = spark.createDataFrame(rows, "g long, o long, v long").repartition(4)
    kernel = lambda g, v: [(g, j, y) for j, y in enumerate(v) if y % 2]
    got = K.listed(x, "g", ["o"], ["v"], "g long, j long, v long", kernel)
    want = {(g, j, y) for g in {r[0] for r in rows} for j, y in enumerate(r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))) if y % 2}
    assert {tuple(r) for r in got.collect()} == want
    assert K.listed(x.where("v > 100"), "g", ["o"], ["v"], "g long, j long, v long", kernel).collect() == []


@pytest.mark.parametrize("name", ["increasing_runs", "circular_rotation", "scaffold_errors", "reference_order", "long_read_paths"])
def test_queries_of_small_groups_go_in_batches(spark, name):
    assert "InPandas" not in catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_members_do_not_carry_their_line(spark, tmp_path):
    from linkloom.sources import formats

    spark.createDataFrame([("g1\t3\ta b c",), ("#x\t1\td",), ("g2\t1\te",), ("g3\t0\t",)], "value string").write.text(f"{tmp_path}/m")
    x = formats.members(spark, f"{tmp_path}/m")
    plan = x._jdf.queryExecution().executedPlan().toString()
    carried = next(r for r in plan.splitlines() if "Generate explode" in r).split("), [", 1)[1].split("]")[0]
    assert carried.startswith("grp") and "value" not in carried
    assert {tuple(r) for r in x.collect()} == {("g1", "a"), ("g1", "b"), ("g1", "c"), ("g2", "e")}


def test_many_ready_nodes_do_not_slow_the_order():
    """Ready nodes wait on a stack: moving all of them for each step took 7 s with 40,000 at once."""
    edges = [(k, 60_000 + (7 * k + j * j) % 3000) for k in range(60_000) for j in range(5)]
    began = time.perf_counter()
    runs = K.topological_runs(list(dict.fromkeys(edges)))
    assert time.perf_counter() - began < 5
    order = [x for r in runs for x in r]
    place = {x: k for k, x in enumerate(order)}
    assert len(place) == len(order) == 63_000 and all(place[a] < place[b] for a, b in edges)


def test_shortest_ways_move_lists(spark):
    """A way goes to the task of its start once, with lists of what may follow; hubs have several lists. `gap_filling` makes its rows of that alone."""
    import random
    from collections import defaultdict

    from linkloom.operators import graph as G

    r = random.Random(3)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(90)} | {(100, k) for k in range(200, 350)} | {(0, 100)} | {(k, 999) for k in range(200, 203)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    want = {}
    for a in list(near):
        seen, ways = {a} | near[a], [(a, b) for b in near[a] if b != a]
        for level in (2, 3):
            ways = [(*p, b) for p in ways for b in near.get(p[-1], ()) if b not in seen]
            for b in {p[-1] for p in ways}:
                want[a, b] = level, {p[1:-1] for p in ways if p[-1] == b}
            seen |= {p[-1] for p in ways}
    got = G.shortest_ways(spark.createDataFrame(sorted(edges), "src long, dst long"), 3).collect()
    assert {(x.src, x.dst): (x.level, x.paths) for x in got} == {k: (level, len(ways)) for k, (level, ways) in want.items()}
    assert len(got) == len(want) and all(tuple(x.way) in want[x.src, x.dst][1] for x in got)
    assert G.shortest_ways(spark.createDataFrame([], "src long, dst long"), 2).collect() == []
    assert "Window" not in catalog.queries()["gap_filling"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_cliques_and_votes_go_in_batches(spark, monkeypatch):
    """Each node and each centre was a call of pandas of its own."""
    from linkloom.operators import communities

    plans, stored = [], communities.stored
    monkeypatch.setattr(communities, "stored", lambda df, **more: plans.append(df) or stored(df, **more))
    plans += [catalog.queries()[name](spark, "/root/testdata/sf0.001") for name in ("allele_cliques", "neighbour_votes")]
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert sum("MapInArrow" in t for t in texts) == 2 and not any("InPandas" in t for t in texts)
