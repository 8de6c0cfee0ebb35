"""Components against union-find, on graphs of every shape, and a hub whose edges must not go to one task."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators.components import components, contracted


def united(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    least = {}
    for x in root:
        least[find(x)] = min(x, least.get(find(x), x))
    return {x: least[find(x)] for x in root}


SHAPES = {
    "nothing": [],
    "odd": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (4, 5)],
    "chain": [(k, k + 1) for k in range(700)],
    "shuffled chain": [(random.Random(1).sample(range(500), 500)[k], random.Random(1).sample(range(500), 500)[k + 1]) for k in range(499)],
    "circle": [(k, (k + 1) % 333) for k in range(333)],
    "star with the largest in the middle": [(9999, k) for k in range(800)],
    "random": [(r.randint(0, 400), r.randint(0, 400)) for r in [random.Random(2)] for _ in range(300)],
    "grid": [(20 * i + j, 20 * i + j + d) for i in range(20) for j in range(20) for d in (1, 20) if (d == 20 or j < 19) and 20 * i + j + d < 400],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    edges = SHAPES[shape]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    found = {r.node: r.component for r in got.collect()}
    assert found == united(edges) and got.count() == len(found)


def test_a_hub_is_split(spark):
    """The join of a hub's edges, a million of them, with the roots of their trees reads them in several tasks."""
    from linkloom.functions.storage import stored

    changed = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        hub = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("x"), F.col("id").alias("y"))
        trees = stored(spark.range(0, 1_000_001).select(F.col("id").alias("tree"), (F.col("id") % 7).alias("to")))
        joined = contracted(stored(hub), trees).agg(F.count("*").alias("n"))
        assert joined.collect()[0].n == 1_000_000 - 1_000_000 // 7
        assert "SortMergeJoin(skew=true) [x" in joined._jdf.queryExecution().executedPlan().toString()
        got = components(hub, "x", "y").groupBy("component").count().collect()
        assert [(r.component, r["count"]) for r in got] == [(0, 1_000_001)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
