"""Tours of very many groups lie in few files."""

import os

from pyspark.sql import functions as F

from linkloom.plans import catalog
from linkloom.sources import sinks as W


def test_many_groups_make_few_files(spark, tmp_path):
    x = spark.range(3000).select((F.col("id") % 1000).alias("grp"), (F.col("id") / 1000).cast("int").alias("ord"), F.col("id").alias("ctg"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("orient"))
    W.tours(x, f"file://{tmp_path}/tours")
    assert len([f for _, _, files in os.walk(f"{tmp_path}/tours") for f in files if f.endswith(".txt")]) <= 16
    lines = {r.value for r in spark.read.text(f"file://{tmp_path}/tours").collect()}
    assert len(lines) == 1000 and "7\t7- 1007- 2007-" in lines and "8\t8+ 1008+ 2008+" in lines


def test_orders_of_every_price_are_in_a_tour(spark, tmp_path):
    rows = [(k, k % 4, float(k * 50000)) for k in range(11)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["io_tours"](spark, str(tmp_path))
    want = [(str(k % 4), k // 4 + 1, str(k), "-" if k % 3 == 0 else "+") for k in range(11)]
    assert sorted(map(tuple, got.select("grp", "ord", "ctg", "orient").collect())) == sorted(want)
