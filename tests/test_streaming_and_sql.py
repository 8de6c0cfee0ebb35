"""The streaming link counter, SQL functions, simulators, breaking and evaluation."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import registry
from linkloom.operators import alignments, breaking, evaluate, simulate
from linkloom.streaming import link_counter


def test_stream_counts_links(spark, tmp_path):
    src, chk = tmp_path / "in", tmp_path / "chk"
    rows = [("2024-01-01 00:01:00", "r1", "a", "b", "30"), ("2024-01-01 00:02:00", "r2", "b", "a", "."), ("2024-01-01 00:03:00", "r2", "a", "a", "30"), ("2024-01-01 00:04:00", "r3", "a", "b", "0"), ("2024-01-01 02:00:00", "r9", "c", "d", "30"), ("2024-01-01 04:00:00", "r8", "c", "d", "30")]
    df = spark.createDataFrame(rows, "ts string, read string, c1 string, c2 string, mapq string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = link_counter.count_links(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(chk)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.a, r.b, r.links) for r in spark.table("counted").collect()}
    assert ("a", "b", 2) in got


def test_sql_functions(spark):
    registry.register(spark)
    r = spark.sql("SELECT motif_count('GATCgatcAA', 'GATC') AS n, reverse_complement('AACG') AS rc, pair_key('b', 'a').a AS a, contig_half(6, 10) AS h").first()
    assert (r.n, r.rc, r.a, r.h) == (3, "CGTT", "a", "T")
    assert registry.threshold("1.9X", 10) == 19 and registry.threshold("0.3", 10) == 0.3
    with pytest.raises(ValueError):
        registry.threshold("-1", 1)


def test_simulators_don_t_depend_on_partitions(spark):
    c = spark.range(200).select(F.col("id").alias("ctg"), (F.col("id") * 100 + 50).alias("len"))
    for make in (lambda x: simulate.shred(x, 1000), lambda x: simulate.chimeras(x, 0.3), lambda x: simulate.collapsed_regions(x, 500, 0.2)):
        assert sorted(make(c).collect()) == sorted(make(c.repartition(7)).collect())
    pieces = simulate.shred(c, 1000).groupBy("ctg").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s") + 1).alias("n"))
    assert pieces.join(c, "ctg").where("s <> 1 or e <> len or n <> len").count() == 0
    assert simulate.sample_exact(c, ["ctg"], 17).count() == 17


def test_haplotypes_change_at_the_rate(spark):
    x = spark.createDataFrame([(1, "ACGT" * 2000)], "ctg long, seq string")
    got = simulate.haplotypes(x, 2, 0.1, 0.0, 0.0).collect()
    for r in got:
        assert 0.05 < sum(a != b for a, b in zip(r.seq, "ACGT" * 2000)) / 8000 < 0.1
    assert got[0].seq != got[1].seq


def test_errors_of_a_known_scaffold(spark):
    layout = spark.createDataFrame([("s", k, f"c{k}", 10, "-" if k == 3 else "+") for k in range(1, 7)], "scaffold string, part int, ctg string, len long, orient string")
    truth = spark.createDataFrame([("c1", "A", 1, "+"), ("c2", "A", 2, "+"), ("c3", "A", 3, "+"), ("c4", "B", 1, "+"), ("c5", "A", 9, "+"), ("c6", "A", 4, "+")], "ctg string, chrom string, ord int, orient string")
    r = evaluate.scaffold_errors(layout, truth).first()
    assert (r.chrom, r.total, r.translocated, r.relocated, r.inverted, r.placed) == ("A", 60, 10, 10, 10, 30)


def test_gaps_are_filled_by_the_only_way(spark):
    layout = spark.createDataFrame([("s", 1, "a"), ("s", 2, "d")], "scaffold string, part int, ctg string")
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("b", "x")], "src string, dst string")
    assert [(r.part, r.ctg, r.filled) for r in breaking.fill_gaps(layout, edges).orderBy("part").collect()] == [(1, "a", False), (2, "b", True), (3, "d", False)]
    two = edges.union(spark.createDataFrame([("a", "c"), ("c", "d")], "src string, dst string"))
    assert breaking.fill_gaps(layout, two).count() == 2


def test_sketches_find_shared_sequences(spark):
    import random

    r = random.Random(0)
    base = "".join(r.choice("ACGT") for _ in range(600))
    rc = base[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("x", base), ("y", rc), ("z", "".join(r.choice("ACGT") for _ in range(600))), ("w", base[:400] + "".join(r.choice("ACGT") for _ in range(200))), ("e", "")]
    df = spark.createDataFrame(rows, "ctg string, seq string")
    got = {(p.a, p.b): p.sim for p in alignments.sketch_pairs(df, least=0.3).collect()}
    cls = {p.ctg: (p.cls, p.n_links) for p in alignments.sketch_classes(df, least=0.3).collect()}
    assert cls["x"] == cls["y"] == ("x", 2) and cls["w"] == ("w", 2) and cls["z"] == ("z", 0) and cls["e"] == ("e", 0)
    assert set(got) == {("w", "x")} and 0.3 < got[("w", "x")] < 0.95
