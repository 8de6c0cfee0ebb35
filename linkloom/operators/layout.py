"""Scaffold layouts: coordinates, flips, lifts, instances, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coordinates(layout: DataFrame, gap: int = 100) -> DataFrame:
    """layout (scaffold, ctg, len, orient, part) with beg and fin on the scaffold, a gap between components."""
    upto = Window.partitionBy("scaffold").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("len") + gap).over(upto) - gap
    return layout.withColumn("fin", end).withColumn("beg", F.col("fin") - F.col("len") + 1)


def agp_rows(layout: DataFrame, gap: int = 100) -> DataFrame:
    """(scaffold, beg, fin, part, kind, component, orient): component rows W with gap rows U between them."""
    x = coordinates(layout, gap).withColumn("_last", F.max("part").over(Window.partitionBy("scaffold")))
    w = F.struct(F.col("beg"), F.col("fin"), (2 * F.col("part") - 1).cast("long").alias("part"), F.lit("W").alias("kind"), F.col("ctg").cast("string").alias("component"), F.col("orient"))
    u = F.struct((F.col("fin") + 1).alias("beg"), (F.col("fin") + gap).alias("fin"), (2 * F.col("part")).cast("long").alias("part"), F.lit("U").alias("kind"), F.lit(str(gap)).alias("component"), F.lit("yes").alias("orient"))
    return x.select("scaffold", F.inline(F.when(F.col("part") < F.col("_last"), F.array(w, u)).otherwise(F.array(w))))


def lift(points: DataFrame, layout: DataFrame, oriented: bool = True) -> DataFrame:
    """points (ctg, pos) with scaffold and spos; unplaced ones are dropped."""
    x = points.join(coordinates(layout).select("ctg", "scaffold", "beg", "len", "orient"), "ctg")
    forward = F.col("beg") + F.col("pos") - 1
    place = F.when(F.col("orient") == "+", forward).otherwise(F.col("beg") + F.col("len") - F.col("pos")) if oriented else F.col("beg") + F.col("pos")
    return x.withColumn("spos", place).drop("beg", "len", "orient")


def flip(agp: DataFrame) -> DataFrame:
    """A coordinate table seen from the other end of its scaffolds."""
    w = Window.partitionBy("scaffold")
    x = agp.withColumn("_size", F.max("fin").over(w)).withColumn("_n", F.max("part").over(w))
    return x.select("scaffold", "ctg", "len", F.when(F.col("orient") == "+", "-").otherwise("+").alias("orient"), (F.col("_n") - F.col("part") + 1).alias("part"), (F.col("_size") - F.col("fin") + 1).alias("beg"), (F.col("_size") - F.col("beg") + 1).alias("fin"))


def without_gaps(agp: DataFrame, gap: int = 100) -> DataFrame:
    """agp with beg and fin as if components touched."""
    shift = gap * (F.col("part") - 1)
    return agp.withColumn("beg", F.col("beg") - shift).withColumn("fin", F.col("fin") - shift)


def collapse_runs(layout: DataFrame, group: str) -> DataFrame:
    """(scaffold, part, group, len, n): consecutive components of one group as one."""
    w = Window.partitionBy("scaffold").orderBy("part")
    new = layout.withColumn("_new", (F.lag(group).over(w).isNull() | (F.lag(group).over(w) != F.col(group))).cast("int"))
    runs = new.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("scaffold", F.col("_run").cast("int").alias("part"), group).agg(F.sum("len").alias("len"), F.count("*").alias("n"))


def sequences(layout: DataFrame, seq: str, gap: str = "N" * 100) -> DataFrame:
    """(scaffold, seq): oriented component sequences joined by gaps; a scaffold is one value by nature."""
    from linkloom.functions.sequence import reverse_complement

    piece = F.when(F.col("orient") == "-", reverse_complement(F.col(seq))).otherwise(F.col(seq))
    g = layout.groupBy("scaffold").agg(F.sort_array(F.collect_list(F.struct("part", piece.alias("piece")))).alias("p"))
    return g.select("scaffold", F.array_join(F.transform("p", lambda x: x["piece"]), gap).alias("seq"))


def trimmed_sequences(layout: DataFrame, seq: str, overlaps: DataFrame) -> DataFrame:
    """(scaffold, seq): neighbours with a known overlap (ctg, following, overlap) share it once, others are parted by NNN."""
    w = Window.partitionBy("scaffold").orderBy("part")
    x = layout.withColumn("_before", F.lag("ctg").over(w)).join(overlaps.select(F.col("ctg").alias("_before"), F.col("following").alias("ctg"), "overlap"), ["_before", "ctg"], "left")
    text = F.col(seq)
    piece = F.when(F.col("overlap").isNotNull(), F.substring(text, F.col("overlap") + 1, F.length(text))).when(F.col("_before").isNull(), text).otherwise(F.concat(F.lit("NNN"), text))
    g = x.groupBy("scaffold").agg(F.sort_array(F.collect_list(F.struct("part", piece.alias("piece")))).alias("p"))
    return g.select("scaffold", F.array_join(F.transform("p", lambda v: v["piece"]), "").alias("seq"))


def site_estimate(agp: DataFrame, sites: DataFrame) -> DataFrame:
    """(scaffold, re_sites): the components' sites in proportion to the part used, cut off."""
    x = agp.join(sites.select("ctg", "re_sites", F.col("len").alias("full")), "ctg")
    return x.groupBy("scaffold").agg(F.floor(F.sum((F.col("fin") - F.col("beg") + 1) / F.col("full") * F.col("re_sites"))).alias("re_sites"))
