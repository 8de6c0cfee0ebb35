"""Ordered computations: global row numbers, cumulative lengths, ranks, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.storage import stored


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a gapless number from 1 in this order, without one task for all rows.

    Rows are range-partitioned and numbered inside; a row per partition tells how many come before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = laid.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return laid.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + inside).drop("_part", "_base")


def running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """df with the sum of `value` up to and including each row in this total order, by partition totals as above."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = laid.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return laid.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + inside).drop("_part", "_base")


def islands(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """(by, first, last, size): maximal runs of consecutive integers."""
    w = Window.partitionBy(*by).orderBy(at)
    marked = df.select(*by, at).distinct().withColumn("_g", F.col(at) - F.row_number().over(w))
    return marked.groupBy(*by, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("size")).drop("_g")


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, start, end): the union of closed intervals, touching ones joined."""
    w = Window.partitionBy(*by).orderBy(start, end)
    prior = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("_new", (prior.isNull() | (F.col(start) > prior + 1)).cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return new.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def gaps(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, start, end): what lies between the merged intervals of a group."""
    w = Window.partitionBy(*by).orderBy(start)
    m = merge_intervals(df, by, start, end).withColumn("_next", F.lead(start).over(w))
    return m.where(F.col("_next").isNotNull()).select(*by, (F.col(end) + 1).alias(start), (F.col("_next") - 1).alias(end))


def coverage(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, at, depth): depth from each place where it changes, by summing +1 and -1 marks instead of exploding spans."""
    marks = spans.select(*by, F.inline(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("at"), F.lit(-1).alias("d"))))).groupBy(*by, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("depth", F.sum("d").over(w)).drop("d")


def intersection(x: DataFrame, y: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, start, end): what the union of closed intervals x has in common with that of y.

    One sweep over the marks of both sides; no interval is ever paired with another.
    """
    mark = lambda df, a, b: df.select(*by, F.inline(F.array(F.struct(F.col(start).alias("at"), F.lit(a).alias("dx"), F.lit(b).alias("dy")), F.struct((F.col(end) + 1).alias("at"), F.lit(-a).alias("dx"), F.lit(-b).alias("dy")))))
    marks = mark(x, 1, 0).union(mark(y, 0, 1)).groupBy(*by, "at").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    w = Window.partitionBy(*by).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    held = marks.select(*by, "at", F.sum("dx").over(upto).alias("nx"), F.sum("dy").over(upto).alias("ny"), (F.lead("at").over(w) - 1).alias("fin"))
    return merge_intervals(held.where("nx > 0 and ny > 0").select(*by, F.col("at").alias(start), F.col("fin").alias(end)), by, start, end)


def valleys(spans: DataFrame, by: str, start: str, end: str, share: float = 0.2, long: int = 3) -> DataFrame:
    """(by, first, last, depth): between two long regions of depth >= share x median, the stretches of least depth.

    Works on the steps of the depth curve, weighted by their width, and never on single places.
    """
    w = Window.partitionBy(by).orderBy("at")
    steps = coverage(spans, [by], start, end).withColumn("fin", F.lead("at").over(w) - 1).where("fin is not null and fin >= at")
    ranked = steps.groupBy(by, "depth").agg(F.sum(F.col("fin") - F.col("at") + 1).alias("n"))
    cum = F.sum("n").over(Window.partitionBy(by).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("upto", cum).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    at_rank = lambda k: F.min(F.when(F.col("upto") >= F.floor((F.col("total") + k) / 2), F.col("depth")))
    mid = ranked.groupBy(by).agg(((at_rank(1) + at_rank(2)) / 2).alias("mid"))
    flagged = steps.join(mid, by).withColumn("high", F.col("depth") >= share * F.col("mid"))
    turn = (F.lag("high").over(w).isNull() | (F.lag("high").over(w) != F.col("high"))).cast("int")
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    runs = flagged.withColumn("turn", turn).withColumn("run", F.sum("turn").over(upto))
    width = F.max("fin").over(Window.partitionBy(by, "run")) - F.min("at").over(Window.partitionBy(by, "run")) + 1
    region = runs.withColumn("region", F.when(F.col("high") & (width >= long), F.col("run")))
    # A step between two long regions knows both by carrying them along the curve.
    inside = region.withColumns({"before": F.last("region", True).over(upto), "next": F.first("region", True).over(after)}).where("region is null and before is not null and next is not null")
    low = inside.withColumn("least", F.min("depth").over(Window.partitionBy(by, "before"))).where("depth = least")
    return low.groupBy(by, "before", "depth").agg(F.min("at").alias("first"), F.max("fin").alias("last")).select(by, "first", "last", "depth")


def instances(layout: DataFrame, by: str, item: str, order: list[str]) -> DataFrame:
    """layout with `instance`: the number of an item's separate runs so far; a run goes on while the item follows itself in the same object."""
    w = Window.partitionBy(by).orderBy(*order)
    new = layout.withColumn("_new", (F.lag(item).over(w).isNull() | (F.lag(item).over(w) != F.col(item))).cast("int"))
    return new.withColumn("instance", F.sum("_new").over(Window.partitionBy(item).orderBy(by, *order).rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def ratio_break(df: DataFrame, by: str, value: str, ratio: float) -> DataFrame:
    """(by, main): how many values, largest first, come before the first drop below `ratio` of the one before."""
    w = Window.partitionBy(by).orderBy(F.desc(value))
    x = df.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(value).over(w))
    return x.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("_next") / F.col(value) < ratio, F.col("_k"))), F.count("*")).alias("main"))
