"""Knees of the curve of sorted values: where a convex, increasing curve turns upwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.storage import stored
from linkloom.operators.windows import number_rows, running_sum


def knees(df: DataFrame, value: str, sensitivity: float = 1.0) -> DataFrame:
    """(value, top): the value and its distance below the chord at each knee.

    Both axes run from 0 to 1. The distance below the chord rises along values that hardly grow and falls where they jump, so it
    consists of runs of rises; the last point of a run, followed by a fall, is a knee if the run rises by more than `sensitivity`
    steps of one rank. Equal values are one row from the start, so a value that most rows have fills no task; null values are left out. Fewer
    than three values, or equal ones, have no knee.
    """
    of = F.col(value)
    each = stored(df.where(of.isNotNull()).groupBy(of.alias("value")).agg(F.count("*").alias("n")), few=True)
    whole = each.agg(F.sum("n").alias("all"), F.min("value").alias("low"), F.max("value").alias("high"))
    upto = running_sum(number_rows(each, [F.col("value")], "place"), [F.col("value")], "n", "last").crossJoin(F.broadcast(whole)).where("all > 2 and high > low")
    far = lambda rank: (F.col(rank) - 1) / (F.col("all") - 1) - (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    point = upto.withColumn("first", F.col("last") - F.col("n") + 1)
    point = stored(point.select("value", "place", "all", far("first").alias("from"), far("last").alias("to")), few=True)
    prior = point.select((F.col("place") + 1).alias("place"), F.col("to").alias("before"))
    falls = F.col("from") - F.col("before") < -1e-12
    marked = point.join(prior, "place", "left").withColumn("turn", F.when(falls, 1).otherwise(0))
    run = running_sum(marked, [F.col("place")], "turn", "run")
    ends = run.groupBy("run").agg(F.min_by("from", "place").alias("bottom"), F.max_by(F.struct("value", F.col("to").alias("top"), "all"), "place").alias("end"))
    final = run.agg(F.max("run").alias("final"))
    rises = (F.col("end.top") - F.col("bottom")) * (F.col("end.all") - 1) > sensitivity + 1e-9
    return ends.crossJoin(F.broadcast(final)).where(F.col("run") < F.col("final")).where(rises).select("end.value", "end.top")


def knee_summary(df: DataFrame, value: str, sensitivity: float = 1.0) -> DataFrame:
    """One row: the knee of greatest distance (ties: the smaller value), the smallest one, the number of knees, their median and mean; nulls without any."""
    found = number_rows(knees(df, value, sensitivity), [F.col("value")], "k")
    n = found.agg(F.count("*").alias("n_knees"))
    mid = (F.col("k") == F.floor((F.col("n_knees") + 1) / 2)) | (F.col("k") == F.floor((F.col("n_knees") + 2) / 2))
    best = F.max(F.struct("top", (-F.col("value")).alias("v")))
    got = found.crossJoin(F.broadcast(n)).agg(
        (-best["v"]).alias("knee"), F.min("value").alias("smallest"), F.count("*").alias("n_knees"), F.avg(F.when(mid, F.col("value"))).alias("median"), F.avg("value").alias("mean")
    )
    return got
