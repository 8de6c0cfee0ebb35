"""Link counts over a stream of read pairs, with late pairs within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.links import passes_mapq


def count_links(pairs: DataFrame, min_mapq: int = 1, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, a, b, links) of a stream of pairs (ts, c1, c2, mapq); pairs later than `late` are dropped."""
    kept = pairs.withWatermark("ts", late).where((F.col("c1") != F.col("c2")) & passes_mapq("mapq", min_mapq))
    return kept.groupBy(F.window("ts", window), F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).agg(F.count("*").alias("links"))


def distinct_reads(pairs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each read once within the watermark: what a duplicate filter does on a stream."""
    return pairs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["read"])
