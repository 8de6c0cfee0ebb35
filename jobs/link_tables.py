"""Link tables for phasing and scaffolding: read pairs of sequencing lanes to normalised links and best partners.

    python -m jobs.link_tables --pairs lineitem.parquet --contigs part.parquet --out FOLDER [--config FILE]

Three tables under the output folder:
    lanes/lane=YYYY-MM   links of each lane (a, b, links); only the lanes that were asked for are counted anew and replaced
    links/chunk=K        links over all lanes (a, b, links, lanes, value), normalised
    partners/chunk=K     the best partners of each contig (ctg, rank, partner, value, links, lanes)

Settings: lanes (which to count, all if empty), min_mapq, mode of normalising (ratio, length, flank, no), partners (how many for a
contig), chunks (partitions of a contig's tables). A run replaces what an earlier one wrote, so it may be repeated after any
failure. A lane whose rows are all gone keeps its last table until its folder is removed.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs._common import command_line, table
from linkloom.operators import links as L

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "link_tables.json")
LANES = "a long, b long, links long, lane string"
LINKS = "a long, b long, links long, lanes long, value double, chunk int"
PARTNERS = "ctg long, rank int, partner long, value double, links long, lanes long, chunk int"
log = logging.getLogger(__name__)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(c1, c2, mapq, lane): the contigs and quality of each read pair, and the month it was sequenced in."""
    quality = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_linenumber"))
    lane = F.coalesce(F.date_format("l_shipdate", "yyyy-MM"), F.lit("none"))
    return spark.read.parquet(path).select(F.col("l_partkey").alias("c1"), F.col("l_suppkey").alias("c2"), quality.alias("mapq"), lane.alias("lane"))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(ctg, len, re_sites) of each contig."""
    return spark.read.parquet(path).select(F.col("p_partkey").alias("ctg"), F.floor(F.col("p_retailprice") * 100).alias("len"), F.col("p_size").alias("re_sites"))


def _seen(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and how many rows pass through it when it is next run."""
    counted = Observation(name)
    return df.observe(counted, F.count(F.lit(1)).alias("n")), counted


def _chunk(contig: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(contig), F.lit(chunks)).cast("int").alias("chunk")


def _write(df: DataFrame, path: str, by: str, dynamic: bool) -> int:
    """Writes df in partitions, each in files of even size whatever its share of the rows; how many rows that were."""
    df, written = _seen(df.hint("rebalance", by), f"written to {path.rsplit('/', 1)[1]}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(by).parquet(path)
    return written.get["n"]


def run(spark: SparkSession, pairs: str, contigs: str, out: str, config: dict) -> None:
    """Counts the lanes asked for, then makes the tables over all lanes anew."""
    out = out.rstrip("/")
    given = read_pairs(spark, pairs)
    if config["lanes"]:
        given = given.where(F.col("lane").isin(config["lanes"]))
    given, read = _seen(given, "pairs read")
    kept = given.where((F.col("c1") != F.col("c2")) & L.passes_mapq("mapq", config["min_mapq"]))
    lanes = kept.groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"), "lane").agg(F.count("*").alias("links"))
    n = _write(lanes.select("a", "b", "links", "lane"), f"{out}/lanes", "lane", dynamic=True)
    log.info("read %d pairs of %s, wrote %d links by lane", read.get["n"], pairs, n)

    counted = table(spark, f"{out}/lanes", LANES, ["lane"])
    whole = counted.groupBy("a", "b").agg(F.sum("links").alias("links"), F.count("*").alias("lanes"))
    value = L.normalise(whole, read_contigs(spark, contigs), config["mode"])
    links = whole.join(value, ["a", "b"]).select("a", "b", "links", "lanes", "value", _chunk("a", config["chunks"]))
    log.info("wrote %d links over all lanes", _write(links, f"{out}/links", "chunk", dynamic=False))

    links = table(spark, f"{out}/links", LINKS, ["chunk"])
    both = L.both_directions(links.select("a", "b", F.struct("value", "links", "lanes").alias("w")), "w").select("ctg", "partner", "w.*")
    best = L.best_partners(links, "value", config["partners"])
    best = best.join(both.drop("value"), ["ctg", "partner"]).select("ctg", "rank", "partner", "value", "links", "lanes", _chunk("ctg", config["chunks"]))
    log.info("wrote %d partners of contigs", _write(best, f"{out}/partners", "chunk", dynamic=False))


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """The table of partners."""
    return table(spark, f"{out.rstrip('/')}/partners", PARTNERS, ["chunk"]).drop("chunk")


if __name__ == "__main__":
    command_line(run, "link tables", {"pairs": "Parquet table of read pairs", "contigs": "Parquet table of contigs", "out": "folder of the output tables"}, CONFIG)
