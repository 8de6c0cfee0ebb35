"""A catalogue of contig sequences that grows with what is delivered: sites, composition and lengths, and sums by source.

    python -m jobs.contig_catalogue --sequences 'documents.parquet*' --out FOLDER [--config FILE]

A file stream with a checkpoint takes only files that no earlier run has taken, and stops when there are none left. The
sequence folder may grow between runs; a contig that is delivered again, in whatever file, stays as it was first delivered
(its id is kept in the stream's state; rows without an id are told apart by source and text). Two tables under the output folder:
    catalogue/part=P/batch=B   a row for each contig (contig, source, len, sites, end_sites, gc)
    sources/part=P             a row for each source (source, contigs, bases, sites, n50, n90)
P is a hash of the source, so a source's rows lie in one part. A batch replaces its own folders and the sums of the parts it
touches, so a batch that is run again after a failure changes nothing.

Settings: motif (restriction site), flank (bases at either end in which end_sites are counted), parts, files_per_batch.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs._common import command_line, table
from linkloom.functions import sequence as S

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "contig_catalogue.json")
GIVEN = "doc_id long, text string, source string"
CATALOGUE = "contig long, source string, len long, sites long, end_sites long, gc long, part int, batch long"
SOURCES = "source string, contigs long, bases long, sites long, n50 long, n90 long, part int"
STORE = "spark.sql.streaming.stateStore.providerClass"
log = logging.getLogger(__name__)


def described(contigs: DataFrame, config: dict) -> DataFrame:
    """A catalogue row for each contig."""
    text = F.coalesce("text", F.lit(""))
    gc = F.when(F.length(text) > 0, S.gc_percent(text))
    return contigs.select(
        F.col("doc_id").alias("contig"), "source", F.length(text).cast("long").alias("len"), S.motif_count(text, config["motif"]).alias("sites"),
        S.flank_motif_count(text, config["motif"], config["flank"]).alias("end_sites"), gc.cast("long").alias("gc"),
        F.pmod(F.xxhash64("source"), F.lit(config["parts"])).cast("int").alias("part"),
    )


def summed(catalogue: DataFrame) -> DataFrame:
    """Sums by source. N50 and N90 come from the counts of each length, so a source of very many contigs is no large group."""
    lengths = catalogue.groupBy("part", "source", "len").agg(F.count("*").alias("n"), F.sum("len").alias("bases"), F.sum(F.col("sites") - 1).alias("sites"))
    longest = Window.partitionBy("part", "source").orderBy(F.desc("len"))
    reached = lengths.withColumn("upto", F.sum("bases").over(longest)).withColumn("total", F.sum("bases").over(Window.partitionBy("part", "source")))
    nx = lambda share: F.max(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("len")))
    return reached.groupBy("source", "part").agg(F.sum("n").alias("contigs"), F.sum("bases").alias("bases"), F.sum("sites").alias("sites"), nx(50).alias("n50"), nx(90).alias("n90"))


def run(spark: SparkSession, sequences: str, out: str, config: dict) -> None:
    """Takes the files that are new; returns when the stream has ended."""
    out = out.rstrip("/")
    catalogue, sources = f"{out}/catalogue", f"{out}/sources"
    table(spark, catalogue, CATALOGUE, ["part", "batch"])
    table(spark, sources, SOURCES, ["part"])

    def put(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        rows = rows.withColumn("batch", F.lit(batch).cast("long")).hint("rebalance", "part")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(catalogue)
        known = table(session, catalogue, CATALOGUE, ["part", "batch"])
        written = {r.part: r.n for r in known.where(F.col("batch") == batch).groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most `parts` rows
        sums = summed(known.where(F.col("part").isin(list(written))))
        sums.coalesce(max(1, len(written))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(sources)
        log.info("batch %d: wrote %d contigs, and the sums of %d parts", batch, sum(written.values()), len(written))

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # ids stay on disk
    try:
        files = spark.readStream.schema(GIVEN).option("maxFilesPerTrigger", config["files_per_batch"]).option("maxFileAge", "36500d").parquet(sequences)
        unnamed = F.when(F.col("doc_id").isNull(), F.sha2(F.to_json(F.struct("source", "text")), 256))
        fresh = files.withColumn("unnamed", unnamed).dropDuplicates(["doc_id", "unnamed"])
        stream = described(fresh, config).writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    log.info("read %d rows of new files in %s", sum(p["numInputRows"] for p in stream.recentProgress), sequences)


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """The whole catalogue, each contig with the sums of its source."""
    out = out.rstrip("/")
    contigs = table(spark, f"{out}/catalogue", CATALOGUE, ["part", "batch"]).drop("part", "batch")
    sums = table(spark, f"{out}/sources", SOURCES, ["part"]).select(F.col("source").alias("of"), "contigs", "bases", F.col("sites").alias("source_sites"), "n50", "n90")
    return contigs.join(sums, F.col("source").eqNullSafe(F.col("of"))).drop("of")


if __name__ == "__main__":
    command_line(run, "contig catalogue", {"sequences": "folder of Parquet files of sequences, or a pattern", "out": "folder of the output tables and the checkpoint"}, CONFIG)
