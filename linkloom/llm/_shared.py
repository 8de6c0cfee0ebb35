"""Helpers that the operators of this subpackage share: shared storage, whole-text Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.storage import shared_dir, stored  # noqa: F401  (for the operators)

#: Rows of one Arrow batch. With texts of up to some 100 kB a batch stays within tens of MB in a Python worker.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(run: Callable) -> Callable:
    """A map over batches that gives freed memory back to the machine when a task ends, as Python workers live on."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return wrapped


_kept: dict = {}


def worker_keeps(owner: str, key=None, make: Callable | None = None):
    """What a Python worker keeps from task to task: one thing, of the operator that ran last."""
    if _kept.get("of") != (owner, key):
        _kept.clear()
        if make is not None:
            _kept.update(of=(owner, key), value=make())
    return _kept.get("value")


def parts(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Up to so many removed rows go to the texts as a table; beyond that as a filter of at most 2^MAX_FILTER_BITS bits (128 MB).
ROW, MAX_GONE, MAX_FILTER_BITS = "__linkloom_row", 500_000, 30


def row_key(df: DataFrame, id_col: str) -> Column:
    """Tells rows apart, null or repeated ids too: the id and a hash of all columns (equal rows share it)."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("hash"))


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """df with columns c0, c1, ... whatever their names are, and its row_key as k."""
    return df.select(*(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(df.columns)), row_key(df, id_col).alias("k"))


def without(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """df less the rows whose key is in `gone` (columns id, hash), its columns unchanged.

    `gone` is stored and counted first: up to MAX_GONE rows (some tens of MB) it goes to where the texts are. Beyond
    that a bitmap of its hashes goes there; only rows on a set bit (those in `gone`, and one in 64 others
    while the bitmap is below its limit) are dealt by key and confirmed, all others stay where they are.
    """
    gone = stored(gone.select("id", "hash").distinct(), few=True).toDF("gone_id", "gone_hash")
    n = gone.count()
    match = (F.col("k.hash") == F.col("gone_hash")) & F.col("k.id").eqNullSafe(F.col("gone_id"))
    rows = keyed(df, id_col)
    plain = lambda kept: kept.drop("k").toDF(*df.columns)
    if n <= MAX_GONE:
        return plain(rows.join(F.broadcast(gone), match, "left_anti"))
    spot = lambda h: F.pmod(h, F.lit(1 << min(MAX_FILTER_BITS, max(16, (64 * n).bit_length())))) + 1
    at = spot(F.col("gone_hash"))
    maps = stored(gone.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")), few=True)
    own = spot(F.col("k.hash"))
    place = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))
    probed = rows.join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col("bucket"), "left").withColumn("held", held).drop("bucket", "bits")
    rest = probed.where("held").drop("held").join(gone, match, "left_anti")
    return plain(probed.where("not held").drop("held")).union(plain(rest))
