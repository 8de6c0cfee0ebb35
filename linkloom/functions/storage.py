"""Tables kept in the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that `stored` has written and not yet given back, oldest first.
_written: list[str] = []


def base_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster is told."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in shared storage."""
    return f"{base_dir(spark)}/linkloom-{uuid.uuid4().hex}"


def _splits(df: DataFrame) -> int:
    """Partitions of a plan without shuffles; 0 for others, whose number is only known when they run."""
    plan = df._jdf.queryExecution()
    return 0 if "Exchange" in plan.executedPlan().toString() else plan.toRdd().getNumPartitions()


#: Tasks that `spread` makes of each input split, which is 128 MB of files at most by Spark's setting.
TASKS_A_SPLIT = 8


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of large files dealt by these keys to as many tasks as the files ask for, so that what a task groups stays as small as it was.

    Tables whose splits are few next to spark.sql.shuffle.partitions, and frames that were shuffled already, stay as they are.
    """
    n = TASKS_A_SPLIT * _splits(df)
    return df.repartition(n, *keys) if n > 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def stored(df: DataFrame, few: bool = False, narrow: bool = False) -> DataFrame:
    """df, computed once into a Parquet table in shared storage and read back: lineage is cut and lost executors do no harm.

    few: a small table, such as sums or edges, that needs no more files than the cluster has cores.
    narrow: a few columns of every document; of many input splits eight go to a file.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    cores = max(1, spark.sparkContext.defaultParallelism)
    if narrow:
        splits = _splits(df)
        df = df.coalesce(max(4 * cores, splits // 8)) if splits > 8 * cores else df
    (df.coalesce(cores) if few else df).write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def passing_tables(spark: SparkSession, keep: Callable[[], list[DataFrame]] = list) -> Iterator[None]:
    """Tables that `stored` writes inside go at the end, but those that the frames given by `keep` read."""
    before = len(_written)
    yield
    kept = [f for df in keep() for f in df.inputFiles()]
    for path in _written[before:]:
        if not any(path.rsplit("/", 1)[1] in f for f in kept):
            fs, at = _hadoop(spark, path)
            fs.delete(at, True)
            _written.remove(path)


def step(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` under `folder`: read if an earlier run finished it, else made, written and read back."""
    path = f"{folder.rstrip('/')}/{name}"
    fs, done = _hadoop(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
