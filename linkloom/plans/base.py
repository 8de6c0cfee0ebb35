"""Projections of the star-schema tables onto the engine's inputs, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.plans.catalog import register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame; the oracle may name the expressions of CTE in {braces}."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        sql = oracle
        if sql is not None:
            for key, text in CTE.items():
                sql = sql.replace("{" + key + "}", text)
        register(name, f, sql)
        return f

    return put


#: pairs: a read pair per line item; contigs: one per part; links: canonical counts of inter-contig pairs.
CTE = {
    "pairs": "pairs AS (SELECT l_orderkey AS read, l_partkey AS c1, CAST(floor(l_quantity * 10) AS BIGINT) AS pos1, l_suppkey AS c2, CAST(floor(l_extendedprice) AS BIGINT) AS pos2, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS mapq FROM lineitem)",
    "contigs": "contigs AS (SELECT p_partkey AS ctg, CAST(floor(p_retailprice * 100) AS BIGINT) AS len, p_size AS re_sites FROM part)",
    "links": "links AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS links FROM lineitem WHERE l_partkey <> l_suppkey AND l_linenumber >= 2 GROUP BY ALL)",
    "clusters": "clusters AS (SELECT p_partkey AS ctg, p_partkey % 7 AS grp FROM part)",
    "alleles": "alleles AS (SELECT a, b, links / (SELECT max(links) FROM links) AS sim FROM links WHERE links >= 2)",
    "graph": "nxt AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER w AS one, lead(o_orderkey, 2) OVER w AS two, o_totalprice > lead(o_totalprice) OVER w AS falls FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), graph AS (SELECT src, one AS dst FROM nxt WHERE one IS NOT NULL UNION SELECT src, two FROM nxt WHERE two IS NOT NULL AND falls)",
    "layout": "layout AS (SELECT o_custkey AS scaffold, o_orderkey AS ctg, CAST(floor(o_totalprice) AS BIGINT) AS len, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS orient, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS part FROM orders)",
    "agp": "agp AS (SELECT scaffold, ctg, len, orient, part, CAST(sum(len + 100) OVER (PARTITION BY scaffold ORDER BY part) - len - 100 + 1 AS BIGINT) AS beg, CAST(sum(len + 100) OVER (PARTITION BY scaffold ORDER BY part) - 100 AS BIGINT) AS fin FROM layout)",
    "depth": "depth AS (SELECT user_id % 8 AS sample, event_type AS chrom, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS win, value AS rd, user_id % 5 AS gc, event_id FROM events)",
    "spans": "spans AS (SELECT l_partkey AS ctg, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + l_linenumber AS e FROM lineitem)",
}


def pairs(spark: SparkSession, d: str) -> DataFrame:
    mapq = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_linenumber"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_partkey").alias("c1"), F.floor(F.col("l_quantity") * 10).alias("pos1"), F.col("l_suppkey").alias("c2"), F.floor("l_extendedprice").alias("pos2"), mapq.alias("mapq"))


def contigs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("ctg"), F.floor(F.col("p_retailprice") * 100).alias("len"), F.col("p_size").alias("re_sites"))


def links(spark: SparkSession, d: str) -> DataFrame:
    from linkloom.operators.links import count_links

    return count_links(pairs(spark, d), min_mapq=2)


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("ctg"), (F.col("p_partkey") % 7).alias("grp"))


def alleles(spark: SparkSession, d: str) -> DataFrame:
    x = links(spark, d)
    top = x.agg(F.max("links").alias("top"))
    return x.where("links >= 2").crossJoin(F.broadcast(top)).select("a", "b", (F.col("links") / F.col("top")).alias("sim"))  # top is one row


def graph(spark: SparkSession, d: str) -> DataFrame:
    """A sparse directed graph over all orders: from each to the customer's next one, and past it if that one is cheaper."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    falls = F.col("o_totalprice") > F.lead("o_totalprice").over(w)
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("one"), F.lead("o_orderkey", 2).over(w).alias("two"), falls.alias("falls"))
    both = F.array(F.col("one"), F.when(F.col("falls"), F.col("two")))
    return x.select("src", F.explode(both).alias("dst")).where("dst is not null").distinct()


def whole_graph(spark: SparkSession, d: str) -> DataFrame:
    """A dense directed graph over all line items, for queries that no SQL defines."""
    rows = table(spark, d, "lineitem").where("l_partkey <> l_suppkey")
    return rows.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def layout(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    part = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("scaffold"), F.col("o_orderkey").alias("ctg"), F.floor("o_totalprice").alias("len"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("orient"), part.alias("part"))


def depth(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)
    return table(spark, d, "events").select((F.col("user_id") % 8).alias("sample"), F.col("event_type").alias("chrom"), day.alias("win"), F.col("value").alias("rd"), (F.col("user_id") % 5).alias("gc"), "event_id")


def spans(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("ctg"), s.alias("s"), (s + F.col("l_linenumber")).alias("e"))
