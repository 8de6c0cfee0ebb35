"""The jobs as queries: each run twice into one new folder, over the whole tables, its output read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import contig_catalogue, link_tables
from jobs._common import settings
from linkloom.functions.storage import shared_dir


def job1_link_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = shared_dir(spark), settings(spark, link_tables.CONFIG)
    for _ in range(2):
        link_tables.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet", out, config)
    return link_tables.read_back(spark, out)


def job2_contig_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = shared_dir(spark), settings(spark, contig_catalogue.CONFIG)
    for _ in range(2):
        contig_catalogue.run(spark, f"{sf_dir}/documents.parquet*", out, config)
    return contig_catalogue.read_back(spark, out)


QUERIES = {f.__name__: f for f in (job1_link_tables, job2_contig_catalogue)}

ORACLES = {
    "job1_link_tables": """
WITH p AS (SELECT l_partkey AS c1, l_suppkey AS c2, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS mapq, strftime(l_shipdate, '%Y-%m') AS lane FROM lineitem),
w AS (SELECT least(c1, c2) AS a, greatest(c1, c2) AS b, count(*) AS links, count(DISTINCT lane) AS lanes FROM p WHERE c1 <> c2 AND (mapq IS NULL OR mapq >= 2) GROUP BY ALL),
c AS (SELECT p_partkey AS ctg, CAST(floor(p_retailprice * 100) AS BIGINT) AS len, p_size AS re_sites FROM part),
v AS (SELECT a, b, links, lanes, links / ((x.re_sites / x.len) * (y.re_sites / y.len)) / 1e6 AS value FROM w JOIN c x ON a = x.ctg JOIN c y ON b = y.ctg),
e AS (SELECT a AS ctg, b AS partner, value, links, lanes FROM v UNION ALL SELECT b, a, value, links, lanes FROM v)
SELECT ctg, CAST(row_number() OVER (PARTITION BY ctg ORDER BY value DESC, partner) AS INTEGER) AS rank, partner, value, links, lanes FROM e
QUALIFY row_number() OVER (PARTITION BY ctg ORDER BY value DESC, partner) <= 2""",
    "job2_contig_catalogue": """
WITH d AS (SELECT doc_id AS contig, source, coalesce(text, '') AS text FROM documents),
c AS (SELECT contig, source, length(text) AS len, (length(lower(text)) - length(replace(lower(text), 'th', ''))) // 2 + 1 AS sites,
             CASE WHEN length(text) <= 1000 THEN (length(lower(text)) - length(replace(lower(text), 'th', ''))) // 2 + 1
                  ELSE (500 - length(replace(lower(left(text, 500)), 'th', ''))) // 2 + (500 - length(replace(lower(right(text, 500)), 'th', ''))) // 2 + 1 END AS end_sites,
             CASE WHEN text <> '' THEN CAST(floor(100.0::DOUBLE * (length(text) - length(translate(text, 'GCgc', ''))) / length(text)) AS BIGINT) END AS gc FROM d),
l AS (SELECT source, len, count(*) AS n, sum(len) AS bases, sum(sites - 1) AS sites FROM c GROUP BY ALL),
u AS (SELECT *, sum(bases) OVER (PARTITION BY source ORDER BY len DESC) AS upto, sum(bases) OVER (PARTITION BY source) AS total FROM l),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS contigs, CAST(sum(bases) AS BIGINT) AS bases, CAST(sum(sites) AS BIGINT) AS source_sites,
             max(len) FILTER (WHERE upto * 100 >= total * 50) AS n50, max(len) FILTER (WHERE upto * 100 >= total * 90) AS n90 FROM u GROUP BY source)
SELECT contig, c.source, len, sites, end_sites, gc, contigs, bases, source_sites, n50, n90 FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source""",
}
