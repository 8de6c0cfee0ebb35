"""Queries that write a format and read it back; their oracles are the rows that went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions.storage import shared_dir
from linkloom.operators import aggregates as A
from linkloom.operators import layout as Y
from linkloom.plans.base import clusters, contigs, layout, links, pairs, query, table
from linkloom.sources import formats as R
from linkloom.sources import sinks as W


@query("io_pairs", "WITH {pairs} SELECT CAST(read AS VARCHAR) AS read, CAST(c1 AS VARCHAR) AS c1, pos1, CAST(c2 AS VARCHAR) AS c2, pos2, mapq FROM pairs")
def _(s, d):
    path = shared_dir(s)
    W.tsv(pairs(s, d), path)
    return R.pairs(s, path)


@query("io_re_counts", "WITH {contigs} SELECT CAST(ctg AS VARCHAR) AS ctg, re_sites, len FROM contigs")
def _(s, d):
    path = shared_dir(s)
    W.tsv(contigs(s, d).select("ctg", "re_sites", "len"), path)
    return R.re_counts(s, path)


@query("io_links", "WITH {links} SELECT least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS a, greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS b, CAST(links AS DOUBLE) AS links FROM links")
def _(s, d):
    path = shared_dir(s)
    W.tsv(links(s, d).select(F.col("a").alias("source"), F.col("b").alias("target"), "links"), path, sep=",", header=True)
    return R.links(s, path)


@query("io_clusters", "WITH {clusters} SELECT CAST(grp AS VARCHAR) AS grp, CAST(ctg AS VARCHAR) AS ctg FROM clusters")
def _(s, d):
    path = shared_dir(s)
    W.members(clusters(s, d), path)
    return R.members(s, path)


@query("io_subgraphs", "SELECT CAST(o_custkey AS VARCHAR) AS grp, CAST(o_orderkey AS VARCHAR) AS ctg FROM orders")
def _(s, d):
    path = shared_dir(s)
    W.members(table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("ctg")), path, sep=",")
    return R.members(s, path, sep=",")


@query("io_group_files", "WITH {clusters} SELECT grp, CAST(ctg AS VARCHAR) AS ctg FROM clusters")
def _(s, d):
    path = shared_dir(s)
    W.group_files(clusters(s, d), path)
    return s.read.text(path).select("grp", F.col("value").alias("ctg")).withColumn("grp", F.col("grp").cast("long"))


@query("io_agp", "WITH {layout}, {agp} SELECT CAST(scaffold AS VARCHAR) AS scaffold, beg, fin, CAST(2 * part - 1 AS INTEGER) AS part, CAST(ctg AS VARCHAR) AS component, CAST(1 AS BIGINT) AS cbeg, len AS cend, orient FROM agp")
def _(s, d):
    path = shared_dir(s)
    W.agp(Y.agp_rows(layout(s, d)), path)
    return R.agp(s, path).where("kind = 'W'").drop("kind")


@query("io_fasta", "SELECT CAST(doc_id AS VARCHAR) AS ctg, md5(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g')) AS seq_md5 FROM documents")
def _(s, d):
    path = shared_dir(s)
    bare = F.regexp_replace("text", "[^A-Za-z]", "")
    W.fasta(table(s, d, "documents").select(F.col("doc_id").alias("ctg"), bare.alias("seq")), path)
    return R.fasta(s, path).select("ctg", F.md5("seq").alias("seq_md5"))


@query("io_fasta_lengths", "SELECT CAST(doc_id AS VARCHAR) AS ctg, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS len FROM documents")
def _(s, d):
    path = shared_dir(s)
    W.fasta(table(s, d, "documents").select(F.col("doc_id").alias("ctg"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq")), path, width=60)
    return R.fasta_lengths(s, path)


@query("io_fai", "SELECT row_number() OVER (ORDER BY p_partkey) AS ord, CAST(p_partkey AS VARCHAR) AS ctg, CAST(p_size AS BIGINT) AS len FROM part")
def _(s, d):
    path = shared_dir(s)
    x = table(s, d, "part").orderBy("p_partkey").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("value"))
    x.coalesce(1).write.text(path)  # an index is one file: its line order counts
    return R.fai(s, path)


@query("io_gfa_segments", "WITH {contigs} SELECT CAST(ctg AS VARCHAR) AS ctg, len, CAST(re_sites + 1 AS INTEGER) AS depth FROM contigs")
def _(s, d):
    path = shared_dir(s)
    W.gfa(contigs(s, d).withColumnRenamed("re_sites", "depth"), _edges(s, d), path)
    return R.gfa_segments(s, path)


def _edges(s, d):
    o = table(s, d, "lineitem")
    return o.select(F.col("l_partkey").alias("src"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("src_strand"), F.col("l_suppkey").alias("dst"), F.lit("+").alias("dst_strand"), F.col("l_linenumber").alias("overlap"))


@query("io_gfa_links", "SELECT CAST(l_partkey AS VARCHAR) AS src, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS src_strand, CAST(l_suppkey AS VARCHAR) AS dst, '+' AS dst_strand, l_linenumber AS overlap FROM lineitem")
def _(s, d):
    path = shared_dir(s)
    W.gfa(contigs(s, d).withColumnRenamed("re_sites", "depth"), _edges(s, d), path)
    return R.gfa_links(s, path)


@query("io_clm", "WITH {pairs}, {contigs}, placed AS (SELECT least(c1, c2) AS a, CASE WHEN c1 > c2 THEN pos2 ELSE pos1 END AS pa, greatest(c1, c2) AS b, CASE WHEN c1 > c2 THEN pos1 ELSE pos2 END AS pb, x.len AS la, y.len AS lb FROM pairs JOIN contigs x ON x.ctg = least(c1, c2) JOIN contigs y ON y.ctg = greatest(c1, c2) WHERE c1 <> c2), four AS (SELECT a, b, '++' AS orient, la - pa + pb AS d FROM placed UNION ALL SELECT a, b, '+-', la - pa + lb - pb FROM placed UNION ALL SELECT a, b, '-+', pa + pb FROM placed UNION ALL SELECT a, b, '--', pa + lb - pb FROM placed) SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, orient, count(*) AS n, CAST(sum(d) AS BIGINT) AS total FROM four GROUP BY ALL HAVING count(*) >= 2")
def _(s, d):
    path = shared_dir(s)
    W.clm(A.orientation_distances(pairs(s, d), contigs(s, d)), path)
    return R.clm(s, path).select("a", "b", "orient", "n", F.aggregate("dists", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))


@query("clm_split", "WITH {pairs}, {clusters} SELECT x.grp, count(*) AS rows FROM (SELECT DISTINCT least(c1, c2) AS a, greatest(c1, c2) AS b FROM pairs WHERE c1 <> c2) p JOIN clusters x ON a = x.ctg JOIN clusters y ON b = y.ctg WHERE x.grp = y.grp GROUP BY x.grp")
def _(s, d):
    x = W.split_clm(A.orientation_distances(pairs(s, d), contigs(s, d)), clusters(s, d))
    return x.where("orient = '++'").groupBy("grp").agg(F.count("*").alias("rows"))


@query("io_copies", "SELECT CAST(p_partkey AS VARCHAR) AS ctg, CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size % 5 END AS copies FROM part")
def _(s, d):
    path = shared_dir(s)
    n = F.when(F.col("p_size") % 5 == 0, "?").otherwise((F.col("p_size") % 5).cast("string"))
    W.tsv(table(s, d, "part").select("p_partkey", n.alias("n")), path)
    return R.copies(s, path)


@query("io_similarity", "WITH {links} SELECT least('u' || a, 'u' || b) AS a, greatest('u' || a, 'u' || b) AS b, links / 10 AS sim FROM links")
def _(s, d):
    path = shared_dir(s)
    W.tsv(links(s, d).select(F.concat(F.lit("u"), F.col("b").cast("string")), F.concat(F.lit("u"), F.col("a").cast("string")), F.col("links") / 10), path, sep=",")
    return R.similarity(s, path, prefix="u")


@query("io_tours", "SELECT CAST(o_custkey AS VARCHAR) AS grp, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS ord, CAST(o_orderkey AS VARCHAR) AS ctg, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END AS orient FROM orders")
def _(s, d):
    from pyspark.sql import Window

    path = shared_dir(s)
    ordn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    x = table(s, d, "orders").select(F.col("o_custkey").alias("grp"), ordn.alias("ord"), F.col("o_orderkey").alias("ctg"), F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise("+").alias("orient"))
    W.tours(x, path)
    part = lambda k: F.split_part("value", F.lit("\t"), F.lit(k))
    t = s.read.text(path).select(F.nullif(part(1), F.lit("")).alias("grp"), F.posexplode(F.split(part(2), " ")).alias("k", "t"))
    return t.select("grp", (F.col("k") + 1).alias("ord"), F.expr("left(t, length(t) - 1)").alias("ctg"), F.right("t", F.lit(1)).alias("orient"))


@query("io_bed", "SELECT event_type AS chrom, user_id + 1 AS sp, user_id + 100 AS ep, value FROM events")
def _(s, d):
    path = shared_dir(s)
    W.tsv(table(s, d, "events").select("event_type", "user_id", F.col("user_id") + 100, "value"), path)
    return R.bed(s, path)


@query("bed_graph", "WITH {contigs} SELECT ctg, CAST(floor(k * 5000 / 10) AS BIGINT) AS s, CAST(floor(least((k + 1) * 5000, len) / 10) AS BIGINT) AS e, re_sites AS value FROM (SELECT *, unnest(range(0, CAST(ceil(len / 5000) AS BIGINT))) AS k FROM contigs)")
def _(s, d):
    return W.bed_graph(contigs(s, d).withColumnRenamed("re_sites", "depth"), 5000, 10)


@query("io_paf", "SELECT CAST(l_orderkey AS VARCHAR) AS query, l_partkey AS qstart, l_partkey + CAST(l_quantity AS BIGINT) * 200 AS qend, CAST(l_suppkey AS VARCHAR) AS ref, l_linenumber AS mapq FROM lineitem WHERE l_linenumber >= 2 AND CAST(l_quantity AS BIGINT) * 200 >= 5000")
def _(s, d):
    path = shared_dir(s)
    li = table(s, d, "lineitem")
    end = F.col("l_partkey") + F.col("l_quantity").cast("long") * 200
    W.tsv(li.select("l_orderkey", F.lit(0), "l_partkey", end, F.lit("+"), "l_suppkey", *(F.lit(0).alias(f"z{k}") for k in range(5)), "l_linenumber"), path)
    return R.paf(s, path, min_mapq=2).select("query", "qstart", "qend", "ref", "mapq")


@query("gene_matrix", "SELECT c_nationkey AS gene, CASE WHEN bool_or(c_mktsegment = 'BUILDING') THEN CAST(count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END AS BUILDING, CASE WHEN bool_or(c_mktsegment = 'MACHINERY') THEN CAST(count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END AS MACHINERY FROM customer GROUP BY c_nationkey")
def _(s, d):
    x = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("gene"), F.col("c_mktsegment").alias("sample")).agg(F.count("*").cast("double").alias("cn"))
    return W.gene_matrix(x, ["BUILDING", "MACHINERY"])


@query("raw_coordinates", "WITH {layout}, {agp}, n AS (SELECT *, CASE WHEN ctg % 2 = 0 THEN ctg || ':11-' || (len + 10) ELSE CAST(ctg AS VARCHAR) END AS component FROM agp) SELECT CAST(scaffold AS BIGINT) AS scaffold, beg, fin, CAST(ctg AS VARCHAR) AS source, CAST(CASE WHEN ctg % 2 = 0 THEN 11 ELSE 1 END AS BIGINT) AS cbeg, CASE WHEN ctg % 2 = 0 THEN len + 10 ELSE len END AS cend FROM n")
def _(s, d):
    x = Y.coordinates(layout(s, d))
    name = F.when(F.col("ctg") % 2 == 0, F.concat(F.col("ctg").cast("string"), F.lit(":11-"), (F.col("len") + 10).cast("string"))).otherwise(F.col("ctg").cast("string"))
    rows = x.withColumn("component", name)
    return W.raw_coordinates(rows, rows.where("ctg % 2 = 0").select(F.col("component").alias("ctg")))
