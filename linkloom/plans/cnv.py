"""Queries of the copy-number chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.plans.base import depth, query, table


def genes(s, d):
    """(gene, chrom, gs, ge): a gene per nation over four windows."""
    kinds = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error")))
    first = depth(s, d).agg(F.min("win").alias("first"))
    return table(s, d, "nation").crossJoin(F.broadcast(first)).select(F.col("n_nationkey").alias("gene"), F.get(kinds, F.col("n_nationkey") % 5).alias("chrom"), (F.col("first") + F.col("n_nationkey")).alias("gs"), (F.col("first") + F.col("n_nationkey") + 3).alias("ge"))  # first is one row


_GENES = "genes AS (SELECT n_nationkey AS gene, (CASE n_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END) AS chrom, (SELECT min(win) FROM depth) + n_nationkey AS gs, (SELECT min(win) FROM depth) + n_nationkey + 3 AS ge FROM nation)"
_CN = "mid AS (SELECT sample, gc, median(rd) AS mid FROM depth GROUP BY ALL), cn AS (SELECT depth.*, rd / mid AS cn FROM depth JOIN mid USING (sample, gc))"
_GCN = "gcn AS (SELECT gene, sample, median(cn) AS cn FROM genes JOIN cn USING (chrom) WHERE win BETWEEN gs AND ge GROUP BY ALL), rcn AS (SELECT gene, sample, cn, CAST(round_even(cn, 0) AS BIGINT) AS rounded FROM gcn)"
_SHARES = "c AS (SELECT gene, sample % 3 AS grp, rounded, count(*) AS c FROM rcn GROUP BY ALL), shares AS (SELECT gene, grp, max(c) / sum(c) AS share, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY ALL)"


def _gene_cn(s, d):
    from linkloom.operators import cnv

    return cnv.gene_cn(genes(s, d), cnv.gc_corrected(depth(s, d)))


def _groups(s, d):
    return depth(s, d).select("sample", (F.col("sample") % 3).alias("grp")).distinct()


@query("cn_gc_correct", "WITH {depth}, " + _CN + " SELECT event_id, sample, chrom, win, round(cn, 6) AS cn FROM cn")
def _(s, d):
    from linkloom.operators.cnv import gc_corrected

    return gc_corrected(depth(s, d)).select("event_id", "sample", "chrom", "win", F.round("cn", 6).alias("cn"))


@query("gc_medians", "WITH {depth} SELECT sample, gc, round(median(rd), 6) AS mid FROM depth GROUP BY ALL")
def _(s, d):
    return depth(s, d).groupBy("sample", "gc").agg(F.round(F.median("rd"), 6).alias("mid"))


@query("sequencing_depth", "WITH {contigs} SELECT round((SELECT sum(length(text)) FROM documents) / CAST(sum(len) AS DOUBLE), 9) AS depth FROM contigs")
def _(s, d):
    from linkloom.plans.base import contigs

    size = contigs(s, d).agg(F.sum("len").alias("genome"))
    return table(s, d, "documents").agg(F.sum(F.length("text")).alias("bases")).crossJoin(F.broadcast(size)).select(F.round(F.col("bases") / F.col("genome"), 9).alias("depth"))


@query("depth_per_sample", "WITH {depth}, m AS (SELECT sample, avg(rd) AS mean FROM depth GROUP BY sample) SELECT event_id, sample, round(rd / mean, 5) AS share FROM depth JOIN m USING (sample)")
def _(s, d):
    from linkloom.operators.cnv import per_sample

    return per_sample(depth(s, d)).select("event_id", "sample", F.round("share", 5).alias("share"))


@query("gene_cn_round", "WITH {depth}, " + _GENES + ", " + _CN + ", " + _GCN + " SELECT gene, sample, round(cn, 6) AS cn, rounded FROM rcn")
def _(s, d):
    return _gene_cn(s, d).select("gene", "sample", F.round("cn", 6).alias("cn"), "rounded")


@query("modal_share", "WITH {depth}, " + _GENES + ", " + _CN + ", " + _GCN + ", " + _SHARES + " SELECT gene, grp, round(share, 6) AS share, n FROM shares")
def _(s, d):
    from linkloom.operators.cnv import modal_share

    return modal_share(_gene_cn(s, d), _groups(s, d)).select("gene", "grp", F.round("share", 6).alias("share"), "n")


_RFD = "rfd AS (SELECT x.gene, x.grp, (x.share - w.share) / ((x.share + w.share) / 2) AS rfd FROM shares x JOIN shares w ON x.gene = w.gene AND w.grp = 0 WHERE x.grp <> 0)"


@query("rfd", "WITH {depth}, " + _GENES + ", " + _CN + ", " + _GCN + ", " + _SHARES + ", " + _RFD + " SELECT gene, grp, round(rfd, 6) AS rfd FROM rfd")
def _(s, d):
    from linkloom.operators.cnv import modal_share, relative_difference

    return relative_difference(modal_share(_gene_cn(s, d), _groups(s, d)), 0).select("gene", "grp", F.round("rfd", 6).alias("rfd"))


@query("top_rfd", "WITH {depth}, " + _GENES + ", " + _CN + ", " + _GCN + ", " + _SHARES + ", " + _RFD + ", r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(rfd, 6) DESC, gene) AS k, count(*) OVER (PARTITION BY grp) AS n FROM rfd) SELECT gene, grp, round(rfd, 6) AS rfd FROM r WHERE k <= ceil(n * 0.05::DOUBLE)")
def _(s, d):
    from linkloom.operators.cnv import modal_share, relative_difference, top_share

    x = relative_difference(modal_share(_gene_cn(s, d), _groups(s, d)), 0).select("gene", "grp", F.round("rfd", 6).alias("rfd"))
    return top_share(x, "grp", "rfd", 0.05, "gene")


@query("anova_f", "WITH g AS (SELECT event_type, user_id % 2 AS grp, count(*) AS n, avg(value) AS m, var_samp(value) * (count(*) - 1) AS within FROM events GROUP BY ALL), t AS (SELECT event_type, sum(n * m) / sum(n) AS grand FROM g GROUP BY ALL) SELECT event_type, round((sum(n * power(m - grand, 2)) / (count(*) - 1)) / (sum(within) / (sum(n) - count(*))), 5) AS f FROM g JOIN t USING (event_type) GROUP BY event_type")
def _(s, d):
    from linkloom.operators.cnv import one_way_f

    x = table(s, d, "events").withColumn("grp", F.col("user_id") % 2)
    return one_way_f(x, ["event_type"], "grp", "value").select("event_type", F.round("f", 5).alias("f"))


@query("round_half_even", "SELECT event_id, CAST(round_even(value / 2, 0) AS BIGINT) AS cn FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.bround(F.col("value") / 2).cast("long").alias("cn"))
