"""Weighted links between contigs: counting, normalising, thinning, contracting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.storage import spread


def passes_mapq(column: str, least: int) -> Column:
    """Mapping quality of at least this; a missing or non-numeric one passes."""
    q = F.col(column).try_cast("double")
    return q.isNull() | (q >= least)


def count_ordered(pairs: DataFrame, min_mapq: int = 1) -> DataFrame:
    """(c1, c2, links) of inter-contig pairs; both directions stay apart."""
    return pairs.where((F.col("c1") != F.col("c2")) & passes_mapq("mapq", min_mapq)).groupBy("c1", "c2").agg(F.count("*").alias("links"))


def count_links(pairs: DataFrame, min_mapq: int = 1) -> DataFrame:
    """(a, b, links) under the unordered key a < b."""
    kept = pairs.where((F.col("c1") != F.col("c2")) & passes_mapq("mapq", min_mapq))
    return spread(kept.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")), "a", "b").groupBy("a", "b").agg(F.count("*").alias("links"))


def with_ends(links: DataFrame, contigs: DataFrame, *columns: str) -> DataFrame:
    """links with `<column>_a` and `<column>_b` of both contigs; a link with an unlisted contig is dropped."""
    side = lambda k: contigs.select(F.col("ctg").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns))
    return links.join(side("a"), "a").join(side("b"), "b")


def normalise(links: DataFrame, contigs: DataFrame, mode: str = "ratio", flank: int = 500_000) -> DataFrame:
    """(a, b, value): links by site density (`ratio`), by lengths (`length`), by flank lengths (`flank`), or as they are (`no`)."""
    x = with_ends(links, contigs, "len", "re_sites")
    reach = lambda k: F.least(F.col(f"len_{k}"), F.lit(2 * flank)) / 1e6
    value = {
        "ratio": F.col("links") / ((F.col("re_sites_a") / F.col("len_a")) * (F.col("re_sites_b") / F.col("len_b"))) / 1e6,
        "length": F.col("links") / (F.col("len_a") * F.col("len_b")) * 1e12,
        "flank": F.col("links") / (reach("a") * reach("b")),
        "no": F.col("links").cast("double"),
    }[mode]
    return x.select("a", "b", value.alias("value"))


def degrees(links: DataFrame, weight: str = "links") -> DataFrame:
    """(ctg, degree): summed weight at each end."""
    ends = both_directions(links, weight)
    return ends.groupBy("ctg").agg(F.sum(weight).alias("degree"))


def normalise_by_degree(links: DataFrame, rescale: bool = False) -> DataFrame:
    """(a, b, value): links over the root of both degrees, on request scaled back to the same total."""
    d = degrees(links)
    x = links.join(d.select(F.col("ctg").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("ctg").alias("b"), F.col("degree").alias("db")), "b")
    x = x.select("a", "b", "links", (F.col("links") / F.sqrt(F.col("da") * F.col("db"))).alias("value"))
    if not rescale:
        return x.drop("links")
    total = x.agg((F.sum("links") / F.sum("value")).alias("factor"))
    return x.crossJoin(F.broadcast(total)).select("a", "b", (F.col("value") * F.col("factor")).alias("value"))  # total is one row


def both_directions(links: DataFrame, weight: str = "links") -> DataFrame:
    """(ctg, partner, weight): every link seen from both ends, in one pass over the links."""
    end = lambda x, y: F.struct(F.col(x).alias("ctg"), F.col(y).alias("partner"), F.col(weight).alias(weight))
    return links.select(F.inline(F.array(end("a", "b"), end("b", "a"))))


def best_partners(links: DataFrame, weight: str = "value", most: int = 2) -> DataFrame:
    """(ctg, rank, partner, weight): the strongest partners of each contig, ties by partner."""
    rank = F.row_number().over(Window.partitionBy("ctg").orderBy(F.desc(weight), "partner"))
    return both_directions(links, weight).withColumn("rank", rank).where(F.col("rank") <= most).select("ctg", "rank", "partner", weight)


def group_links(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(ctg, grp, links): a contig's summed links to the members of each group."""
    members = clusters.select(F.col("ctg").alias("partner"), "grp")
    return both_directions(links).join(members, "partner").groupBy("ctg", "grp").agg(F.sum("links").alias("links"))


def contract(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(g1, g2, links) between groups, g1 < g2; links inside a group fall away."""
    x = with_ends(links, clusters, "grp").where("grp_a <> grp_b")
    return x.groupBy(F.least("grp_a", "grp_b").alias("g1"), F.greatest("grp_a", "grp_b").alias("g2")).agg(F.sum("links").alias("links"))


def between(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """Links with both ends in the list."""
    ids = contigs.select("ctg").distinct()
    return links.join(ids.withColumnRenamed("ctg", "a"), "a", "left_semi").join(ids.withColumnRenamed("ctg", "b"), "b", "left_semi")


def without_pairs(links: DataFrame, pairs: DataFrame, directional: bool = False) -> DataFrame:
    """Links less the listed pairs, whatever their order unless `directional`."""
    drop = pairs.select("a", "b") if directional else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links.join(drop.distinct(), ["a", "b"], "left_anti")


def density_cut(links: DataFrame, per_node: float, step: float = 0.5, weight: str = "links") -> DataFrame:
    """Links above the lowest cut on a grid of steps that leaves fewer than per_node edges a node.

    In closed form: the grid point of each edge, its count of edges at or above, and the node count decide.
    """
    nodes = links.select("a").union(links.select("b")).distinct().agg((F.count("*") * per_node).alias("most"))
    level = links.withColumn("level", F.floor(F.col(weight) / step))
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    sums = level.groupBy("level").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(above))  # a row per grid point
    cut = sums.crossJoin(F.broadcast(nodes)).agg(F.coalesce(F.min(F.when(F.col("upto") < F.col("most"), F.col("level"))), F.max("level") + 1).alias("cut"))
    return level.crossJoin(F.broadcast(cut)).where("level >= cut").drop("level", "cut")


def damp_between(links: DataFrame, haplotypes: DataFrame, weight: float = 0.5) -> DataFrame:
    """Links between different haplotypes lose this share; those left with nothing go."""
    x = with_ends(links, haplotypes, "hap")
    value = F.when(F.col("hap_a") != F.col("hap_b"), F.col("links") * (1 - weight)).otherwise(F.col("links").cast("double"))
    return x.select("a", "b", value.alias("value")).where("value > 0")
