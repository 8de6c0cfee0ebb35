"""Grouped statistics over links, windows and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.windows import running_sum


def nx_lengths(contigs: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the length at which contigs, longest first, reach this share of the total (N50 for 0.5).

    Lengths are counted first, so what is ordered are distinct lengths, summed by partition totals.
    """
    by_len = contigs.where("len > 0").groupBy("len").agg((F.sum("len")).alias("bases"))
    cum = running_sum(by_len, [F.desc("len")], "bases", "upto")
    total = by_len.agg(F.sum("bases").alias("total"))
    hit = cum.crossJoin(F.broadcast(total)).select("len", F.explode(F.filter(F.array(*map(F.lit, shares)), lambda x: F.col("upto") >= F.col("total") * x)).alias("share"))
    return hit.groupBy("share").agg(F.max("len").alias("length"))


def nx_keep(contigs: DataFrame, share: float) -> DataFrame:
    """Contigs, longest first (ties by name), until their summed length reaches the share, the one that reaches it included."""
    cum = running_sum(contigs, [F.desc("len"), F.col("ctg")], "len", "upto")
    total = contigs.agg(F.sum("len").alias("total"))
    return cum.crossJoin(F.broadcast(total)).where(F.col("upto") - F.col("len") < F.col("total") * share).drop("upto", "total")


def fences(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """One row: q1, q2, q3 (linear) and the fences q1 - k iqr, q3 + k iqr.

    Values are counted first; the values at the ranks asked for come from a running sum over ranges of them.
    """
    counted = running_sum(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")), [F.col("v")], "n", "upto")
    total = counted.agg(F.sum("n").alias("total"))
    rank = lambda q: (F.col("total") - 1) * q
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    both = counted.crossJoin(F.broadcast(total)).groupBy("total").agg(*(f(rank(q)).alias(f"{n}{int(4 * q)}") for q in (0.25, 0.5, 0.75) for n, f in (("lo", lambda r: at(F.floor(r))), ("hi", lambda r: at(F.ceil(r))))))
    q = both.select(*((F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (rank(k / 4) - F.floor(rank(k / 4)))).alias(f"q{k}") for k in (1, 2, 3)))
    return q.select("*", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high"))


def within_fences(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """Rows whose value lies within the fences."""
    return df.crossJoin(F.broadcast(fences(df, value, k).select("low", "high"))).where((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high"))).drop("low", "high")


def half(pos: Column, length: Column) -> Column:
    """H or T: the half of a contig that a position lies in."""
    return F.when(2 * pos > length, "T").otherwise("H")


def placed(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Inter-contig pairs in canonical order with lengths: a, pa, la, b, pb, lb."""
    flip = F.col("c1") > F.col("c2")
    x = pairs.where("c1 <> c2").select(F.when(flip, F.col("c2")).otherwise(F.col("c1")).alias("a"), F.when(flip, F.col("pos2")).otherwise(F.col("pos1")).alias("pa"), F.when(flip, F.col("c1")).otherwise(F.col("c2")).alias("b"), F.when(flip, F.col("pos1")).otherwise(F.col("pos2")).alias("pb"))
    n = lambda k: contigs.select(F.col("ctg").alias(k), F.col("len").alias(f"l{k}"))
    return x.join(n("a"), "a").join(n("b"), "b")


def half_links(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(a, a_half, b, b_half, n)."""
    x = placed(pairs, contigs)
    return x.groupBy("a", half(F.col("pa"), F.col("la")).alias("a_half"), "b", half(F.col("pb"), F.col("lb")).alias("b_half")).agg(F.count("*").alias("n"))


def orientation_distances(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(a, b, orient, n, dists): distances of each pair in the four relative orientations, sorted.

    A pair's places are gathered once; the four lists are made from them afterwards. A list is as long as its pair has links.
    """
    x = placed(pairs, contigs).groupBy("a", "b", "la", "lb").agg(F.collect_list(F.struct("pa", "pb")).alias("p"))
    each = lambda orient, d: F.struct(F.lit(orient).alias("orient"), F.sort_array(F.transform("p", d)).alias("dists"))
    la, lb = F.col("la"), F.col("lb")
    four = F.array(each("++", lambda p: la - p["pa"] + p["pb"]), each("+-", lambda p: la - p["pa"] + lb - p["pb"]), each("-+", lambda p: p["pa"] + p["pb"]), each("--", lambda p: p["pa"] + lb - p["pb"]))
    return x.select("a", "b", F.inline(four)).select("a", "b", "orient", F.size("dists").cast("long").alias("n"), "dists")


def bin_links(pairs: DataFrame, width: int) -> DataFrame:
    """(f1, f2, n): links between the bins `contig:number` of inter-contig pairs, in canonical order."""
    name = lambda c, p: F.concat(F.col(c).cast("string"), F.lit(":"), F.floor(F.col(p) / width).cast("string"))
    x = pairs.where("c1 <> c2").select(name("c1", "pos1").alias("x"), name("c2", "pos2").alias("y"))
    return x.groupBy(F.least("x", "y").alias("f1"), F.greatest("x", "y").alias("f2")).agg(F.count("*").alias("n"))


def concordance(pairs: DataFrame, contigs: DataFrame, windows: int = 50) -> DataFrame:
    """(a, b, n, ratio): the largest share of links that lie on one diagonal or one anti-diagonal band."""
    x = placed(pairs, contigs).withColumn("w", F.greatest(F.floor(F.least("la", "lb") / windows), F.lit(1)))
    bands = F.array(F.struct(F.lit("-").alias("side"), F.floor((F.col("pb") - F.col("pa")) / F.col("w")).alias("band")), F.struct(F.lit("+").alias("side"), F.floor((F.col("pb") + F.col("pa")) / F.col("w")).alias("band")))
    counted = x.select("a", "b", F.inline(bands)).groupBy("a", "b", "side", "band").agg(F.count("*").alias("c"))
    n = F.sum(F.when(F.col("side") == "-", F.col("c")))
    return counted.groupBy("a", "b").agg(n.alias("n"), (F.max("c") / n).alias("ratio"))


def concentration(pairs: DataFrame, width: int, times: float) -> DataFrame:
    """(a, b, value): 1 minus the share of links in crowded bins on either axis, multiplied."""
    flip = F.col("c1") > F.col("c2")
    x = pairs.where("c1 <> c2").select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"), F.inline(F.array(F.struct(F.lit("x").alias("axis"), F.floor(F.when(flip, F.col("pos2")).otherwise(F.col("pos1")) / width).alias("bin")), F.struct(F.lit("y").alias("axis"), F.floor(F.when(flip, F.col("pos1")).otherwise(F.col("pos2")) / width).alias("bin")))))
    bins = x.groupBy("a", "b", "axis", "bin").agg(F.count("*").alias("c"))
    mid = bins.groupBy("a", "b", "axis").agg(F.median("c").alias("mid"), F.sum("c").alias("n"))
    crowded = bins.join(mid, ["a", "b", "axis"]).groupBy("a", "b", "axis").agg((1 - F.sum(F.when(F.col("c") >= times * F.col("mid"), F.col("c")).otherwise(0)) / F.max("n")).alias("free"))
    return crowded.groupBy("a", "b").agg(F.max(F.when(F.col("axis") == "x", F.col("free"))).alias("fx"), F.max(F.when(F.col("axis") == "y", F.col("free"))).alias("fy")).select("a", "b", (F.col("fx") * F.col("fy")).alias("value"))


def rank_sums(links: DataFrame, top: int) -> DataFrame:
    """(ctg, rank_sum): over pairs of a contig's top neighbours, the smaller of their ranks of each other (missing: `top` + 1)."""
    from linkloom.operators.links import both_directions

    w = Window.partitionBy("ctg").orderBy(F.desc("links"), "partner")
    ranks = both_directions(links).withColumn("rank", F.row_number().over(w))
    best = ranks.where(F.col("rank") <= top).select("ctg", "partner")
    trio = best.alias("x").join(best.alias("y"), "ctg").where("x.partner < y.partner").select("ctg", F.col("x.partner").alias("p"), F.col("y.partner").alias("q"))
    r = ranks.select(F.col("ctg").alias("p"), F.col("partner").alias("q"), "rank")
    z = trio.join(r, ["p", "q"], "left").withColumnRenamed("rank", "r1").join(r.select(F.col("p").alias("q"), F.col("q").alias("p"), F.col("rank").alias("r2")), ["p", "q"], "left")
    return z.groupBy("ctg").agg(F.sum(F.least(F.coalesce("r1", F.lit(top + 1)), F.coalesce("r2", F.lit(top + 1)))).alias("rank_sum"))


def bounded_points(pairs: DataFrame, most: int) -> DataFrame:
    """The first `most` positions of each contig pair in a total order; the bound is the feature (scoring starts when it is met)."""
    w = Window.partitionBy("c1", "c2").orderBy("read", "pos1", "pos2")
    return pairs.where("c1 <> c2").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def value_curve(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, n, share_n, weight_left): per distinct value, how many rows are at or below it and what weight lies above."""
    g = df.groupBy(value).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    total = g.agg(F.sum("n").alias("tn"), F.sum("w").alias("tw"))
    c = running_sum(running_sum(g, [F.col(value)], "n", "cn"), [F.col(value)], "w", "cw")
    return c.crossJoin(F.broadcast(total)).select(F.col(value).alias("value"), "n", (F.col("cn") / F.col("tn")).alias("share_n"), (1 - F.col("cw") / F.col("tw")).alias("weight_left"))


def majority(rows: DataFrame, by: str, label: str) -> DataFrame:
    """(by, label, votes): the most frequent label of each group, ties by label."""
    votes = rows.groupBy(by, label).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(by).orderBy(F.desc("votes"), label)
    return votes.withColumn("k", F.row_number().over(w)).where("k = 1").select(by, label, "votes")


def correlation_of_concordance(x: Column, y: Column) -> Column:
    """Lin's coefficient from population moments."""
    return 2 * F.covar_pop(x, y) / (F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), 2))


def roc(scored: DataFrame, score: str, truth: str, cuts: int) -> DataFrame:
    """(cut, tpr, fpr) at cuts / n, n = 0..cuts: counted once per grid cell, summed up over cells."""
    cell = F.least(F.floor(F.col(score) * cuts), F.lit(cuts)).cast("int")
    g = scored.groupBy(cell.alias("cell")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    grid = scored.sparkSession.range(cuts + 1).select(F.col("id").cast("int").alias("cell"))
    up = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)  # cuts + 1 rows
    everything = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = grid.join(g, "cell", "left").fillna(0, ["p", "n"])
    return full.select((F.col("cell") / cuts).alias("cut"), (F.sum("p").over(up) / F.sum("p").over(everything)).alias("tpr"), (F.sum("n").over(up) / F.sum("n").over(everything)).alias("fpr"))
