"""Copy number from windowed depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preview(depth: DataFrame, sample="All", chrom="All") -> DataFrame:
    """Rows of one sample and chromosome, or of all of them."""
    if sample != "All":
        depth = depth.where(F.col("sample") == sample)
    return depth if chrom == "All" else depth.where(F.col("chrom") == chrom)


def gc_corrected(depth: DataFrame) -> DataFrame:
    """depth with cn: read depth over the median of its sample and GC class (exact); NaN where that is zero."""
    mid = depth.groupBy("sample", "gc").agg(F.median("rd").alias("mid"))
    cn = F.coalesce(F.try_divide(F.col("rd"), F.when(F.col("mid") != 0, F.col("mid"))), F.lit(float("nan")))
    return depth.join(mid, ["sample", "gc"]).withColumn("cn", cn).drop("mid")


def per_sample(depth: DataFrame) -> DataFrame:
    """depth with share: read depth over the sample's mean depth."""
    mean = depth.groupBy("sample").agg(F.avg("rd").alias("mean"))
    return depth.join(mean, "sample").withColumn("share", F.col("rd") / F.col("mean")).drop("mean")


def gene_cn(genes: DataFrame, windows: DataFrame, value: str = "cn") -> DataFrame:
    """(gene, sample, cn, rounded): median over a gene's windows, and that rounded half to even."""
    long = genes.withColumn("win", F.explode(F.sequence("gs", "ge")))
    g = long.join(windows, ["chrom", "win"]).groupBy("gene", "sample").agg(F.median(value).alias("cn"))
    return g.withColumn("rounded", F.bround("cn").cast("long"))


def modal_share(gene_cn: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene, grp, share, n): share of the most frequent copy number of a group's samples."""
    c = gene_cn.join(groups, "sample").groupBy("gene", "grp", "rounded").agg(F.count("*").alias("c"))
    return c.groupBy("gene", "grp").agg((F.max("c") / F.sum("c")).alias("share"), F.sum("c").alias("n"))


def relative_difference(shares: DataFrame, wild) -> DataFrame:
    """(gene, grp, rfd): modal share of a group less that of the wild group, over the mean of both."""
    w = shares.where(F.col("grp") == wild).select("gene", F.col("share").alias("wild"))
    x = shares.where(F.col("grp") != wild).join(w, "gene")
    return x.select("gene", "grp", ((F.col("share") - F.col("wild")) / ((F.col("share") + F.col("wild")) / 2)).alias("rfd"))


def one_way_f(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, f, df1, df2): the one-way analysis of variance from counts, sums and sums of squares of groups."""
    g = df.groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value) * (F.count(value) - 1), F.lit(0.0)).alias("within"))
    grand = g.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    x = g.join(grand, by).groupBy(*by).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum("within").alias("within"), (F.count("*") - 1).alias("df1"), (F.sum("n") - F.count("*")).alias("df2"))
    return x.where("df1 > 0 and df2 > 0 and within > 0").select(*by, ((F.col("between") / F.col("df1")) / (F.col("within") / F.col("df2"))).alias("f"), "df1", "df2")


def top_share(df: DataFrame, by: str, value: str, share: float, tie: str) -> DataFrame:
    """The largest `share` of each group's rows (rounded up), ties by `tie`."""
    from pyspark.sql import Window

    w = Window.partitionBy(by)
    x = df.withColumn("_k", F.row_number().over(w.orderBy(F.desc(value), tie))).withColumn("_n", F.count("*").over(w))
    return x.where(F.col("_k") <= F.ceil(F.col("_n") * share)).drop("_k", "_n")
