"""Seeded generators of test data: haplotypes, contigs, chimeras, collapsed regions, errors. Columns of hashes stand for random draws, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *by) -> Column:
    """A number in [0, 1) for each combination of these columns: the first 13 hex digits of their MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in by))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def haplotypes(seqs: DataFrame, n: int, substitution: float, deletion: float, insertion: float, seed: int = 1) -> DataFrame:
    """(ctg, hap, seq): n variants of each sequence, changed base by base."""
    h = seqs.select("ctg", F.split("seq", "").alias("b"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("hap"))
    base = lambda i: F.substring(F.lit("ACGT"), (draw(seed + 1, "ctg", "hap", i) * 4).cast("int") + 1, F.lit(1))

    def change(b: Column, i: Column) -> Column:
        u = draw(seed, "ctg", "hap", i)
        return F.when(u < substitution, base(i)).when(u < substitution + deletion, F.lit("")).when(u < substitution + deletion + insertion, F.concat(b, base(i))).otherwise(b)

    return h.select("ctg", "hap", F.array_join(F.transform("b", change), "").alias("seq"))


def shred(seqs: DataFrame, mean: int, seed: int = 2) -> DataFrame:
    """(ctg, piece, s, e, orient): consecutive pieces of half to one and a half times the mean length, in random orientation."""
    n = F.ceil(F.col("len") / mean).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), n), lambda k: F.least(F.col("len"), (F.lit(mean) * (k - 0.5 + draw(seed, "ctg", k))).cast("long")))
    x = seqs.select("ctg", "len", F.array_sort(F.array_distinct(F.concat(cuts, F.array(F.col("len"))))).alias("c"))
    p = x.select("ctg", F.posexplode("c").alias("k", "e"), "c").withColumn("s", F.when(F.col("k") > 0, F.element_at("c", F.col("k")) + 1).otherwise(1))
    return p.where("e >= s").select("ctg", (F.col("k") + 1).alias("piece"), "s", "e", F.when(draw(seed + 1, "ctg", "k") < 0.5, "+").otherwise("-").alias("orient"))


def chimeras(contigs: DataFrame, share: float, seed: int = 3) -> DataFrame:
    """(left, right): disjoint pairs of contigs to be joined, about this share of them, the same for any partitioning."""
    x = contigs.select("ctg", draw(seed, "ctg").alias("u")).where(F.col("u") < share)
    from linkloom.operators.windows import number_rows

    r = number_rows(x, [F.col("u"), F.col("ctg")], "n").withColumn("pair", F.floor((F.col("n") - 1) / 2))
    g = r.groupBy("pair").agg(F.min_by("ctg", "n").alias("left"), F.max_by("ctg", "n").alias("right"), F.count("*").alias("k"))
    return g.where("k = 2").select("left", "right")


def collapsed_regions(contigs: DataFrame, width: int, share: float, seed: int = 4) -> DataFrame:
    """(ctg, s, e, copies): disjoint regions of a width that stand for 2, 3 or 4 copies."""
    w = contigs.select("ctg", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / width))).alias("k"))
    u = draw(seed, "ctg", "k")
    return w.where(u < share).select("ctg", (F.col("k") * width + 1).alias("s"), F.least((F.col("k") + 1) * width, F.col("len")).alias("e"), (2 + F.floor(u / share * 3)).cast("int").alias("copies"))


def switch_errors(alleles: DataFrame, rate: float, seed: int = 5) -> DataFrame:
    """alleles (chrom, pos, hap1, hap2) with `switched`: at each place the haplotypes change sides with this rate, and stay so."""
    w = Window.partitionBy("chrom").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum((draw(seed, "chrom", "pos") < rate).cast("int")).over(w) % 2 == 1
    x = alleles.withColumn("switched", flips)
    return x.select("chrom", "pos", F.when(F.col("switched"), F.col("hap2")).otherwise(F.col("hap1")).alias("hap1"), F.when(F.col("switched"), F.col("hap1")).otherwise(F.col("hap2")).alias("hap2"), "switched")


def clustering_errors(clusters: DataFrame, groups: int, wrong: float, lost: float, seed: int = 6) -> DataFrame:
    """(ctg, grp, kind): members moved to another group or lost from all, at these rates."""
    u = draw(seed, "ctg")
    other = (F.col("grp") + 1 + F.floor(draw(seed + 1, "ctg") * (groups - 1))) % groups
    return clusters.select("ctg", F.when(u < lost, None).when(u < lost + wrong, other).otherwise(F.col("grp")).alias("grp"), F.when(u < lost, "lost").when(u < lost + wrong, "wrong").otherwise("kept").alias("kind"))


def sample_exact(df: DataFrame, keys: list[str], n: int, seed: int = 7) -> DataFrame:
    """Exactly n rows (or all, if fewer), those with the smallest draws."""
    return df.withColumn("_u", draw(seed, *keys)).orderBy("_u", *keys).limit(n).drop("_u")


def shuffle_split(df: DataFrame, keys: list[str], parts: int, seed: int = 8) -> DataFrame:
    """df with `split`, a random part of 0..parts-1 for each row."""
    return df.withColumn("split", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(parts)).cast("int"))


def segments_agree(delta: DataFrame, ref: DataFrame, query: DataFrame) -> DataFrame:
    """delta (ref, rs, re, query, qs, qe, orient) with `agrees`: whether both sequences are equal there, on the given strand."""
    from linkloom.functions.sequence import reverse_complement

    x = delta.join(ref.select(F.col("ctg").alias("ref"), F.col("seq").alias("_r")), "ref").join(query.select(F.col("ctg").alias("query"), F.col("seq").alias("_q")), "query")
    cut = lambda s, a, b: F.substring(s, F.col(a).cast("int"), (F.col(b) - F.col(a) + 1).cast("int"))
    q = cut("_q", "qs", "qe")
    return x.withColumn("agrees", cut("_r", "rs", "re") == F.when(F.col("orient") == "-", reverse_complement(q)).otherwise(q)).drop("_r", "_q")
