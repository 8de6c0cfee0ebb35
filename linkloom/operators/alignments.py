"""Read alignments: filters, mates, concatemers, similarity by minimizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.storage import stored


def good_alignment(mapq: int, identity: float, length: int) -> Column:
    """Of columns unmapped, mapq, divergence, qs, qe."""
    return ~F.col("unmapped") & (F.col("mapq") >= mapq) & (F.col("divergence") <= (100 - identity) / 100) & (F.col("qe") - F.col("qs") >= length)


def pair_filter(alignments: DataFrame, mapq: int, max_edits: int, either_end: bool = False) -> DataFrame:
    """(read): reads whose two mates (read, read1, mapq, edits, duplicate) pass; with `either_end` one good quality is enough."""
    fine = (F.col("mapq") >= mapq).cast("int")
    g = alignments.groupBy("read").agg(F.count("*").alias("n"), F.sum(fine).alias("good"), F.max("edits").alias("edits"), F.max(F.col("duplicate").cast("int")).alias("dup"))
    return g.where((F.col("n") == 2) & (F.col("good") >= (1 if either_end else 2)) & (F.col("edits") < max_edits) & (F.col("dup") == 0)).select("read")


def end_overlaps(alignments: DataFrame, mapq: int = 30, length: int = 10_000, edge: int = 100) -> DataFrame:
    """Alignments of long reads that reach within `edge` of a contig end; `half` tells which."""
    a = alignments.where((F.col("mapq") >= mapq) & (F.col("qe") - F.col("qs") >= length))
    half = F.when(F.col("rs") <= edge, "H").when(F.col("rlen") - F.col("re") <= edge, "T")
    return a.withColumn("half", half).where(F.col("half").isNotNull())


def half_supports(ends: DataFrame, max_gap: int = 10_000, max_overlap: float = 0.5, least: int = 2) -> DataFrame:
    """(x, y, reads): half contigs that neighbour on at least so many reads, by consecutive alignments of a read."""
    w = Window.partitionBy("read").orderBy("qs", "qe", "ctg")
    nxt = lambda c: F.lead(c).over(w)
    x = ends.withColumns({"c2": nxt("ctg"), "h2": nxt("half"), "s2": nxt("qs"), "e2": nxt("qe")}).where("c2 is not null and c2 <> ctg")
    over = F.greatest(F.lit(0), F.col("qe") - F.col("s2")) / F.least(F.col("qe") - F.col("qs"), F.col("e2") - F.col("s2"))
    x = x.where((over <= max_overlap) & (F.col("s2") - F.col("qe") <= max_gap))
    a, b = F.concat_ws("_", F.col("ctg").cast("string"), "half"), F.concat_ws("_", F.col("c2").cast("string"), "h2")
    return x.groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.count_distinct("read").alias("reads")).where(F.col("reads") >= least)


def double_supported(links: DataFrame, supported: DataFrame) -> DataFrame:
    """Links (a, b, links) counted twice where the pair is supported; pairs without a link get none."""
    known = supported.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(2).alias("_k")).distinct()
    return links.join(known, ["a", "b"], "left").withColumn("links", F.col("links") * F.coalesce("_k", F.lit(1))).drop("_k")


def concatemer_pairs(alignments: DataFrame) -> DataFrame:
    """(read, i, j, c1, pos1, c2, pos2): every pair i < j of a read's primary alignments, in read order."""
    w = Window.partitionBy("read").orderBy("qs", "ctg", "pos")
    x = alignments.withColumn("k", F.row_number().over(w))
    g = x.groupBy("read").agg(F.sort_array(F.collect_list(F.struct("k", "ctg", "pos"))).alias("p"))  # a read's alignments
    one = g.select("read", F.explode("p").alias("l"), "p")
    two = one.select("read", "l", F.explode(F.slice("p", F.col("l.k") + 1, F.size("p"))).alias("r"))
    return two.select("read", F.col("l.k").alias("i"), F.col("r.k").alias("j"), F.col("l.ctg").alias("c1"), F.col("l.pos").alias("pos1"), F.col("r.ctg").alias("c2"), F.col("r.pos").alias("pos2"))


def secondary_tags(alignments: DataFrame) -> DataFrame:
    """(read, k, tags): places of secondary alignments joined to the alignment before them."""
    w = Window.partitionBy("read").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    x = alignments.withColumn("k", F.sum((~F.col("secondary")).cast("int")).over(w))
    g = x.where("secondary").groupBy("read", "k").agg(F.sort_array(F.collect_list(F.struct("ord", F.concat_ws(",", F.col("ctg").cast("string"), F.col("pos").cast("string")).alias("t")))).alias("p"))
    return g.select("read", "k", F.array_join(F.transform("p", lambda v: v["t"]), ";").alias("tags"))


def sketches(seqs: DataFrame, k: int, w: int) -> DataFrame:
    """(ctg, sketch): sorted distinct least k-mer hashes of all windows of w k-mers, both strands alike; only where there are any."""
    from linkloom.operators.kmers import sketches as sketched

    return sketched(seqs, k, w)


def minimizers(seqs: DataFrame, k: int, w: int) -> DataFrame:
    """(ctg, h): the members of the sketches."""
    return sketches(seqs, k, w).select("ctg", F.explode("sketch").alias("h"))


def _classes(seqs: DataFrame, k: int, w: int) -> tuple[DataFrame, DataFrame]:
    """(ctg, key) of every sequence with a sketch, and one row (key, id, sketch, size, cls, n) for each distinct sketch; cls is its smallest ctg, id a number of eight bytes."""
    own = stored(sketches(seqs, k, w).withColumn("key", F.sha2(F.array_join(F.transform("sketch", lambda x: x.cast("string")), ","), 256)))
    one = own.groupBy("key").agg(F.first("sketch").alias("sketch"), F.min("ctg").alias("cls"), F.count("*").alias("n"))
    return own.select("ctg", "key"), stored(one.withColumns({"size": F.size("sketch"), "id": F.monotonically_increasing_id()}))


def _alike(one: DataFrame, max_holders: int, least: float) -> DataFrame:
    """(x, y, sim): ids of distinct sketches of which the smaller shares at least `least` with the other.

    Such a pair shares one of the rarest minimizers of its smaller sketch, so many that the others alone would fall short of
    `least`; only those are joined, then sketches are compared whole. Minimizers that more than max_holders sketches have are
    dealt over several tasks. Those of one sketch only are the rarest of it and go as soon as they are counted.
    """
    m = one.select("id", "size", F.explode("sketch").alias("h"))
    held = m.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
    tasks = F.ceil(F.col("n") / F.lit(max_holders)).cast("int")
    mine = Window.partitionBy("id")
    rank = F.col("size") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("n", "h"))
    ranked = stored(held.withColumn("rank", rank).select("id", "size", "h", "rank", tasks.alias("tasks")))
    rarest = ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1)
    x = rarest.select(F.col("id").alias("x"), F.col("size").alias("size_x"), "h", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    y = ranked.select(F.col("id").alias("y"), F.col("size").alias("size_y"), "h", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int").alias("task"))
    near = stored(x.join(y, ["h", "task"]).where("size_x < size_y or (size_x = size_y and x < y)").select("x", "y").distinct())
    side = lambda c: one.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    both = near.join(side("x"), "x").join(side("y"), "y")
    sim = F.size(F.array_intersect("sketch_x", "sketch_y")) / F.least(F.size("sketch_x"), F.size("sketch_y"))
    return both.select("x", "y", sim.alias("sim")).where(F.col("sim") >= least)


def sketch_pairs(seqs: DataFrame, k: int = 17, w: int = 17, max_holders: int = 60, least: float = 0.5) -> DataFrame:
    """(a, b, sim): shared minimizers over the smaller sketch, at least `least` (above 0), between classes of equal sketches.

    A class is named by its smallest ctg; `sketch_classes` tells the class of each sequence, so that copies aren't paired with one another.
    """
    _, one = _classes(seqs, k, w)
    name = lambda k, c: one.select(F.col("id").alias(k), F.col("cls").alias(c))
    apart = _alike(one, max_holders, least).join(name("x", "l"), "x").join(name("y", "r"), "y")
    return apart.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "sim")


def sketch_classes(seqs: DataFrame, k: int = 17, w: int = 17, max_holders: int = 60, least: float = 0.5) -> DataFrame:
    """(ctg, cls, n_links) for every row of seqs: the class of equal sketches, and how many other rows are like it by at least `least`.

    Rows without a sketch (null or short sequences) are classes of their own, without links; null names are one name.
    """
    own, one = _classes(seqs, k, w)
    alike = stored(_alike(one, max_holders, least).select("x", "y"), few=True)
    sized = one.select(F.col("id").alias("y"), "n")
    beside = alike.union(alike.select("y", "x")).join(sized, "y").groupBy(F.col("x").alias("id")).agg(F.sum("n").alias("beside"))
    each = one.select("key", "id", "cls", "n").join(beside, "id", "left").select("key", "cls", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
    placed = own.join(each, "key").select("ctg", "cls", "n_links")
    bare = seqs.select("ctg").join(own.select(F.col("ctg").alias("held")), F.col("ctg").eqNullSafe(F.col("held")), "left_anti")
    return placed.union(bare.select("ctg", F.col("ctg").alias("cls"), F.lit(0).cast("long").alias("n_links")))
