"""Joins that the plain ones don't cover: interval, as-of, membership, copies, combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.storage import stored


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, keep: list[str]) -> DataFrame:
    """left with the columns `keep` of the last right row whose `start` is at most `at`.

    Both sides are laid out once by ranges of key and place, so a key with most rows fills several tasks. The last
    seen right row is carried on inside a task, and into the next ones that go on with the key as a row
    per task: one shuffle, no range condition. Left rows before any start get nulls.
    """
    cols = left.columns
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right_row = F.struct(F.col(start).alias(start), *(F.col(c) for c in keep if c != start))
    a = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*cols).alias("_l"), F.lit(None).cast(right.select(right_row.alias("r")).schema["r"].dataType).alias("_r"))
    b = right.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*cols).alias("l")).schema["l"].dataType).alias("_l"), right_row.alias("_r"))
    laid = stored(a.union(b).repartitionByRange(n, *by, "_at", "_side").withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy("_part", *by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    tails = laid.groupBy(*by, "_part").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_at"))).alias("_tail"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that has the key
    carry = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(earlier)).where("_carry is not null")
    carry = carry.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_of"), "_carry")  # at most a row per task
    merged = laid.withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    merged = merged.join(F.broadcast(carry), same, "left").withColumn("_r", F.coalesce("_r", "_carry"))
    return merged.select(*(F.col(f"_l.{c}").alias(c) for c in cols), *(F.col(f"_r.{c}").alias(c) for c in keep))


def in_intervals(points: DataFrame, intervals: DataFrame, by: str, at: str, width: int) -> DataFrame:
    """points joined with the intervals [beg, fin] of the same key that hold them.

    Intervals are laid into bins of `width`; a point looks in its own bin alone, so the join is an equi-join.
    """
    bins = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor(F.col("fin") / width))))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(bins, [by, "_bin"]).where((F.col(at) >= F.col("beg")) & (F.col(at) <= F.col("fin"))).drop("_bin")


def best_overlap(queries: DataFrame, targets: DataFrame, by: str, width: int) -> DataFrame:
    """(query, target, overlap): for each query interval [qs, qe] the target of the same key it overlaps most, ties by target."""
    span = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    q = queries.withColumn("_bin", span("qs", "qe"))
    t = targets.withColumn("_bin", span("beg", "fin"))
    over = F.least("qe", "fin") - F.greatest("qs", "beg") + 1
    hit = q.join(t, [by, "_bin"]).withColumn("overlap", over).where("overlap > 0")
    return hit.groupBy("query").agg(F.max_by("target", F.struct("overlap", -F.col("target"))).alias("target"), F.max("overlap").alias("overlap"))


def windows_of(genes: DataFrame, windows: DataFrame) -> DataFrame:
    """(gene, chrom, sample, win, rd): windows of a chromosome that a gene [gs, ge] covers."""
    long = genes.withColumn("win", F.explode(F.sequence("gs", "ge")))
    return long.join(windows, ["chrom", "win"]).select("gene", "chrom", "sample", "win", "rd")


def copies_product(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """Each pair once per copy of either end (a contig without an entry has one)."""
    n = lambda k: copies.select(F.col("ctg").alias(k), F.col("copies").alias(f"n_{k}"))
    x = pairs.join(n("a"), "a", "left").join(n("b"), "b", "left")
    each = lambda k: F.explode(F.sequence(F.lit(1), F.coalesce(f"n_{k}", F.lit(1))))
    return x.withColumn("copy_a", each("a")).withColumn("copy_b", each("b")).drop("n_a", "n_b")


def combinations(rows: DataFrame, by: str, item: str) -> DataFrame:
    """(by, x, y): all unordered pairs of distinct items of a group; meant for groups of bounded size, such as a read's alignments."""
    sets = rows.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("items"))
    first = sets.select(by, F.posexplode("items").alias("_k", "x"), "items")
    return first.select(by, "x", F.explode(F.slice("items", F.col("_k") + 2, F.size("items"))).alias("y"))


def default_lookup(left: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """left with `value` looked up by key, the default where there is none."""
    return left.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


#: Members of a list; two lists that meet are a million pairs at most. Pairs of lists that a task gets.
LIST, LISTS_A_TASK = 1024, 8


def in_lists(members: DataFrame, *by: str) -> DataFrame:
    """(by, lot, items): the members (by, item) of each group in ascending lists; all in one lot are smaller than those in the next."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy("item")) - 1
    return members.withColumn("lot", F.floor(k / LIST)).groupBy(*by, "lot").agg(F.sort_array(F.collect_list("item")).alias("items"))


def spread_pairs(met: DataFrame, n: int) -> DataFrame:
    """(x, y), x < y: the pairs between lists xs and ys of met (xs, ys, same), of which there are n; same: of one list those with x first."""
    tasks = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // LISTS_A_TASK)
    each = met.repartition(tasks, F.xxhash64("xs", "ys")).select("same", "ys", F.explode("xs").alias("x")).select("same", "x", F.explode("ys").alias("y"))
    return each.where("x <> y and (x < y or not same)").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def expand_members(group_pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y): distinct unordered member pairs of paired groups (g1, g2).

    Members of the same groups are a class, and classes are paired once; as each member has one class, their pairs are distinct without
    being compared. They are made from lists, so no task gets all members of a group.
    """
    of = members.where("ctg is not null and grp is not null").groupBy(F.col("ctg").alias("item")).agg(F.array_sort(F.collect_set("grp")).alias("cls"))
    lists = stored(in_lists(of, "cls"))
    held = lists.groupBy("cls").agg(F.count("*").alias("n")).select("cls", "n", F.explode("cls").alias("grp"))
    side = lambda g, c: held.select(F.col("grp").alias(g), F.col("cls").alias(c), F.col("n").alias(f"n_{c}"))
    met = group_pairs.join(side("g1", "c1"), "g1").join(side("g2", "c2"), "g2")
    flip = F.col("c1") > F.col("c2")
    met = met.select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"), F.when(flip, F.col("n_c2")).otherwise(F.col("n_c1")).alias("n1"), F.when(flip, F.col("n_c1")).otherwise(F.col("n_c2")).alias("n2")).distinct()
    met = stored(met, few=True)
    n = met.agg(F.sum(F.col("n1") * F.col("n2"))).first()[0] or 0
    of_side = lambda c, k, i: lists.select(F.col("cls").alias(c), F.col("lot").alias(k), F.col("items").alias(i))
    both = met.join(of_side("c1", "k1", "xs"), "c1").join(of_side("c2", "k2", "ys"), "c2").where("c1 <> c2 or k1 <= k2")
    return spread_pairs(both.select("xs", "ys", F.expr("c1 = c2 and k1 = k2").alias("same")), n)


def merge_override(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """The union of two key-value tables; b wins where both have a key."""
    right = b.select(key, F.col(value).alias("_b"))
    return a.select(key, value).join(right, key, "full_outer").select(key, F.coalesce("_b", value).alias(value))
