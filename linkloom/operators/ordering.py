"""Spanning forests and scaffold orders by rounds of local choices, each round a few aggregations and joins.

No component, scaffold or hub is gathered in a task: per node or end only the best (or the two best) links are kept, by partial
aggregation before the shuffle, and paths are walked by pointers that double.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.storage import stored
from linkloom.operators.components import contracted, kept, roots
from linkloom.operators.windows import number_rows

log = logging.getLogger(__name__)


def spanning_forest(edges: DataFrame, weight: str = "links") -> DataFrame:
    """(a, b, weight) of the maximum spanning forest of an undirected edge table (a < b in it), ties to the smaller a, then b.

    In each round every tree takes its best edge to another one, and all trees that are joined in this way become one, so their
    number halves at least. As the order of edges is total, what the trees point to is a forest but for pairs that
    chose the same edge; pointers that double lead each tree to its root. Edges inside a tree leave.
    """
    lower, upper = F.least("a", "b"), F.greatest("a", "b")
    left, n = kept(edges.where("a <> b").groupBy(lower.alias("a"), upper.alias("b")).agg(F.max(weight).alias("w")).select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    chosen = left.select("a", "b", "w").limit(0)
    while n:
        best = F.max(F.struct("w", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"), "other")).alias("e")
        sides = left.select(F.col("x").alias("tree"), F.col("y").alias("other"), "w", "a", "b").union(left.select("y", "x", "w", "a", "b"))
        taken = stored(sides.groupBy("tree").agg(best), few=True)
        chosen = chosen.union(taken.select((-F.col("e.na")).alias("a"), (-F.col("e.nb")).alias("b"), "e.w").distinct())
        to = roots(taken.select("tree", F.col("e.other").alias("to")))
        left, n = kept(contracted(left, to, "a", "b", "w"))
    return chosen.withColumnRenamed("w", weight)


def _ends(layout: DataFrame, reach: float | None) -> DataFrame:
    """(ctg, half, end, size): the end of its scaffold that each half of a contig belongs to, if any; ends are 2 scaf and 2 scaf + 1."""
    first = F.when(F.col("orient") == "+", F.lit("H")).otherwise("T")
    second = F.when(F.col("orient") == "+", F.lit("T")).otherwise("H")
    halves = layout.select("ctg", "scaf", "total", (F.col("len") / 2).alias("size"), F.inline(F.array(F.struct(first.alias("half"), F.col("at").alias("s")), F.struct(second.alias("half"), (F.col("at") + F.col("len") / 2).alias("s")))))
    rest = F.col("total") - F.col("s") - F.col("size")
    tip, tail = F.col("s") <= 0, rest <= 0
    left = tip | ((F.col("s") + F.col("size") / 2 < F.col("total") / 2) & ~tail)
    held = F.lit(True) if reach is None else F.when(left, tip | (F.col("s") < reach)).otherwise(tail | (rest < reach))
    return halves.where(held).select("ctg", "half", "size", (2 * F.col("scaf") + F.when(left, 0).otherwise(1)).alias("end"))


def _standing_out(links: DataFrame, layout: DataFrame, cutoff: float, reach: float | None) -> tuple[DataFrame, int]:
    """(i, j, sure), and how many: ends that are each other's densest, by more than `cutoff` times what either has besides."""
    ends = _ends(layout, reach)
    size = ends.groupBy("end").agg(F.sum("size").alias("size"))
    side = lambda k: ends.select(F.col("ctg").alias(k), F.col("half").alias(f"{k}_half"), F.col("end").alias(f"end_{k}"))
    placed = links.join(side("a"), ["a", "a_half"]).join(side("b"), ["b", "b_half"])
    between = placed.where("floor(end_a / 2) <> floor(end_b / 2)").groupBy(F.least("end_a", "end_b").alias("i"), F.greatest("end_a", "end_b").alias("j")).agg(F.sum("n").alias("n"))
    sized = lambda k: size.select(F.col("end").alias(k), F.col("size").alias(f"size_{k}"))
    dense = between.join(sized("i"), "i").join(sized("j"), "j").withColumn("d", F.col("n") / (F.col("size_i") * F.col("size_j")))
    both = dense.select("d", F.inline(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("d"), "j"))  # all but two rows of an end go before the shuffle
    two = both.withColumn("k", place).where("k <= 2").groupBy("i").agg(F.max(F.when(F.col("k") == 1, F.col("j"))).alias("j"), F.max("d").alias("d"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("d"))), F.lit(0.0)).alias("next"))
    back = two.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("next").alias("other"))
    pair = two.where("i < j").join(back, ["i", "j"])
    other = F.greatest("next", "other")
    sure = F.when(other > 0, F.col("d") / other).otherwise(F.col("d") * 1e18)
    return kept(pair.select("i", "j", sure.alias("sure")).where(F.col("sure") > cutoff))


def _walked(joins: DataFrame, n: int, scaffolds: DataFrame) -> tuple[DataFrame, int]:
    """(enter, to, last, far, least): for each end of the scaffolds that are joined, entering there, the state in which the walk
    along the joins ends, and the length from there on. On rings `to` is not null and `least` is the least sure join; how many are so.
    """
    mate = joins.select("i", "j", F.struct("sure", (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj")).alias("join"))
    mate = mate.select(F.col("i").alias("exit"), F.col("j").alias("to"), "join").union(mate.select("j", "i", "join"))
    part = mate.select(F.floor(F.col("exit") / 2).alias("scaf")).distinct().join(scaffolds, "scaf")
    enter = part.select((2 * F.col("scaf")).alias("enter"), (2 * F.col("scaf") + 1).alias("exit"), "total").union(part.select(2 * F.col("scaf") + 1, 2 * F.col("scaf"), "total"))
    state = enter.join(mate, "exit", "left").select("enter", "to", F.col("enter").alias("last"), F.col("total").alias("far"), F.col("join").alias("least"))
    open_, left, steps = F.col("to").isNotNull(), 2 * n, 1
    most = 2 * left + 2
    while left and steps < most:
        on = state.select(F.col("enter").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("far").alias("far2"), F.col("least").alias("least2"))
        x = state.join(on, "to", "left")
        state, left = kept(x.select("enter", F.col("to2").alias("to"), F.coalesce("last2", "last").alias("last"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.least("least", "least2").alias("least")), open_)
        steps *= 2
    return state, left


def _joined(layout: DataFrame, joins: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The layout after these n joins, in which an end stands at most once, and how many were made: rings are opened at their least sure join."""
    scaffolds = layout.groupBy("scaf").agg(F.first("total").alias("total"))
    walk, rings = _walked(joins, n, scaffolds)
    if rings:
        cut = walk.where("to is not null").select((-F.col("least.ni")).alias("i"), (-F.col("least.nj")).alias("j")).distinct()
        joins, n = kept(joins.join(cut, ["i", "j"], "left_anti"))
        walk, _ = _walked(joins, n, scaffolds)
    # The walk that enters a scaffold at an end leaves the path at a tip: the other end of its last scaffold.
    tip = F.col("last").bitwiseXOR(F.lit(1).cast("long"))
    by = walk.select(F.floor(F.col("enter") / 2).alias("scaf"), (F.col("enter") % 2).alias("side"), tip.alias("tip"), "far")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = by.groupBy("scaf").agg(pick(0, "tip").alias("after"), pick(1, "tip").alias("before"), pick(0, "far").alias("far"), pick(1, "far").alias("back"))
    # A path begins at its smaller tip.
    ahead = F.col("before") < F.col("after")
    x = layout.join(both, "scaf", "left")
    moved = F.col("after").isNotNull()
    base = F.when(ahead, F.col("back")).otherwise(F.col("far")) - F.col("total")
    at = F.when(~moved, F.col("at")).otherwise(base + F.when(ahead, F.col("at")).otherwise(F.col("total") - F.col("at") - F.col("len")))
    flip = F.when(F.col("orient") == "+", "-").otherwise("+")
    new = x.select(
        "ctg", "len", F.when(moved, F.floor(F.least("before", "after") / 2)).otherwise(F.col("scaf")).alias("scaf"), at.alias("at"),
        F.when(moved & ~ahead, flip).otherwise(F.col("orient")).alias("orient"), F.when(moved, F.col("far") + F.col("back") - F.col("total")).otherwise(F.col("total")).alias("total"),
    )
    return stored(new, few=True), n


def merge_order(contigs: DataFrame, links: DataFrame, cutoff: float = 1.0, reach: float | None = None, gain: float = 0.01) -> DataFrame:
    """(scaffold, ord, ctg, orient): oriented orders of contigs (ctg, len) from links between their halves (a, a_half, b, b_half, n).

    In each round a scaffold is two ends: its halves by length, or what lies within `reach` of its tips. Ends that are each
    other's densest, by more than `cutoff` times the density that either has to any other end, are joined, all at once; the paths
    of joined scaffolds are the next round's. The rounds end when less than a share `gain` of the scaffolds was joined: what still
    has links then is a few large scaffolds to each of which a contig a round would be added. Scaffolds are numbered
    longest first. Contigs without links are scaffolds of their own; null and repeated contigs are left out.
    """
    if cutoff < 1:
        raise ValueError("a cutoff below one would join ends that are not each other's best")
    known = contigs.where("ctg is not null").groupBy("ctg").agg(F.max(F.coalesce("len", F.lit(0)).cast("double")).alias("len"))
    layout, n = kept(known.select("ctg", "len", F.col("ctg").alias("scaf"), F.lit(0.0).alias("at"), F.lit("+").alias("orient"), F.col("len").alias("total")))
    links = stored(links.groupBy("a", "a_half", "b", "b_half").agg(F.sum("n").alias("n")), few=True)
    rounds = 0
    while n > 1:
        joins, found = _standing_out(links, layout, cutoff, reach)
        rounds += 1
        log.info("round %d: %d joins of %d scaffolds", rounds, found, n)
        if not found:
            break
        layout, made = _joined(layout, joins, found)
        n -= made
        if made < gain * (n + made):
            break
    size = layout.groupBy("scaf").agg(F.first("total").alias("total"), F.min("ctg").alias("least"))
    named = number_rows(size, [F.desc("total"), F.col("least")], "scaffold")
    placed = number_rows(layout.join(named.select("scaf", "scaffold"), "scaf"), [F.col("scaffold"), F.col("at"), F.col("ctg")], "row")
    begin = placed.groupBy("scaffold").agg(F.min("row").alias("begin"))
    return placed.join(begin, "scaffold").select((F.col("scaffold") - 1).alias("scaffold"), (F.col("row") - F.col("begin")).alias("ord"), "ctg", "orient")
