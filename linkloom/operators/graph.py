"""Directed and undirected graph operators over edge tables (src, dst)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.storage import stored

log = logging.getLogger(__name__)


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def tips(edges: DataFrame) -> DataFrame:
    """Nodes without predecessors or without successors that have a single neighbour."""
    n = undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("neighbours"))
    return degrees(edges).join(n, "node").where("(n_in = 0 or n_out = 0) and neighbours = 1").select("node")


def reach(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, level): the least number of steps, up to `hops`, without the start itself."""
    e = edges.select("src", "dst").distinct()
    seen = e.where("src <> dst").withColumn("level", F.lit(1))
    last = seen
    for k in range(2, hops + 1):
        step = last.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").where("src <> dst").distinct()
        last = stored(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("level", F.lit(k)))
        seen = seen.union(last)
    return seen


def path_counts(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, level, paths): how many shortest paths there are, level by level."""
    e = edges.select("src", "dst").distinct()
    seen = e.where("src <> dst").select("src", "dst", F.lit(1).alias("level"), F.lit(1).cast("long").alias("paths"))
    last = seen
    for k in range(2, hops + 1):
        step = last.select("src", F.col("dst").alias("mid"), "paths").join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst")
        step = step.groupBy("src", "dst").agg(F.sum("paths").alias("paths"))
        last = stored(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(k).alias("level"), "paths"))
        seen = seen.union(last)
    return seen


#: Two-step ways that a task counts, and successors that stand in one list.
WAYS_A_TASK, SUCCESSORS = 3_000_000, 64


def shortest_ways(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, level, paths, way): how many shortest ways of 2 to `hops` steps there are, and the inner nodes of one of them.

    Rows move once a level: a way so far goes to the task of its start with a list of the nodes that may follow (a node with very
    many has several lists), is spread out there and counted beside the pairs already reached, which leave with what they meet.
    """
    e = edges.select("src", "dst").distinct()
    after = e.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("n"))
    before = e.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("m"))
    steps = after.join(before, "mid").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    n = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), steps // WAYS_A_TASK)
    lot = F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / SUCCESSORS))
    onward = e.withColumnRenamed("src", "mid").join(after, "mid").groupBy("mid", lot.alias("lot")).agg(F.sort_array(F.collect_list("dst")).alias("next")).select("mid", "next")
    if hops > 2:
        onward = stored(onward)
    seen = e.where("src <> dst")
    last, found = seen.withColumn("paths", F.lit(1).cast("long")), None
    for k in range(2, hops + 1):
        step = last.select("src", F.col("dst").alias("mid"), "paths").join(onward, "mid").select("src", "mid", "paths", "next", F.lit(False).alias("known"))
        held = seen.select("src", F.lit(None).cast(e.schema["dst"].dataType).alias("mid"), F.lit(0).cast("long").alias("paths"), F.array("dst").alias("next"), F.lit(True).alias("known"))
        each = step.union(held).repartition(n, "src").select("src", "mid", "paths", "known", F.explode("next").alias("dst")).where("src <> dst")
        level = each.groupBy("src", "dst").agg(F.sum("paths").alias("paths"), F.min("mid").alias("mid"), F.max("known").alias("known")).where("not known")
        if k == 2:
            new = level.select("src", "dst", F.lit(k).alias("level"), "paths", F.array("mid").alias("way"))
        else:
            new = level.join(last.select("src", F.col("dst").alias("mid"), "way"), ["src", "mid"]).select("src", "dst", F.lit(k).alias("level"), "paths", F.concat("way", F.array("mid")).alias("way"))
        if k < hops:
            last = new = stored(new)
            seen = seen.union(new.select("src", "dst"))
        found = new if found is None else found.union(new)
    return found


def simple_paths(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, nodes): all simple paths of at most `hops` edges; meant for sparse graphs and few hops."""
    e = edges.select("src", "dst").distinct()
    last = e.where("src <> dst").select("src", "dst", F.array("src", "dst").alias("nodes"))
    found = last
    for _ in range(2, hops + 1):
        step = last.select("src", F.col("dst").alias("mid"), "nodes").join(e.select(F.col("src").alias("mid"), "dst"), "mid")
        last = stored(step.where(~F.array_contains("nodes", F.col("dst"))).select("src", "dst", F.concat("nodes", F.array("dst")).alias("nodes")))
        found = found.union(last)
    return found


#: Components of up to this many edges are reduced each by a kernel.
WHOLE = 5_000


def transitive_reduction(edges: DataFrame, hops: int | None = None) -> DataFrame:
    """Edges without another way of 2 to `hops` steps between their ends; by default of any length, until no new pair is reached.

    Without `hops` small components go to a kernel in batches, so that the pairs reached in them, whose number grows with the square of a component,
    are not shuffled; a component of more than WHOLE edges goes by rounds.
    """
    from linkloom.operators.components import components
    from linkloom.operators.kernels import listed, reduced

    if hops is not None:
        return _reduced_by_rounds(edges.select("src", "dst").distinct(), hops)
    e = stored(edges.select("src", "dst").distinct())
    part = components(e, "src", "dst")
    lots = e.where("src is not null and dst is not null").join(part.withColumnRenamed("node", "src"), "src", "left").select(F.coalesce("component", "src").alias("part"), "src", "dst")
    lots = stored(lots)
    large = stored(lots.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("part"), few=True)
    if large.take(1):
        rest = _reduced_by_rounds(lots.join(large, "part", "left_semi").select("src", "dst"), None)
        lots = lots.join(large, "part", "left_anti")
    else:
        rest = None
    kind = {f.name: f.dataType.simpleString() for f in e.schema}
    small = listed(lots, "part", ["src", "dst"], ["src", "dst"], f"src {kind['src']}, dst {kind['dst']}", reduced)
    out = small.union(e.where("src is null or dst is null"))  # no way leads through a null
    return out if rest is None else out.union(rest)


def _reduced_by_rounds(e: DataFrame, hops: int | None) -> DataFrame:
    frontier, longer, k = e, None, 1
    while hops is None or k < hops:
        k += 1
        step = frontier.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = stored(step if longer is None else step.join(longer, ["src", "dst"], "left_anti"))
        if not frontier.take(1):
            break
        longer = frontier if longer is None else longer.union(frontier)
    return e if longer is None else e.join(longer, ["src", "dst"], "left_anti")


def diamonds(edges: DataFrame) -> DataFrame:
    """(a, b, c, d) with a->b, a->c, b->d, c->d, b < c and no edge between b and c."""
    e = edges.select("src", "dst").distinct()
    x = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("d")), "b").where("a <> d")
    two = x.join(x.select("a", F.col("b").alias("c"), "d"), ["a", "d"]).where("b < c")
    cross = undirected(e).select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return two.join(cross, ["b", "c"], "left_anti").select("a", "b", "c", "d")


def bubbles(edges: DataFrame) -> DataFrame:
    """(x, y): nodes with one predecessor and one successor each, both the same.

    Pairs grow with the square of such nodes; they are made from lists of them, so that neither a task nor the shuffle gets the pairs of one group.
    """
    from linkloom.operators.joins import in_lists, spread_pairs

    e = edges.select("src", "dst").distinct()
    single = degrees(e).where("n_in = 1 and n_out = 1").select("node")
    ends = single.join(e.select(F.col("dst").alias("node"), F.col("src").alias("pred")), "node").join(e.select(F.col("src").alias("node"), F.col("dst").alias("succ")), "node")
    lists = stored(in_lists(ends.withColumnRenamed("node", "item"), "pred", "succ"))
    n = lists.groupBy("pred", "succ").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0] or 0
    met = lists.withColumnsRenamed({"lot": "k1", "items": "xs"}).join(lists.withColumnsRenamed({"lot": "k2", "items": "ys"}), ["pred", "succ"]).where("k1 <= k2")
    return spread_pairs(met.select("xs", "ys", (F.col("k1") == F.col("k2")).alias("same")), int(n))


def bubble_starts(edges: DataFrame) -> DataFrame:
    """(pred, succ) with exactly two single-way nodes between them."""
    e = edges.select("src", "dst").distinct()
    single = degrees(e).where("n_in = 1 and n_out = 1").select("node")
    ends = single.join(e.select(F.col("dst").alias("node"), F.col("src").alias("pred")), "node").join(e.select(F.col("src").alias("node"), F.col("dst").alias("succ")), "node")
    return ends.groupBy("pred", "succ").agg(F.count("*").alias("n")).where("n = 2").select("pred", "succ")


def split_branches(edges: DataFrame, hops: int) -> DataFrame:
    """Edges that stay after every node is cut off whose branches (successors) have a pair without a common node within `hops`."""
    e = edges.select("src", "dst").distinct()
    near = reach(e, hops).select(F.col("src").alias("at"), F.col("dst").alias("seen")).union(e.select(F.col("dst").alias("at"), F.col("dst").alias("seen"))).distinct()
    fan = e.select(F.col("src").alias("node"), F.col("dst").alias("branch"))
    two = fan.alias("l").join(fan.alias("r"), "node").where("l.branch < r.branch").select("node", F.col("l.branch").alias("x"), F.col("r.branch").alias("y"))
    share = two.join(near.select(F.col("at").alias("x"), "seen"), "x").join(near.select(F.col("at").alias("y"), "seen"), ["y", "seen"]).select("node", "x", "y").distinct()
    cut = two.join(share, ["node", "x", "y"], "left_anti").select("node").distinct()
    return e.join(cut.withColumnRenamed("node", "src"), "src", "left_anti")


def follow_single(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, end, steps): the end of the chain of single successors from each node, by pointer doubling to the very end.

    Chains that run into a circle have no end: they stop after 2^rounds steps.
    """
    e = edges.select("src", "dst").distinct()
    one = e.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select(F.col("src").alias("node"), F.col("dst").alias("end"), F.lit(1).cast("long").alias("steps"))
    at = stored(one)
    nodes, k = at.count(), 0
    more = lambda: at.join(one.select(F.col("node").alias("end")), "end", "left_semi")
    bounded = at
    while k < rounds or 2**k <= nodes and more().take(1):
        nxt = at.select(F.col("node").alias("end"), F.col("end").alias("further"), F.col("steps").alias("more"))
        at = stored(at.join(nxt, "end", "left").select("node", F.coalesce("further", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        k += 1
        bounded = at if k == rounds else bounded
    endless = more().select("node")
    return at.join(endless, "node", "left_anti").union(bounded.join(endless, "node", "left_semi").select("node", "end", "steps"))


def last_orientation(nodes: DataFrame, strands: DataFrame) -> DataFrame:
    """(node, orient): the orientation of a node's last edge line (node, ord, orient); `+` where it has none."""
    o = strands.groupBy("node").agg(F.max_by("orient", "ord").alias("orient"))
    return nodes.join(o, "node", "left").select("node", F.coalesce("orient", F.lit("+")).alias("orient"))


def adjacency(links: DataFrame, loops: bool = True) -> DataFrame:
    """(i, j, v): a symmetric matrix of links (a, b, links), with ones on the diagonal on request."""
    m = links.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("links").cast("double").alias("v"))
    m = m.union(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    if loops:
        m = m.union(m.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")))
    return m


def columns_normalised(m: DataFrame) -> DataFrame:
    """m with columns that sum to one."""
    w = m.groupBy("j").agg(F.sum("v").alias("t"))
    return m.join(w, "j").select("i", "j", (F.col("v") / F.col("t")).alias("v"))


def mcl_step(m: DataFrame, inflation: float = 2.0, prune: float = 1e-4) -> DataFrame:
    """One round on a column-stochastic matrix: expand, inflate, prune (a column keeps its largest entry), normalise."""
    square = m.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(m.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    inflated = columns_normalised(square.withColumn("v", F.pow("v", F.lit(inflation))))
    top = inflated.groupBy("j").agg(F.max("v").alias("top"))
    return columns_normalised(inflated.join(top, "j").where((F.col("v") >= prune) | (F.col("v") == F.col("top"))).select("i", "j", "v"))


def markov_clusters(links: DataFrame, inflation: float = 2.0, prune: float = 1e-4, max_rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(grp, ctg): Markov clustering; a cluster is named by its smallest attractor."""
    from linkloom.operators.components import components

    m = stored(columns_normalised(adjacency(links)))
    for _ in range(max_rounds):
        new = stored(mcl_step(m, inflation, prune))
        both = new.withColumnRenamed("v", "x").join(m.withColumnRenamed("v", "y"), ["i", "j"], "full_outer")
        change = both.agg(F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))).alias("c")).first().c
        m = new
        if change is None or change < tolerance:
            break
    else:
        log.warning("columns still change by %g after %d rounds", change, max_rounds)
    pull = m.where(F.col("v") > tolerance)
    label = components(pull.where("i <> j"), "i", "j")
    nodes = m.select(F.col("j").alias("node")).distinct()
    return nodes.join(label, "node", "left").select(F.coalesce("component", "node").alias("grp"), F.col("node").alias("ctg"))


def inflation_search(links: DataFrame, lengths: DataFrame, inflations: list[float], wanted: int, ratios: tuple[float, ...] = (0.75, 0.7, 0.65, 0.6, 0.55, 0.5), prune: float = 1e-4, max_rounds: int = 200) -> DataFrame:
    """(inflation, clusters, main, ratio, recommended): Markov clustering at each inflation, and which to try.

    `main` counts the clusters, by falling length, before the first that is shorter than `ratio` of the one before it. The
    strictest ratio at which any inflation gives at least `wanted` main clusters is used (else the last), and
    of these inflations the least is recommended. lengths: ctg, len. Inflations near 1 settle slowly (1.05 on forty
    nodes: 206 rounds); after `max_rounds` the matrix is read as it stands.
    """
    found = None
    for x in inflations:
        grouped = markov_clusters(links, x, prune, max_rounds).join(lengths, "ctg").groupBy("grp").agg(F.sum("len").alias("len")).withColumn("inflation", F.lit(float(x)))
        found = grouped if found is None else found.union(grouped)
    found = stored(found, few=True)
    by_len = Window.partitionBy("inflation").orderBy(F.desc("len"), "grp")
    drops = found.select("inflation", F.row_number().over(by_len).alias("k"), (F.lead("len").over(by_len) / F.col("len")).alias("drop"))
    each = drops.select("inflation", "k", "drop", F.explode(F.array(*map(F.lit, ratios))).alias("ratio"))
    main = each.groupBy("inflation", "ratio").agg(F.count("*").alias("clusters"), F.coalesce(F.min(F.when(F.col("drop") < F.col("ratio"), F.col("k"))), F.count("*")).alias("main"))
    fit = main.agg(F.coalesce(F.max(F.when(F.col("main") >= wanted, F.col("ratio"))), F.lit(ratios[-1])).alias("ratio"))  # one row
    used = main.join(F.broadcast(fit), "ratio")
    least = F.min(F.when(F.col("main") >= wanted, F.col("inflation"))).over(Window.partitionBy("ratio"))  # a row per inflation
    return used.select("inflation", "clusters", "main", "ratio", F.coalesce(F.col("inflation") == least, F.lit(False)).alias("recommended"))


def attractors(m: DataFrame) -> DataFrame:
    """(i, n): rows of a settled matrix with a diagonal entry, and how many members each draws."""
    rows = m.where("i = j and v > 0").select("i")
    return m.join(rows, "i", "left_semi").where("v > 0").groupBy("i").agg(F.count("*").alias("n"))


def bin_vote(bins: DataFrame) -> DataFrame:
    """(ctg, grp): the cluster that holds the greatest length of a contig's bins (ctg, grp, len), ties by group."""
    g = bins.groupBy("ctg", "grp").agg(F.sum("len").alias("len"))
    return g.groupBy("ctg").agg(F.max_by("grp", F.struct("len", -F.col("grp"))).alias("grp"))


def rescue_orphans(links: DataFrame, clusters: DataFrame, subgraphs: DataFrame) -> DataFrame:
    """(ctg, grp) for unclustered contigs: the group of clustered siblings of their subgraph, else the one with most links."""
    from linkloom.operators.links import group_links

    w = Window.partitionBy("sub").orderBy(F.desc("n"), "grp")
    home = subgraphs.join(clusters, "ctg").groupBy("sub", "grp").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(w)).where("k = 1").select("sub", F.col("grp").alias("home"))
    orphans = subgraphs.join(clusters.select("ctg"), "ctg", "left_anti")
    pull = group_links(links, clusters).join(orphans.select("ctg", "sub"), "ctg").groupBy("sub", "grp").agg(F.sum("links").alias("n"))
    best = pull.groupBy("sub").agg(F.max_by("grp", F.struct("n", -F.col("grp"))).alias("best"))
    return orphans.join(home, "sub", "left").join(best, "sub", "left").select("ctg", F.coalesce("home", "best").alias("grp"))
