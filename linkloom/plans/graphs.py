"""Queries over graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import graph as G
from linkloom.operators.components import components
from linkloom.plans.base import alleles, clusters, contigs, graph, links, query, table

_U = "u AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph)"
_DEG = "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM graph UNION ALL SELECT dst, 1, 0 FROM graph) GROUP BY node)"
_R3 = "r1 AS (SELECT src, dst, 1 AS level FROM graph), r2 AS (SELECT DISTINCT a.src, b.dst, 2 AS level FROM r1 a JOIN graph b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM r1 z WHERE z.src = a.src AND z.dst = b.dst)), r3 AS (SELECT DISTINCT a.src, b.dst, 3 AS level FROM r2 a JOIN graph b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM r1 z WHERE z.src = a.src AND z.dst = b.dst) AND NOT EXISTS (SELECT 1 FROM r2 z WHERE z.src = a.src AND z.dst = b.dst))"


@query("degrees", "WITH {graph}, " + _DEG + " SELECT * FROM deg")
def _(s, d):
    return G.degrees(graph(s, d))


@query("tips", "WITH {graph}, " + _DEG + ", " + _U + " SELECT node FROM deg JOIN (SELECT src AS node, count(*) AS n FROM u GROUP BY src) USING (node) WHERE (n_in = 0 OR n_out = 0) AND n = 1")
def _(s, d):
    return G.tips(graph(s, d))


@query("hops_reach", "WITH {graph}, " + _R3 + " SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3")
def _(s, d):
    return G.reach(graph(s, d), 3)


@query("exact_hops", "WITH {graph}, " + _R3 + " SELECT dst AS node, src AS ancestor FROM r3")
def _(s, d):
    return G.reach(graph(s, d), 3).where("level = 3").select(F.col("dst").alias("node"), F.col("src").alias("ancestor"))


#: As far as the studied project looks for shortest paths, and for several paths.
FAR, DEEP = 10, 5
_WALKS = "p AS (SELECT src, dst, 1 AS level FROM graph UNION ALL SELECT p.src, g.dst, level + 1 FROM p JOIN graph g ON p.dst = g.src WHERE level < 10)"


@query("unique_shortest", "WITH RECURSIVE {graph}, " + _WALKS + ", n AS (SELECT src, dst, level, count(*) AS paths FROM p GROUP BY ALL) SELECT src, dst, level FROM n QUALIFY level = min(level) OVER (PARTITION BY src, dst) AND paths = 1")
def _(s, d):
    return G.path_counts(graph(s, d), FAR).where("paths = 1").select("src", "dst", "level")


@query("multiple_paths", "WITH RECURSIVE {graph}, p AS (SELECT src, dst, [src, dst] AS nodes FROM graph UNION ALL SELECT p.src, g.dst, list_append(nodes, g.dst) FROM p JOIN graph g ON p.dst = g.src WHERE len(nodes) < 6 AND NOT list_contains(nodes, g.dst)) SELECT src, dst, count(*) AS paths FROM p GROUP BY ALL HAVING count(*) >= 2")
def _(s, d):
    return G.simple_paths(graph(s, d), DEEP).groupBy("src", "dst").agg(F.count("*").alias("paths")).where("paths >= 2")


@query("path_nodes", "WITH RECURSIVE {graph}, p AS (SELECT src, dst, [src, dst] AS nodes FROM graph UNION ALL SELECT p.src, g.dst, list_append(nodes, g.dst) FROM p JOIN graph g ON p.dst = g.src WHERE len(nodes) < 4 AND NOT list_contains(nodes, g.dst)) SELECT src, dst, array_to_string(list_transform(nodes, lambda x: CAST(x AS VARCHAR)), '>') AS path FROM p")
def _(s, d):
    return G.simple_paths(graph(s, d), 3).select("src", "dst", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"))


@query("transitive_reduction", "WITH RECURSIVE {graph}, w AS (SELECT a.src, b.dst FROM graph a JOIN graph b ON a.dst = b.src UNION SELECT w.src, g.dst FROM w JOIN graph g ON w.dst = g.src) SELECT src, dst FROM graph EXCEPT SELECT src, dst FROM w")
def _(s, d):
    return G.transitive_reduction(graph(s, d))


_FANS = "fans AS (SELECT o_custkey AS src, 1000000 + o_orderkey AS dst FROM orders UNION SELECT 1000000 + o_orderkey, 9000000 + o_custkey FROM orders UNION SELECT 1000000 + src, 1000000 + one FROM nxt WHERE one IS NOT NULL)"


def _fans(s, d):
    """Every customer to its orders, these to the customer's end, and each order to the next."""
    order = 1000000 + F.col("o_orderkey")
    o = table(s, d, "orders").withColumn("next", F.lead(order).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    ways = F.array(F.struct(F.col("o_custkey").alias("src"), order.alias("dst")), F.struct(order.alias("src"), (9000000 + F.col("o_custkey")).alias("dst")), F.struct(order.alias("src"), F.col("next").alias("dst")))
    return o.select(F.inline(ways)).where("dst is not null")


@query("diamonds", "WITH {graph}, " + _FANS + ", u AS (SELECT src, dst FROM fans UNION SELECT dst, src FROM fans), x AS (SELECT p.src AS a, p.dst AS b, q.dst AS d FROM fans p JOIN fans q ON p.dst = q.src WHERE p.src <> q.dst) SELECT x.a, x.b, y.b AS c, x.d FROM x JOIN x y ON x.a = y.a AND x.d = y.d AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.src = x.b AND u.dst = y.b)")
def _(s, d):
    return G.diamonds(_fans(s, d))


_ENDS = "single AS (SELECT node FROM (SELECT src AS node, 0 AS i, 1 AS o FROM sh UNION ALL SELECT dst, 1, 0 FROM sh) GROUP BY node HAVING sum(i) = 1 AND sum(o) = 1), ends AS (SELECT node, p.src AS pred, n.dst AS succ FROM single JOIN sh p ON p.dst = node JOIN sh n ON n.src = node)"
_SHORT = "sh AS (SELECT DISTINCT c_nationkey AS src, 1000 + c_custkey AS dst FROM customer UNION SELECT 1000 + c_custkey, 1000000 + c_nationkey % 5 FROM customer)"


def _short(s, d):
    c = table(s, d, "customer")
    one = c.select(F.col("c_nationkey").cast("long").alias("src"), (1000 + F.col("c_custkey")).alias("dst"))
    return one.union(c.select((1000 + F.col("c_custkey")).alias("src"), (1000000 + F.col("c_nationkey") % 5).cast("long").alias("dst"))).distinct()


@query("bubble_pairs", "WITH " + _SHORT + ", " + _ENDS + " SELECT l.node AS x, r.node AS y FROM ends l JOIN ends r ON l.pred = r.pred AND l.succ = r.succ AND l.node < r.node")
def _(s, d):
    return G.bubbles(_short(s, d))


@query("bubble_starts", "WITH sh AS (SELECT DISTINCT o_custkey AS src, 1000000 + o_orderkey AS dst FROM orders UNION SELECT 1000000 + o_orderkey, 9000000 + o_custkey FROM orders), " + _ENDS + " SELECT pred, succ FROM ends GROUP BY ALL HAVING count(*) = 2")
def _(s, d):
    o = table(s, d, "orders")
    e = o.select(F.col("o_custkey").alias("src"), (1000000 + F.col("o_orderkey")).alias("dst")).union(o.select((1000000 + F.col("o_orderkey")).alias("src"), (9000000 + F.col("o_custkey")).alias("dst")))
    return G.bubble_starts(e)


@query("branch_split", "WITH {graph}, r1 AS (SELECT src, dst FROM graph), r2 AS (SELECT DISTINCT a.src, b.dst FROM graph a JOIN graph b ON a.dst = b.src WHERE a.src <> b.dst), near AS (SELECT src AS at_, dst AS seen FROM r1 UNION SELECT src, dst FROM r2 UNION SELECT dst, dst FROM graph), two AS (SELECT l.src AS node, l.dst AS x, r.dst AS y FROM graph l JOIN graph r ON l.src = r.src AND l.dst < r.dst), cut AS (SELECT DISTINCT node FROM two WHERE NOT EXISTS (SELECT 1 FROM near p JOIN near q ON p.seen = q.seen WHERE p.at_ = two.x AND q.at_ = two.y)) SELECT src, dst FROM graph WHERE src NOT IN (SELECT node FROM cut)")
def _(s, d):
    return G.split_branches(graph(s, d), 2)


@query("linear_paths", "WITH RECURSIVE {graph}, one AS (SELECT src, min(dst) AS dst FROM graph GROUP BY src HAVING count(*) = 1), p AS (SELECT src AS node, dst AS at_, 1 AS steps FROM one UNION ALL SELECT node, one.dst, steps + 1 FROM p JOIN one ON one.src = at_) SELECT node, arg_max(at_, steps) AS end_node, CAST(max(steps) AS BIGINT) AS steps FROM p GROUP BY node")
def _(s, d):
    return G.follow_single(graph(s, d), 4).withColumnRenamed("end", "end_node")


@query("graph_components", "WITH RECURSIVE {graph}, " + _U + ", r AS (SELECT src AS node, src AS seen FROM u UNION SELECT r.node, u.dst FROM r JOIN u ON r.seen = u.src) SELECT node, min(seen) AS component FROM r GROUP BY node")
def _(s, d):
    return components(graph(s, d), "src", "dst")


@query("node_orientation", "SELECT n_nationkey AS node, coalesce((SELECT CASE WHEN arg_max(c_custkey % 2, c_custkey) = 0 THEN '+' ELSE '-' END FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000 HAVING count(*) > 0), '+') AS orient FROM nation")
def _(s, d):
    strands = table(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("node"), F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 2 == 0, "+").otherwise("-").alias("orient"))
    return G.last_orientation(table(s, d, "nation").select(F.col("n_nationkey").alias("node")), strands)


_THICK = "thick AS (SELECT a, b, links FROM links WHERE links >= 3)"
_ALL = "thick AS (SELECT a, b, links FROM links)"
_M = "adj AS (SELECT a AS i, b AS j, CAST(links AS DOUBLE) AS v FROM thick UNION ALL SELECT b, a, links FROM thick), m0 AS (SELECT * FROM adj UNION ALL SELECT DISTINCT i, i, 1.0 FROM adj), m AS (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM m0)"


def _thick(s, d):
    """Links of three or more lines, which Markov rounds multiply; the matrix itself and its attractors take all links."""
    return links(s, d).where("links >= 3")


@query("adjacency", "WITH {links}, " + _ALL + ", " + _M + " SELECT i, j, v FROM m0")
def _(s, d):
    return G.adjacency(links(s, d))


@query("mcl_step", "WITH {links}, " + _THICK + ", " + _M + ", sq AS (SELECT x.i, y.j, power(sum(x.v * y.v), 2) AS v FROM m x JOIN m y ON x.j = y.i GROUP BY ALL), inf AS (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM sq), kept AS (SELECT * FROM inf QUALIFY v >= 0.01 OR v = max(v) OVER (PARTITION BY j)) SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 5) AS v FROM kept")
def _(s, d):
    m = G.columns_normalised(G.adjacency(_thick(s, d)))
    return G.mcl_step(m, prune=0.01).select("i", "j", F.round("v", 5).alias("v"))


@query("mcl_attractors", "WITH {links}, " + _ALL + ", " + _M + ", big AS (SELECT * FROM m WHERE v >= 0.02) SELECT i, count(*) AS n FROM big WHERE i IN (SELECT i FROM big WHERE i = j) GROUP BY i")
def _(s, d):
    return G.attractors(G.columns_normalised(G.adjacency(links(s, d))).where("v >= 0.02"))


@query("mcl_clusters")
def _(s, d):
    return G.markov_clusters(_thick(s, d), prune=0.01)


@query("bin_vote", "WITH b AS (SELECT o_custkey AS ctg, o_orderkey % 6 AS grp, CAST(sum(floor(o_totalprice)) AS BIGINT) AS len FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY len DESC, grp) AS k FROM b) SELECT ctg, grp FROM r WHERE k = 1")
def _(s, d):
    return G.bin_vote(table(s, d, "orders").select(F.col("o_custkey").alias("ctg"), (F.col("o_orderkey") % 6).alias("grp"), F.floor("o_totalprice").alias("len")))


@query("orphan_rescue", "WITH {links}, cl AS (SELECT p_partkey AS ctg, p_partkey % 7 AS grp FROM part WHERE p_size > 15), sub AS (SELECT p_partkey AS ctg, p_partkey % 211 AS sub FROM part), hm AS (SELECT sub, grp, count(*) AS n FROM sub JOIN cl USING (ctg) GROUP BY ALL), home AS (SELECT sub, grp AS home FROM hm QUALIFY row_number() OVER (PARTITION BY sub ORDER BY n DESC, grp) = 1), orph AS (SELECT * FROM sub WHERE ctg NOT IN (SELECT ctg FROM cl)), be AS (SELECT a AS ctg, b AS partner, links FROM links UNION ALL SELECT b, a, links FROM links), pull AS (SELECT orph.sub, cl.grp, sum(links) AS n FROM orph JOIN be ON be.ctg = orph.ctg JOIN cl ON cl.ctg = be.partner GROUP BY ALL), best AS (SELECT sub, grp AS best FROM pull QUALIFY row_number() OVER (PARTITION BY sub ORDER BY n DESC, grp) = 1) SELECT orph.ctg, coalesce(home, best) AS grp FROM orph LEFT JOIN home USING (sub) LEFT JOIN best USING (sub)")
def _(s, d):
    p = table(s, d, "part")
    cl = p.where("p_size > 15").select(F.col("p_partkey").alias("ctg"), (F.col("p_partkey") % 7).alias("grp"))
    return G.rescue_orphans(links(s, d), cl, p.select(F.col("p_partkey").alias("ctg"), (F.col("p_partkey") % 211).alias("sub")))


@query("allele_filter", "WITH {links}, {alleles}, {contigs} SELECT a, b, sim FROM alleles JOIN contigs x ON a = x.ctg JOIN contigs y ON b = y.ctg WHERE (a, b) NOT IN (SELECT (src, dst) FROM (SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_returnflag = 'R')) AND least(x.len, y.len) >= 50000 AND a % 11 <> b % 11")
def _(s, d):
    """Allele pairs of long contigs in different subgraphs that are not neighbours; returned lines stand for neighbours."""
    from linkloom.operators.links import with_ends, without_pairs

    x = with_ends(alleles(s, d), contigs(s, d), "len").where("least(len_a, len_b) >= 50000 and a % 11 <> b % 11").select("a", "b", "sim")
    return without_pairs(x, table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))
