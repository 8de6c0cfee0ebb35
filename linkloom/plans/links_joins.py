"""Queries over link tables, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import joins
from linkloom.operators import links as L
from linkloom.plans.base import alleles, clusters, contigs, depth, graph, layout, links, pairs, query, spans, table


def _r(name: str):
    return F.round(name, 6).alias(name)


_RATIO = "ratio AS (SELECT a, b, links / ((x.re_sites / x.len) * (y.re_sites / y.len)) / 1e6 AS value FROM links JOIN contigs x ON a = x.ctg JOIN contigs y ON b = y.ctg)"
_BOTH = "both_ends AS (SELECT a AS ctg, b AS partner, links FROM links UNION ALL SELECT b, a, links FROM links)"


@query("links_ordered", "WITH {pairs} SELECT c1, c2, count(*) AS links FROM pairs WHERE c1 <> c2 AND (mapq >= 1 OR mapq IS NULL) GROUP BY ALL")
def _(s, d):
    return L.count_ordered(pairs(s, d))


@query("links_pair", "WITH {links} SELECT a, b, links FROM links")
def _(s, d):
    return links(s, d)


@query("links_ratio", "WITH {links}, {contigs}, " + _RATIO + " SELECT a, b, value FROM ratio")
def _(s, d):
    return L.normalise(links(s, d), contigs(s, d), "ratio")


@query("links_length", "WITH {links}, {contigs} SELECT a, b, round(links / (CAST(x.len AS DOUBLE) * y.len) * 1e12, 6) AS value FROM links JOIN contigs x ON a = x.ctg JOIN contigs y ON b = y.ctg")
def _(s, d):
    return L.normalise(links(s, d), contigs(s, d), "length").select("a", "b", _r("value"))


@query("links_flank", "WITH {links}, {contigs} SELECT a, b, round(links / ((least(x.len, 100000) / 1e6) * (least(y.len, 100000) / 1e6)), 6) AS value FROM links JOIN contigs x ON a = x.ctg JOIN contigs y ON b = y.ctg")
def _(s, d):
    return L.normalise(links(s, d), contigs(s, d), "flank", flank=50_000).select("a", "b", _r("value"))


@query("links_degree", "WITH {links}, deg AS (SELECT ctg, sum(w) AS d FROM (SELECT a AS ctg, links AS w FROM links UNION ALL SELECT b, links FROM links) GROUP BY ctg) SELECT a, b, round(links / sqrt(CAST(x.d AS DOUBLE) * y.d), 6) AS value FROM links JOIN deg x ON a = x.ctg JOIN deg y ON b = y.ctg")
def _(s, d):
    return L.normalise_by_degree(links(s, d)).select("a", "b", _r("value"))


@query("links_degree_rescaled", "WITH {links}, deg AS (SELECT ctg, sum(w) AS d FROM (SELECT a AS ctg, links AS w FROM links UNION ALL SELECT b, links FROM links) GROUP BY ctg), n AS (SELECT a, b, links, links / sqrt(CAST(x.d AS DOUBLE) * y.d) AS v FROM links JOIN deg x ON a = x.ctg JOIN deg y ON b = y.ctg) SELECT a, b, round(v * (SELECT sum(links) / sum(v) FROM n), 4) AS value FROM n")
def _(s, d):
    return L.normalise_by_degree(links(s, d), rescale=True).select("a", "b", F.round("value", 4).alias("value"))


@query("links_similarity", "WITH {links}, {alleles}, {contigs} SELECT a, b, round(sim * least(x.len, y.len), 4) AS by_min, round(sim * (1 - (1 - least(x.len, y.len) / CAST(greatest(x.len, y.len) AS DOUBLE)) * 0.1) * (x.len + y.len) / 2, 4) AS by_penalty FROM alleles JOIN contigs x ON a = x.ctg JOIN contigs y ON b = y.ctg")
def _(s, d):
    x = L.with_ends(alleles(s, d), contigs(s, d), "len")
    low, high = F.least("len_a", "len_b"), F.greatest("len_a", "len_b")
    penalty = F.col("sim") * (1 - (1 - low / high) * 0.1) * (F.col("len_a") + F.col("len_b")) / 2
    return x.select("a", "b", F.round(F.col("sim") * low, 4).alias("by_min"), F.round(penalty, 4).alias("by_penalty"))


@query("best_partners", "WITH {links}, {contigs}, " + _RATIO + ", both_ends AS (SELECT a AS ctg, b AS partner, value FROM ratio UNION ALL SELECT b, a, value FROM ratio), ranked AS (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY value DESC, partner) AS rank FROM both_ends) SELECT ctg, CAST(rank AS INTEGER) AS rank, partner, value FROM ranked WHERE rank <= 2")
def _(s, d):
    """Flagship: pairs to links, normalised by restriction-site density, best and second-best partner per contig."""
    return L.best_partners(L.normalise(links(s, d), contigs(s, d), "ratio"))


@query("best_two_groups", "WITH {links}, {clusters}, " + _BOTH + ", g AS (SELECT b.ctg, c.grp, CAST(sum(links) AS BIGINT) AS links FROM both_ends b JOIN clusters c ON c.ctg = b.partner GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY links DESC, grp) AS rn, lead(links) OVER (PARTITION BY ctg ORDER BY links DESC, grp) AS second FROM g) SELECT ctg, grp, links, round(coalesce(second, 0) / links, 6) AS ambiguity FROM r WHERE rn = 1")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("ctg").orderBy(F.desc("links"), "grp")
    g = L.group_links(links(s, d), clusters(s, d)).withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("links").over(w))
    return g.where("rn = 1").select("ctg", "grp", "links", F.round(F.coalesce("second", F.lit(0)) / F.col("links"), 6).alias("ambiguity"))


@query("group_links", "WITH {links}, {clusters}, " + _BOTH + " SELECT b.ctg, c.grp, CAST(sum(links) AS BIGINT) AS links FROM both_ends b JOIN clusters c ON c.ctg = b.partner GROUP BY ALL")
def _(s, d):
    return L.group_links(links(s, d), clusters(s, d))


@query("group_contract", "WITH {links}, {clusters} SELECT least(x.grp, y.grp) AS g1, greatest(x.grp, y.grp) AS g2, CAST(sum(links) AS BIGINT) AS links FROM links JOIN clusters x ON a = x.ctg JOIN clusters y ON b = y.ctg WHERE x.grp <> y.grp GROUP BY ALL")
def _(s, d):
    return L.contract(links(s, d), clusters(s, d))


@query("density_cut", "WITH {links}, n AS (SELECT count(*) * 12 AS most FROM (SELECT a FROM links UNION SELECT b FROM links)), lv AS (SELECT *, floor(links / 0.5) AS level FROM links), h AS (SELECT level, sum(count(*)) OVER (ORDER BY level DESC) AS upto FROM lv GROUP BY level), cut AS (SELECT coalesce(min(level) FILTER (WHERE upto < (SELECT most FROM n)), max(level) + 1) AS cut FROM h) SELECT a, b, links FROM lv WHERE level >= (SELECT cut FROM cut)")
def _(s, d):
    return L.density_cut(links(s, d), per_node=12)


@query("semi_both_ends", "WITH {links}, {contigs}, keep AS (SELECT ctg FROM contigs WHERE re_sites > 10) SELECT a, b, links FROM links WHERE a IN (SELECT ctg FROM keep) AND b IN (SELECT ctg FROM keep)")
def _(s, d):
    return L.between(links(s, d), contigs(s, d).where("re_sites > 10"))


@query("allele_anti", "WITH {links}, {alleles} SELECT a, b, links FROM links WHERE NOT EXISTS (SELECT 1 FROM alleles x WHERE x.a = links.a AND x.b = links.b AND sim >= 0.5)")
def _(s, d):
    return L.without_pairs(links(s, d), alleles(s, d).where("sim >= 0.5"))


@query("unplaced_anti", "WITH {contigs} SELECT ctg, len FROM contigs WHERE ctg NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def _(s, d):
    used = table(s, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("ctg")).distinct()
    return contigs(s, d).join(used, "ctg", "left_anti").select("ctg", "len")


@query("integrity_gap", "SELECT 'layout' AS missing_from, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_partkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'copies', CAST(count(*) AS BIGINT) FROM part WHERE p_partkey NOT IN (SELECT ps FROM (SELECT l_suppkey AS ps FROM lineitem))")
def _(s, d):
    c = contigs(s, d).select("ctg")
    gap = lambda other, name: c.join(other.distinct(), "ctg", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("missing_from"), "n")
    return gap(table(s, d, "orders").select(F.col("o_orderkey").alias("ctg")), "layout").union(gap(table(s, d, "lineitem").select(F.col("l_suppkey").alias("ctg")), "copies"))


@query("range_component", "WITH {layout}, {agp}, p AS (SELECT o_custkey AS scaffold, o_orderkey AS read, CAST(floor(o_totalprice * 3) AS BIGINT) AS pos FROM orders) SELECT read, scaffold, pos, ctg FROM p JOIN agp USING (scaffold) WHERE pos BETWEEN beg AND fin")
def _(s, d):
    from linkloom.operators.layout import coordinates

    p = table(s, d, "orders").select(F.col("o_custkey").alias("scaffold"), F.col("o_orderkey").alias("read"), F.floor(F.col("o_totalprice") * 3).alias("pos"))
    return joins.in_intervals(p, coordinates(layout(s, d)), "scaffold", "pos", 100_000).select("read", "scaffold", "pos", "ctg")


@query("asof_fragment", "WITH b AS (SELECT DISTINCT event_type, CAST(floor(value / 50) * 50 AS BIGINT) AS start FROM events WHERE user_id % 3 = 0), e AS (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS pos FROM events) SELECT event_id, e.event_type, pos, start FROM e ASOF LEFT JOIN b ON e.event_type = b.event_type AND e.pos >= b.start")
def _(s, d):
    e = table(s, d, "events")
    breaks = e.where("user_id % 3 = 0").select("event_type", (F.floor(F.col("value") / 50) * 50).alias("start")).distinct()
    return joins.as_of(e.select("event_id", "event_type", F.floor("value").alias("pos")), breaks, ["event_type"], "pos", "start", ["start"])


@query("best_overlap", "WITH {layout}, {agp}, q AS (SELECT o_orderkey AS query, o_custkey AS scaffold, CAST(floor(o_totalprice) AS BIGINT) AS qs, CAST(floor(o_totalprice) AS BIGINT) + 150000 AS qe FROM orders), h AS (SELECT query, ctg AS target, least(qe, fin) - greatest(qs, beg) + 1 AS overlap FROM q JOIN agp USING (scaffold) WHERE qs <= fin AND qe >= beg), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY overlap DESC, target) AS rn FROM h) SELECT query, target, overlap FROM r WHERE rn = 1")
def _(s, d):
    from linkloom.operators.layout import coordinates

    q = table(s, d, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_custkey").alias("scaffold"), F.floor("o_totalprice").alias("qs"), (F.floor("o_totalprice") + 150_000).alias("qe"))
    return joins.best_overlap(q, coordinates(layout(s, d)).withColumnRenamed("ctg", "target"), "scaffold", 200_000)


@query("gene_windows", "WITH {depth}, genes AS (SELECT n_nationkey AS gene, (CASE n_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END) AS chrom, (SELECT min(win) FROM depth) + n_nationkey AS gs, (SELECT min(win) FROM depth) + n_nationkey + 3 AS ge FROM nation) SELECT gene, chrom, sample, count(*) AS windows, round(median(rd), 6) AS mid FROM genes JOIN depth USING (chrom) WHERE win BETWEEN gs AND ge GROUP BY ALL")
def _(s, d):
    from linkloom.plans.cnv import genes

    w = joins.windows_of(genes(s, d), depth(s, d))
    return w.groupBy("gene", "chrom", "sample").agg(F.count("*").alias("windows"), F.round(F.median("rd"), 6).alias("mid"))


@query("copies_cross", "WITH {links}, c AS (SELECT p_partkey AS ctg, 1 + p_size % 3 AS copies FROM part WHERE p_size > 25), n AS (SELECT a, b, coalesce(x.copies, 1) AS na, coalesce(y.copies, 1) AS nb FROM links LEFT JOIN c x ON a = x.ctg LEFT JOIN c y ON b = y.ctg WHERE links >= 2) SELECT a, b, CAST(i AS INTEGER) AS copy_a, CAST(j AS INTEGER) AS copy_b FROM (SELECT a, b, nb, unnest(range(1, na + 1)) AS i FROM n) t, LATERAL (SELECT unnest(range(1, nb + 1)) AS j)")
def _(s, d):
    copies = table(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("ctg"), (1 + F.col("p_size") % 3).alias("copies"))
    return joins.copies_product(links(s, d).where("links >= 2").select("a", "b"), copies)


@query("read_pair_combos", "WITH a AS (SELECT DISTINCT l_orderkey AS read, l_partkey AS item FROM lineitem) SELECT x.read, x.item AS x, y.item AS y FROM a x JOIN a y ON x.read = y.read AND x.item < y.item")
def _(s, d):
    return joins.combinations(table(s, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_partkey").alias("item")), "read", "item")


@query("subgraph_expand", "WITH {links}, gp AS (SELECT DISTINCT least(a % 50, b % 50) AS g1, greatest(a % 50, b % 50) AS g2 FROM links WHERE links >= 3 AND a % 50 <> b % 50), m AS (SELECT c_custkey AS ctg, c_custkey % 50 AS grp FROM customer WHERE c_acctbal > 8000) SELECT DISTINCT least(x.ctg, y.ctg) AS x, greatest(x.ctg, y.ctg) AS y FROM gp JOIN m x ON g1 = x.grp JOIN m y ON g2 = y.grp WHERE x.ctg <> y.ctg")
def _(s, d):
    gp = links(s, d).where("links >= 3 and a % 50 <> b % 50").select(F.least(F.col("a") % 50, F.col("b") % 50).alias("g1"), F.greatest(F.col("a") % 50, F.col("b") % 50).alias("g2")).distinct()
    members = table(s, d, "customer").where("c_acctbal > 8000").select(F.col("c_custkey").alias("ctg"), (F.col("c_custkey") % 50).alias("grp"))
    return joins.expand_members(gp, members)


@query("mate_pairs", "SELECT x.l_orderkey AS read, x.l_partkey AS c1, y.l_partkey AS c2 FROM lineitem x JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND y.rn = 2 JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) z ON z.l_orderkey = x.l_orderkey AND z.rn = 1 AND z.l_partkey = x.l_partkey AND z.l_suppkey = x.l_suppkey AND z.l_extendedprice = x.l_extendedprice AND z.l_linenumber = x.l_linenumber")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = table(s, d, "lineitem").withColumn("rn", F.row_number().over(w)).withColumn("mate", F.lead("l_partkey").over(w))
    return x.where("rn = 1 and mate is not null").select(F.col("l_orderkey").alias("read"), F.col("l_partkey").alias("c1"), F.col("mate").alias("c2"))


@query("default_lookup", "WITH {links}, t AS (SELECT p_partkey AS a, p_brand AS brand FROM part WHERE p_size < 20) SELECT links.a, b, links, coalesce(brand, 'none') AS brand FROM links LEFT JOIN t ON links.a = t.a")
def _(s, d):
    t = table(s, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("brand"))
    return joins.default_lookup(links(s, d), t, "a", "brand", "none").select("a", "b", "links", "brand")


@query("preview_filter", "WITH {depth} SELECT sample, chrom, win, rd FROM depth WHERE ('All' = 'All' OR sample = 0) AND ('click' = 'All' OR chrom = 'click')")
def _(s, d):
    from linkloom.operators.cnv import preview

    return preview(depth(s, d), sample="All", chrom="click").select("sample", "chrom", "win", "rd")


@query("membership_compose", "SELECT n_regionkey AS grp, c_custkey AS ctg FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def _(s, d):
    outer = table(s, d, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("inner"))
    inner = table(s, d, "customer").select(F.col("c_nationkey").alias("inner"), F.col("c_custkey").alias("ctg"))
    return outer.join(inner, "inner").select("grp", "ctg").distinct()


@query("subgraph_semi", "WITH m AS (SELECT o_custkey AS sub, o_orderkey AS ctg FROM orders), l AS (SELECT l_orderkey AS ctg FROM lineitem WHERE l_quantity >= 49) SELECT sub, ctg FROM m WHERE sub IN (SELECT sub FROM m WHERE ctg IN (SELECT ctg FROM l))")
def _(s, d):
    m = table(s, d, "orders").select(F.col("o_custkey").alias("sub"), F.col("o_orderkey").alias("ctg"))
    hit = m.join(table(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("ctg")), "ctg", "left_semi").select("sub").distinct()
    return m.join(hit, "sub", "left_semi")


@query("allele_tables_differ", "SELECT x.l_orderkey AS chrom, x.l_linenumber AS pos, count(*) AS rows FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber WHERE x.l_returnflag <> y.l_returnflag GROUP BY ALL")
def _(s, d):
    x = table(s, d, "lineitem").select(F.col("l_orderkey").alias("chrom"), F.col("l_linenumber").alias("pos"), "l_returnflag")
    return x.join(x.withColumnRenamed("l_returnflag", "other"), ["chrom", "pos"]).where("l_returnflag <> other").groupBy("chrom", "pos").agg(F.count("*").alias("rows"))


@query("allele_flag", "WITH {links}, {alleles} SELECT l.a, l.b, x.a IS NOT NULL AS allelic FROM links l LEFT JOIN alleles x ON l.a = x.a AND l.b = x.b")
def _(s, d):
    known = alleles(s, d).select("a", "b", F.lit(True).alias("allelic"))
    return links(s, d).join(known, ["a", "b"], "left").select("a", "b", F.coalesce("allelic", F.lit(False)).alias("allelic"))


@query("nodes_union", "WITH {links} SELECT a AS ctg FROM links UNION SELECT b FROM links")
def _(s, d):
    x = links(s, d)
    return x.select(F.col("a").alias("ctg")).union(x.select("b")).distinct()


@query("surviving_intersect", "WITH {contigs}, {links} SELECT ctg FROM contigs WHERE len < (SELECT avg(len) FROM contigs) INTERSECT SELECT a FROM links WHERE links >= 2")
def _(s, d):
    c = contigs(s, d)
    mean = c.agg(F.avg("len").alias("mean"))
    return c.crossJoin(F.broadcast(mean)).where("len < mean").select("ctg").intersect(links(s, d).where("links >= 2").select(F.col("a").alias("ctg")))


@query("dismissed_difference", "WITH {contigs}, {links} SELECT ctg FROM contigs EXCEPT SELECT b FROM links WHERE links >= 2")
def _(s, d):
    return contigs(s, d).select("ctg").subtract(links(s, d).where("links >= 2").select(F.col("b").alias("ctg")))


@query("renamed_union", "SELECT 'Chr' || n_regionkey || 'g' || (n_nationkey % 3) AS grp, n_nationkey AS ctg FROM nation UNION ALL SELECT 'ChrUn', s_suppkey FROM supplier")
def _(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("Chr"), F.col("n_regionkey").cast("string"), F.lit("g"), (F.col("n_nationkey") % 3).cast("string")).alias("grp"), F.col("n_nationkey").cast("long").alias("ctg"))
    return n.unionByName(table(s, d, "supplier").select(F.lit("ChrUn").alias("grp"), F.col("s_suppkey").alias("ctg")))


@query("merge_override", "WITH x AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size < 30), y AS (SELECT s_suppkey AS k, -s_nationkey AS v FROM supplier) SELECT coalesce(x.k, y.k) AS k, coalesce(y.v, x.v) AS v FROM x FULL JOIN y ON x.k = y.k")
def _(s, d):
    x = table(s, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    y = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), (-F.col("s_nationkey")).alias("v"))
    return joins.merge_override(x, y, "k", "v")


@query("ungrouped_completion", "WITH {contigs} SELECT ctg, coalesce(CAST(s_nationkey AS VARCHAR), 'ungrouped') AS grp FROM contigs LEFT JOIN supplier ON s_suppkey = ctg")
def _(s, d):
    g = table(s, d, "supplier").select(F.col("s_suppkey").alias("ctg"), F.col("s_nationkey").cast("string").alias("grp"))
    return joins.default_lookup(contigs(s, d).select("ctg"), g, "ctg", "grp", "ungrouped").select("ctg", "grp")


@query("singleton_completion", "WITH c AS (SELECT p_partkey AS ctg, CASE WHEN p_size > 10 THEN p_size % 5 END AS grp FROM part) SELECT ctg, grp FROM c WHERE grp IS NOT NULL UNION ALL SELECT ctg, CAST(4 + row_number() OVER (ORDER BY ctg) AS INTEGER) FROM c WHERE grp IS NULL")
def _(s, d):
    from linkloom.operators.windows import number_rows

    c = table(s, d, "part").select(F.col("p_partkey").alias("ctg"), F.when(F.col("p_size") > 10, F.col("p_size") % 5).alias("grp"))
    alone = number_rows(c.where("grp is null").select("ctg"), ["ctg"], "n").select("ctg", (F.col("n") + 4).cast("int").alias("grp"))
    return c.where("grp is not null").union(alone)


@query("haplotype_damping", "WITH {links}, h AS (SELECT p_partkey AS ctg, p_size % 2 AS hap FROM part) SELECT a, b, CASE WHEN x.hap <> y.hap THEN links * 0.5 ELSE CAST(links AS DOUBLE) END AS value FROM links JOIN h x ON a = x.ctg JOIN h y ON b = y.ctg")
def _(s, d):
    return L.damp_between(links(s, d), table(s, d, "part").select(F.col("p_partkey").alias("ctg"), (F.col("p_size") % 2).alias("hap")))


@query("exclusion_list", "SELECT l_orderkey AS read, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def _(s, d):
    drop = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("read"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("read")).join(drop, "read", "left_anti").groupBy("read").agg(F.count("*").alias("n"))


@query("whitelist_rescue", "WITH {contigs} SELECT ctg, len FROM contigs WHERE len > 150000 OR ctg IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(s, d):
    white = table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("ctg"), F.lit(True).alias("listed"))
    return contigs(s, d).join(white, "ctg", "left").where("len > 150000 or listed").select("ctg", "len")


@query("similarity_sweep", "WITH {links}, {alleles} SELECT cut, count(*) AS n FROM alleles, (SELECT unnest([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5]) AS cut) WHERE sim >= cut GROUP BY cut")
def _(s, d):
    cuts = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5]
    passed = F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("sim") >= c)
    return alleles(s, d).select(F.explode(passed).alias("cut")).groupBy("cut").agg(F.count("*").alias("n"))
