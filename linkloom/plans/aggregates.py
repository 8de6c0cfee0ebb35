"""Queries over aggregates, quantiles, windows, intervals and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import aggregates as A
from linkloom.operators import windows as W
from linkloom.operators.links import both_directions, degrees
from linkloom.plans.base import alleles, clusters, contigs, layout, links, pairs, query, spans, table

_PLACED = "placed AS (SELECT least(c1, c2) AS a, CASE WHEN c1 > c2 THEN pos2 ELSE pos1 END AS pa, greatest(c1, c2) AS b, CASE WHEN c1 > c2 THEN pos1 ELSE pos2 END AS pb, x.len AS la, y.len AS lb FROM pairs JOIN contigs x ON x.ctg = least(c1, c2) JOIN contigs y ON y.ctg = greatest(c1, c2) WHERE c1 <> c2)"
_BOTH = "both_ends AS (SELECT a AS ctg, b AS partner, links FROM links UNION ALL SELECT b, a, links FROM links)"


@query("nx_lengths", "WITH {contigs}, c AS (SELECT len, sum(len) OVER (ORDER BY len DESC) AS upto FROM contigs) SELECT share, max(len) AS length FROM c, (SELECT unnest([0.5, 0.8, 0.85, 0.9, 0.95]) AS share) WHERE upto >= CAST(share AS DOUBLE) * (SELECT sum(len) FROM contigs) GROUP BY share")
def _(s, d):
    return A.nx_lengths(contigs(s, d), [0.5, 0.8, 0.85, 0.9, 0.95])


@query("nx_filter", "WITH {contigs}, c AS (SELECT *, sum(len) OVER (ORDER BY len DESC, ctg) AS upto FROM contigs) SELECT ctg, len FROM c WHERE upto - len < 0.8::DOUBLE * (SELECT sum(len) FROM contigs)")
def _(s, d):
    return A.nx_keep(contigs(s, d), 0.8).select("ctg", "len")


@query("iqr_filter", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem) SELECT l_orderkey, l_extendedprice FROM lineitem, q WHERE l_extendedprice BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)")
def _(s, d):
    return A.within_fences(table(s, d, "lineitem").select("l_orderkey", "l_extendedprice"), "l_extendedprice", 0.5)


@query("quartiles", "SELECT round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS q2, round(quantile_cont(o_totalprice, 0.75), 6) AS q3 FROM orders")
def _(s, d):
    return A.fences(table(s, d, "orders"), "o_totalprice").select(*(F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")))


@query("fragment_filters", "WITH {contigs}, {links}, deg AS (SELECT ctg, sum(links) AS n FROM (SELECT a AS ctg, links FROM links UNION ALL SELECT b, links FROM links) GROUP BY ctg), x AS (SELECT contigs.ctg, re_sites, n / CAST(re_sites AS DOUBLE) AS density FROM contigs JOIN deg USING (ctg) WHERE re_sites >= 5) SELECT ctg, re_sites FROM x WHERE density BETWEEN 0.2::DOUBLE * (SELECT sum(density * re_sites) / sum(re_sites) FROM x) AND 1.9::DOUBLE * (SELECT sum(density * re_sites) / sum(re_sites) FROM x)")
def _(s, d):
    x = contigs(s, d).join(degrees(links(s, d)), "ctg").where("re_sites >= 5").withColumn("density", F.col("degree") / F.col("re_sites"))
    mean = x.agg((F.sum(F.col("density") * F.col("re_sites")) / F.sum("re_sites")).alias("mean"))
    return x.crossJoin(F.broadcast(mean)).where("density between cast(0.2 as double) * mean and cast(1.9 as double) * mean").select("ctg", "re_sites")


@query("rank_sum", "WITH {links}, " + _BOTH + ", r AS (SELECT ctg, partner, row_number() OVER (PARTITION BY ctg ORDER BY links DESC, partner) AS rank FROM both_ends), t AS (SELECT ctg, partner FROM r WHERE rank <= 5), z AS (SELECT x.ctg, x.partner AS p, y.partner AS q FROM t x JOIN t y ON x.ctg = y.ctg AND x.partner < y.partner) SELECT z.ctg, CAST(sum(least(coalesce(u.rank, 6), coalesce(v.rank, 6))) AS BIGINT) AS rank_sum FROM z LEFT JOIN r u ON u.ctg = p AND u.partner = q LEFT JOIN r v ON v.ctg = q AND v.partner = p GROUP BY z.ctg")
def _(s, d):
    return A.rank_sums(links(s, d), 5).withColumn("rank_sum", F.col("rank_sum").cast("long"))


@query("neighbour_ranks", "WITH {links}, " + _BOTH + " SELECT ctg, partner, CAST(row_number() OVER (PARTITION BY ctg ORDER BY links DESC, partner) AS INTEGER) AS rank FROM both_ends")
def _(s, d):
    return both_directions(links(s, d)).select("ctg", "partner", F.row_number().over(Window.partitionBy("ctg").orderBy(F.desc("links"), "partner")).alias("rank"))


@query("ht_links", "WITH {pairs}, {contigs}, " + _PLACED + " SELECT a, CASE WHEN 2 * pa > la THEN 'T' ELSE 'H' END AS a_half, b, CASE WHEN 2 * pb > lb THEN 'T' ELSE 'H' END AS b_half, count(*) AS n FROM placed GROUP BY ALL")
def _(s, d):
    return A.half_links(pairs(s, d), contigs(s, d))


@query("clm_lists", "WITH {pairs}, {contigs}, " + _PLACED + ", four AS (SELECT a, b, '++' AS orient, la - pa + pb AS d FROM placed UNION ALL SELECT a, b, '+-', la - pa + lb - pb FROM placed UNION ALL SELECT a, b, '-+', pa + pb FROM placed UNION ALL SELECT a, b, '--', pa + lb - pb FROM placed) SELECT a, b, orient, count(*) AS n, string_agg(CAST(d AS VARCHAR), ' ' ORDER BY d) AS dists FROM four GROUP BY ALL")
def _(s, d):
    x = A.orientation_distances(pairs(s, d), contigs(s, d))
    return x.withColumn("dists", F.array_join(F.transform("dists", lambda v: v.cast("string")), " "))


@query("flank_pairs", "WITH {pairs}, {contigs}, " + _PLACED + " SELECT a, b, count(*) AS n FROM placed WHERE (pa <= 200 OR pa > la - 200) AND (pb <= 30000 OR pb > lb - 30000) GROUP BY ALL")
def _(s, d):
    near = lambda p, n, f: (F.col(p) <= f) | (F.col(p) > F.col(n) - f)
    return A.placed(pairs(s, d), contigs(s, d)).where(near("pa", "la", 200) & near("pb", "lb", 30000)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("bin_links", "WITH {pairs}, x AS (SELECT c1 || ':' || CAST(floor(pos1 / 100) AS BIGINT) AS x, c2 || ':' || CAST(floor(pos2 / 100) AS BIGINT) AS y FROM pairs WHERE c1 <> c2) SELECT least(x, y) AS f1, greatest(x, y) AS f2, count(*) AS n FROM x GROUP BY ALL")
def _(s, d):
    return A.bin_links(pairs(s, d), 100)


@query("concordance", "WITH {pairs}, {contigs}, " + _PLACED + ", w AS (SELECT *, greatest(CAST(floor(least(la, lb) / 50) AS BIGINT), 1) AS w FROM placed), bands AS (SELECT a, b, '-' AS side, floor((pb - pa) / w) AS band FROM w UNION ALL SELECT a, b, '+', floor((pb + pa) / w) FROM w), c AS (SELECT a, b, side, band, count(*) AS c FROM bands GROUP BY ALL) SELECT a, b, CAST(sum(c) FILTER (WHERE side = '-') AS BIGINT) AS n, round(max(c) / sum(c) FILTER (WHERE side = '-'), 6) AS ratio FROM c GROUP BY ALL")
def _(s, d):
    return A.concordance(pairs(s, d), contigs(s, d)).withColumn("ratio", F.round("ratio", 6))


@query("concentration", "WITH {pairs}, p AS (SELECT least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN c1 > c2 THEN pos2 ELSE pos1 END AS pa, CASE WHEN c1 > c2 THEN pos1 ELSE pos2 END AS pb FROM pairs WHERE c1 <> c2), x AS (SELECT a, b, 'x' AS axis, floor(pa / 50) AS bin FROM p UNION ALL SELECT a, b, 'y', floor(pb / 50) FROM p), c AS (SELECT a, b, axis, bin, count(*) AS c FROM x GROUP BY ALL), m AS (SELECT *, median(c) OVER (PARTITION BY a, b, axis) AS mid FROM c), f AS (SELECT a, b, axis, 1 - sum(CASE WHEN c >= 1.5 * mid THEN c ELSE 0 END) / sum(c) AS free FROM m GROUP BY ALL) SELECT a, b, round(max(free) FILTER (WHERE axis = 'x') * max(free) FILTER (WHERE axis = 'y'), 6) AS value FROM f GROUP BY ALL")
def _(s, d):
    return A.concentration(pairs(s, d), 50, 1.5).withColumn("value", F.round("value", 6))


@query("bounded_points", "WITH {pairs}, k AS (SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY read, pos1, pos2) AS k FROM pairs WHERE c1 <> c2) SELECT c1, c2, count(*) AS n, CAST(sum(pos1) AS BIGINT) AS s FROM k WHERE k <= 2 GROUP BY ALL")
def _(s, d):
    return A.bounded_points(pairs(s, d), 2).groupBy("c1", "c2").agg(F.count("*").alias("n"), F.sum("pos1").alias("s"))


@query("group_statistics", "WITH {contigs}, {clusters} SELECT grp, CAST(sum(len) AS BIGINT) AS len, CAST(1 + sum(re_sites - 1) AS BIGINT) AS re_sites, count(*) AS n FROM contigs JOIN clusters USING (ctg) GROUP BY grp")
def _(s, d):
    x = contigs(s, d).join(clusters(s, d), "ctg")
    return x.groupBy("grp").agg(F.sum("len").alias("len"), (1 + F.sum(F.col("re_sites") - 1)).alias("re_sites"), F.count("*").alias("n"))


@query("cluster_survival", "WITH {contigs}, g AS (SELECT re_sites AS grp, sum(len) AS total, avg(len) AS mean FROM contigs GROUP BY re_sites) SELECT grp, CAST(total AS BIGINT) AS total FROM g WHERE total > (SELECT sum(total) FROM g) / 50 AND mean > (SELECT avg(mean) FROM g) / 7")
def _(s, d):
    g = contigs(s, d).groupBy(F.col("re_sites").alias("grp")).agg(F.sum("len").alias("total"), F.avg("len").alias("mean"))
    whole = g.agg(F.sum("total").alias("all_len"), F.avg("mean").alias("all_mean"))
    return g.crossJoin(F.broadcast(whole)).where("total > all_len / 50 and mean > all_mean / 7").select("grp", "total")


@query("allele_conflict", "WITH {links}, {alleles}, {contigs}, {clusters} SELECT x.grp, count(*) AS pairs, CAST(sum(least(m.len, n.len)) AS BIGINT) AS conflict FROM alleles JOIN clusters x ON a = x.ctg JOIN clusters y ON b = y.ctg AND x.grp = y.grp JOIN contigs m ON m.ctg = a JOIN contigs n ON n.ctg = b GROUP BY x.grp")
def _(s, d):
    from linkloom.operators.links import with_ends

    x = with_ends(alleles(s, d), contigs(s, d).join(clusters(s, d), "ctg"), "grp", "len").where("grp_a = grp_b")
    return x.groupBy(F.col("grp_a").alias("grp")).agg(F.count("*").alias("pairs"), F.sum(F.least("len_a", "len_b")).alias("conflict"))


@query("cluster_balance", "WITH {contigs}, {clusters}, g AS (SELECT grp, sum(len) AS len FROM contigs JOIN clusters USING (ctg) GROUP BY grp) SELECT round(var_samp(len), 2) AS variance, max(len) <= 2 * min(len) AS balanced FROM g")
def _(s, d):
    g = contigs(s, d).join(clusters(s, d), "ctg").groupBy("grp").agg(F.sum("len").alias("len"))
    return g.agg(F.round(F.var_samp("len"), 2).alias("variance"), (F.max("len") <= 2 * F.min("len")).alias("balanced"))


@query("uncollapsed_average", "WITH {contigs} SELECT round(sum(CASE WHEN 1 + re_sites % 4 < 2 THEN len ELSE 0 END) / 4, 6) AS average FROM contigs")
def _(s, d):
    return contigs(s, d).agg(F.round(F.sum(F.when(1 + F.col("re_sites") % 4 < 2, F.col("len")).otherwise(0)) / 4, 6).alias("average"))


@query("majority_vote", "WITH v AS (SELECT c_mktsegment AS grp, n_regionkey AS label, count(*) AS votes FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY votes DESC, label) AS k FROM v) SELECT grp, label, votes FROM r WHERE k = 1")
def _(s, d):
    x = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.majority(x.select(F.col("c_mktsegment").alias("grp"), F.col("n_regionkey").alias("label")), "grp", "label")


@query("value_curve", "WITH {contigs}, g AS (SELECT re_sites AS value, count(*) AS n, sum(len) AS w FROM contigs GROUP BY re_sites) SELECT value, n, round(sum(n) OVER (ORDER BY value) / (SELECT sum(n) FROM g), 6) AS share_n, round(1 - sum(w) OVER (ORDER BY value) / (SELECT sum(w) FROM g), 6) AS weight_left FROM g")
def _(s, d):
    x = A.value_curve(contigs(s, d), "re_sites", "len")
    return x.select("value", "n", F.round("share_n", 6).alias("share_n"), F.round("weight_left", 6).alias("weight_left"))


@query("link_density_ratio", "WITH {links}, {clusters}, {contigs}, " + _BOTH + ", re AS (SELECT grp, 1 + sum(re_sites - 1) AS re FROM contigs JOIN clusters USING (ctg) GROUP BY grp), g AS (SELECT e.ctg, c.grp, sum(links) / max(re.re) AS density FROM both_ends e JOIN clusters c ON c.ctg = e.partner JOIN re ON re.grp = c.grp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY density DESC, grp) AS k, sum(density) OVER (PARTITION BY ctg) AS total, count(*) OVER (PARTITION BY ctg) AS n FROM g) SELECT ctg, grp, round(density, 6) AS density, round(CASE WHEN n = 1 OR total - density <= 1e-12 THEN 1e6 ELSE density / ((total - density) / (n - 1)) END, 4) AS ratio FROM r WHERE k = 1")
def _(s, d):
    from linkloom.operators.links import group_links

    re = contigs(s, d).join(clusters(s, d), "ctg").groupBy("grp").agg((1 + F.sum(F.col("re_sites") - 1)).alias("re"))
    g = group_links(links(s, d), clusters(s, d)).join(re, "grp").withColumn("density", F.col("links") / F.col("re"))
    all_of = Window.partitionBy("ctg")
    r = g.withColumn("k", F.row_number().over(all_of.orderBy(F.desc("density"), "grp"))).withColumn("total", F.sum("density").over(all_of)).withColumn("n", F.count("*").over(all_of)).where("k = 1")
    rest = F.col("total") - F.col("density")
    ratio = F.when((F.col("n") == 1) | (rest <= 1e-12), F.lit(1e6)).otherwise(F.try_divide(F.col("density"), F.try_divide(rest, F.col("n") - 1)))
    return r.select("ctg", "grp", F.round("density", 6).alias("density"), F.round(ratio, 4).alias("ratio"))


@query("mean_other_groups", "WITH {links}, {clusters}, " + _BOTH + ", size AS (SELECT grp, count(*) AS n FROM clusters GROUP BY grp) SELECT e.ctg, c.grp, round(sum(links) / max(size.n), 6) AS mean FROM both_ends e JOIN clusters c ON c.ctg = e.partner JOIN size USING (grp) JOIN clusters own ON own.ctg = e.ctg WHERE own.grp <> c.grp GROUP BY ALL")
def _(s, d):
    from linkloom.operators.links import group_links

    c = clusters(s, d)
    size = c.groupBy("grp").agg(F.count("*").alias("n"))
    g = group_links(links(s, d), c).join(c.withColumnRenamed("grp", "own"), "ctg").where("own <> grp").join(size, "grp")
    return g.select("ctg", "grp", F.round(F.col("links") / F.col("n"), 6).alias("mean"))


@query("link_classes", "WITH {links}, {clusters} SELECT a AS ctg, count(*) FILTER (WHERE x.grp = y.grp AND x.ctg % 2 = y.ctg % 2) AS intra, count(*) FILTER (WHERE x.grp = y.grp AND x.ctg % 2 <> y.ctg % 2) AS homologous, count(*) FILTER (WHERE x.grp <> y.grp) AS other FROM links JOIN clusters x ON a = x.ctg JOIN clusters y ON b = y.ctg GROUP BY a")
def _(s, d):
    from linkloom.operators.links import with_ends

    x = with_ends(links(s, d), clusters(s, d), "grp")
    same, hap = F.col("grp_a") == F.col("grp_b"), F.col("a") % 2 == F.col("b") % 2
    return x.groupBy(F.col("a").alias("ctg")).agg(F.count_if(same & hap).alias("intra"), F.count_if(same & ~hap).alias("homologous"), F.count_if(~same).alias("other"))


@query("roc_points", "WITH t AS (SELECT l_discount / 0.1 AS score, l_returnflag = 'R' AS truth FROM lineitem), g AS (SELECT least(CAST(floor(score * 20) AS INTEGER), 20) AS cell, count(*) FILTER (WHERE truth) AS p, count(*) FILTER (WHERE NOT truth) AS n FROM t GROUP BY ALL), f AS (SELECT i AS cell, coalesce(p, 0) AS p, coalesce(n, 0) AS n FROM range(0, 21) r(i) LEFT JOIN g ON g.cell = i) SELECT cell / 20 AS cut, round(sum(p) OVER (ORDER BY cell DESC) / (SELECT sum(p) FROM f), 6) AS tpr, round(sum(n) OVER (ORDER BY cell DESC) / (SELECT sum(n) FROM f), 6) AS fpr FROM f")
def _(s, d):
    x = table(s, d, "lineitem").select((F.col("l_discount") / 0.1).alias("score"), (F.col("l_returnflag") == "R").alias("truth"))
    return A.roc(x, "score", "truth", 20).select("cut", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("correction_summary", "SELECT l_shipdate >= DATE '1998-01-01' AS late, l_returnflag AS kind, CASE WHEN l_quantity <= 5 THEN '[0,5]' WHEN l_quantity <= 20 THEN '(5,20]' ELSE '(20,)' END AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    q = F.col("l_quantity")
    return table(s, d, "lineitem").groupBy((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("late"), F.col("l_returnflag").alias("kind"), F.when(q <= 5, "[0,5]").when(q <= 20, "(5,20]").otherwise("(20,)").alias("bucket")).agg(F.count("*").alias("n"))


@query("bins_outside_truth", "WITH {pairs}, x AS (SELECT c1, CAST(floor(pos1 / 50) AS BIGINT) AS bin, count(*) AS n FROM pairs GROUP BY ALL), t AS (SELECT p_partkey AS c1, p_size % 4 AS lo, p_size % 4 + 5 AS hi FROM part) SELECT c1, CAST(sum(n) AS BIGINT) AS outside FROM x JOIN t USING (c1) WHERE bin < lo OR bin > hi GROUP BY c1")
def _(s, d):
    x = pairs(s, d).groupBy("c1", F.floor(F.col("pos1") / 50).alias("bin")).agg(F.count("*").alias("n"))
    t = table(s, d, "part").select(F.col("p_partkey").alias("c1"), (F.col("p_size") % 4).alias("lo"), (F.col("p_size") % 4 + 5).alias("hi"))
    return x.join(t, "c1").where("bin < lo or bin > hi").groupBy("c1").agg(F.sum("n").alias("outside"))


@query("multiset_difference", "WITH x AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL), y AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL) SELECT coalesce(x.k, y.k) AS k, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) AS more FROM x FULL JOIN y ON x.k = y.k")
def _(s, d):
    x = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    y = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("m"))
    return x.join(y, "k", "full_outer").select("k", F.greatest(F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0)), F.lit(0)).alias("more"))


@query("resource_usage", "SELECT user_id, round(max(value), 6) AS peak, count(*) AS jobs FROM events GROUP BY user_id")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.round(F.max("value"), 6).alias("peak"), F.count("*").alias("jobs"))


@query("remaining_copies", "WITH c AS (SELECT p_partkey AS ctg, 1 + p_size % 4 AS copies FROM part), h AS (SELECT l_partkey AS ctg, count(DISTINCT l_suppkey % 5) AS held FROM lineitem WHERE l_quantity >= 45 GROUP BY l_partkey) SELECT ctg, CAST(CASE WHEN held IS NULL AND copies = 1 THEN -1 ELSE copies - coalesce(held, 0) END AS BIGINT) AS remaining FROM c LEFT JOIN h USING (ctg)")
def _(s, d):
    c = table(s, d, "part").select(F.col("p_partkey").alias("ctg"), (1 + F.col("p_size") % 4).alias("copies"))
    h = table(s, d, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_partkey").alias("ctg")).agg(F.count_distinct(F.col("l_suppkey") % 5).alias("held"))
    return c.join(h, "ctg", "left").select("ctg", F.when(F.col("held").isNull() & (F.col("copies") == 1), -1).otherwise(F.col("copies") - F.coalesce("held", F.lit(0))).cast("long").alias("remaining"))


@query("concordance_correlation", "SELECT event_type, round(2 * covar_pop(value, user_id) / (var_pop(value) + var_pop(user_id) + power(avg(value) - avg(user_id), 2)), 6) AS ccc FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(A.correlation_of_concordance(F.col("value"), F.col("user_id").cast("double")), 6).alias("ccc"))


@query("coverage_bins", "WITH {spans}, m AS (SELECT ctg, s AS at_, 1 AS d FROM spans UNION ALL SELECT ctg, e + 1, -1 FROM spans), g AS (SELECT ctg, at_, sum(d) AS d FROM m GROUP BY ALL) SELECT ctg, at_ AS place, CAST(sum(d) OVER (PARTITION BY ctg ORDER BY at_) AS BIGINT) AS depth FROM g")
def _(s, d):
    return W.coverage(spans(s, d), ["ctg"], "s", "e").withColumnRenamed("at", "place")


@query("break_valleys", """WITH {spans}, bins AS (SELECT ctg, x, count(*) AS depth FROM (SELECT ctg, unnest(range(s, e + 1)) AS x FROM spans) GROUP BY ALL),
lim AS (SELECT ctg, min(s) AS lo, max(e) AS hi FROM spans GROUP BY ctg), every AS (SELECT ctg, unnest(range(lo, hi + 1)) AS x FROM lim), b AS (SELECT e.ctg, e.x, coalesce(depth, 0) AS depth FROM every e LEFT JOIN bins USING (ctg, x)),
mid AS (SELECT ctg, median(depth) AS mid FROM b GROUP BY ctg), h AS (SELECT b.ctg, x, x - row_number() OVER (PARTITION BY b.ctg ORDER BY x) AS g FROM b JOIN mid USING (ctg) WHERE depth >= 0.5 * mid),
isl AS (SELECT ctg, min(x) AS a, max(x) AS z FROM h GROUP BY ctg, g HAVING count(*) >= 3), btw AS (SELECT ctg, z + 1 AS lo, lead(a) OVER (PARTITION BY ctg ORDER BY a) - 1 AS hi FROM isl),
ins AS (SELECT b.ctg, lo, hi, x, depth, min(depth) OVER (PARTITION BY b.ctg, lo, hi) AS least FROM b JOIN btw ON b.ctg = btw.ctg AND x BETWEEN lo AND hi)
SELECT ctg, min(x) AS first, max(x) AS last, depth FROM ins WHERE depth = least GROUP BY ctg, lo, hi, depth""")
def _(s, d):
    return W.valleys(spans(s, d), "ctg", "s", "e", share=0.5, long=3)


@query("interval_union", "WITH {spans}, p AS (SELECT *, max(e) OVER (PARTITION BY ctg ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM spans WHERE e - s >= 5), g AS (SELECT *, sum(CASE WHEN prior IS NULL OR s > prior + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ctg ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM p) SELECT ctg, min(s) AS s, max(e) AS e FROM g GROUP BY ctg, g.g")
def _(s, d):
    return W.merge_intervals(spans(s, d).where("e - s >= 5"), ["ctg"], "s", "e")


@query("interval_gaps", "WITH {spans}, p AS (SELECT *, max(e) OVER (PARTITION BY ctg ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM spans WHERE e - s >= 5), g AS (SELECT *, sum(CASE WHEN prior IS NULL OR s > prior + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ctg ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM p), u AS (SELECT ctg, min(s) AS s, max(e) AS e FROM g GROUP BY ctg, g.g), n AS (SELECT ctg, e + 1 AS s, lead(s) OVER (PARTITION BY ctg ORDER BY s) - 1 AS e FROM u) SELECT ctg, s, e FROM n WHERE e IS NOT NULL")
def _(s, d):
    return W.gaps(spans(s, d).where("e - s >= 5"), ["ctg"], "s", "e")


@query("dup_instances", "WITH t AS (SELECT l_orderkey AS scaffold, l_linenumber AS part, l_suppkey % 5 AS item, l_partkey, l_extendedprice FROM lineitem), n AS (SELECT *, CASE WHEN lag(item) OVER w IS NULL OR lag(item) OVER w <> item THEN 1 ELSE 0 END AS fresh FROM t WINDOW w AS (PARTITION BY scaffold ORDER BY part, l_partkey, l_extendedprice)) SELECT scaffold, part, l_partkey, item, CAST(sum(fresh) OVER (PARTITION BY item ORDER BY scaffold, part, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS instance FROM n")
def _(s, d):
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("scaffold"), F.col("l_linenumber").alias("part"), "l_partkey", "l_extendedprice", (F.col("l_suppkey") % 5).alias("item"))
    return W.instances(t, "scaffold", "item", ["part", "l_partkey", "l_extendedprice"]).drop("l_extendedprice")


@query("ratio_break", "WITH g AS (SELECT o_custkey AS grp, o_totalprice AS v FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v DESC) AS k, lead(v) OVER (PARTITION BY grp ORDER BY v DESC) AS nxt FROM g) SELECT grp, coalesce(min(k) FILTER (WHERE nxt / v < 0.5), count(*)) AS main FROM r GROUP BY grp")
def _(s, d):
    x = table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("v"))
    return W.ratio_break(x, "grp", "v", 0.5).withColumn("main", F.col("main").cast("long"))


@query("adjacent_pairs", "WITH {layout} SELECT scaffold, ctg, lead(ctg) OVER (PARTITION BY scaffold ORDER BY part) AS following FROM layout")
def _(s, d):
    return layout(s, d).select("scaffold", "ctg", F.lead("ctg").over(Window.partitionBy("scaffold").orderBy("part")).alias("following"))


@query("secondary_ordinal", "SELECT l_orderkey AS read, l_partkey, l_linenumber, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ordinal FROM lineitem")
def _(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("read"), "l_partkey", "l_linenumber", F.sum((F.col("l_linestatus") == "O").cast("int")).over(w).alias("ordinal"))


@query("read_groups", "SELECT l_orderkey AS read, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("read")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


@query("longest_ten", "WITH r AS (SELECT o_custkey AS grp, o_orderkey AS ctg, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT grp, ctg, CAST(k AS INTEGER) AS k FROM r WHERE k <= 10")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("ctg"), F.row_number().over(w).alias("k")).where("k <= 10")


@query("orphan_target", "WITH {links}, {clusters}, " + _BOTH + ", g AS (SELECT e.ctg % 100 AS orphan, c.grp, sum(links) AS n FROM both_ends e JOIN clusters c ON c.ctg = e.partner GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY orphan ORDER BY n DESC, grp) AS k FROM g) SELECT orphan, grp, CAST(n AS BIGINT) AS n FROM r WHERE k = 1")
def _(s, d):
    from linkloom.operators.links import group_links

    g = group_links(links(s, d), clusters(s, d)).groupBy((F.col("ctg") % 100).alias("orphan"), "grp").agg(F.sum("links").alias("n"))
    return g.groupBy("orphan").agg(F.max_by("grp", F.struct("n", -F.col("grp"))).alias("grp"), F.max("n").alias("n"))


@query("fragment_order", "SELECT p_partkey AS ctg, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS ord FROM part")
def _(s, d):
    x = table(s, d, "part").select(F.col("p_partkey").alias("ctg"), "p_retailprice")
    return W.number_rows(x, [F.desc("p_retailprice"), F.col("ctg")], "ord").select("ctg", "ord")


@query("contact_matrix", "WITH {pairs} SELECT CAST(floor(pos1 / 50) AS BIGINT) AS bin1, CAST(floor(pos2 / 10000) AS BIGINT) AS bin2, count(*) AS n FROM pairs GROUP BY ALL")
def _(s, d):
    return pairs(s, d).groupBy(F.floor(F.col("pos1") / 50).alias("bin1"), F.floor(F.col("pos2") / 10000).alias("bin2")).agg(F.count("*").alias("n"))


@query("contact_log10", "WITH {pairs} SELECT CAST(floor(pos1 / 50) AS BIGINT) AS bin1, CAST(floor(pos2 / 10000) AS BIGINT) AS bin2, round(log10(1 + count(*)), 6) AS value FROM pairs GROUP BY ALL")
def _(s, d):
    return pairs(s, d).groupBy(F.floor(F.col("pos1") / 50).alias("bin1"), F.floor(F.col("pos2") / 10000).alias("bin2")).agg(F.round(F.log10(1 + F.count("*")), 6).alias("value"))


@query("contact_vmax", "WITH {links}, {clusters}, g AS (SELECT least(x.grp, y.grp) AS i, greatest(x.grp, y.grp) AS j, sum(links) AS n FROM links JOIN clusters x ON a = x.ctg JOIN clusters y ON b = y.ctg WHERE x.grp <> y.grp GROUP BY ALL), f AS (SELECT i, j, coalesce(n, 0) AS n FROM (SELECT x.i, y.j FROM range(0, 10) x(i), range(0, 10) y(j) WHERE x.i < y.j) LEFT JOIN g USING (i, j)) SELECT round(median(n) * 1.9, 6) AS vmax FROM f")
def _(s, d):
    from linkloom.operators.links import contract

    n = 10 * 9 // 2  # off-diagonal cells above the diagonal; those without links are zeros
    g = contract(links(s, d), clusters(s, d)).agg(F.sort_array(F.collect_list("links")).alias("v"))  # a cell per pair of groups
    full = F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(n) - F.size("v")), F.col("v"))
    mid = g.select(full.alias("v")).select(((F.col("v")[(n - 1) // 2] + F.col("v")[n // 2]) / 2).alias("mid"))
    return mid.select(F.round(F.col("mid") * 1.9, 6).alias("vmax"))


@query("relative_histogram", "SELECT l_returnflag, CAST(least(floor(l_quantity * 100 / 50), 99) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", F.least(F.floor(F.col("l_quantity") * 100 / 50), F.lit(99)).alias("bin")).agg(F.count("*").alias("n"))


@query("grouping_errors", "WITH t AS (SELECT c_mktsegment AS grp, n_regionkey AS chrom, floor(c_acctbal) AS len FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0), g AS (SELECT grp, chrom, sum(len) AS len FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY len DESC, chrom) AS k, sum(len) OVER (PARTITION BY grp) AS total FROM g) SELECT grp, chrom, CAST(len AS BIGINT) AS len, round(1 - len / total, 6) AS error FROM r WHERE k = 1")
def _(s, d):
    t = table(s, d, "customer").where("c_acctbal > 0").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = t.groupBy(F.col("c_mktsegment").alias("grp"), F.col("n_regionkey").alias("chrom")).agg(F.sum(F.floor("c_acctbal")).alias("len"))
    r = g.groupBy("grp").agg(F.max_by(F.struct("chrom", "len"), F.struct("len", -F.col("chrom"))).alias("m"), F.sum("len").alias("total"))
    return r.select("grp", "m.chrom", "m.len", F.round(1 - F.col("m.len") / F.col("total"), 6).alias("error"))
