"""Queries over sequences and scaffold layouts. Whole document texts stand for sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.functions import sequence as S
from linkloom.operators import layout as Y
from linkloom.plans.base import contigs, layout, pairs, query, table

_COUNT = "(length(lower({0})) - length(replace(lower({0}), '{1}', ''))) / {2}"


def _n(text: str, motif: str) -> str:
    return _COUNT.format(text, motif, len(motif))


@query("motif_count", f"SELECT doc_id, CAST({_n('text', 'th')} + 1 AS BIGINT) AS sites FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", S.motif_count(F.col("text"), "th").alias("sites"))


@query("motif_expanded", "SELECT doc_id, CAST(1 + " + " + ".join(_n("text", f"t{x}e") for x in "atcg") + " AS BIGINT) AS sites FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", S.motifs_count(F.col("text"), "TNE").alias("sites"))


@query("motif_flanks", f"SELECT doc_id, CAST(CASE WHEN length(text) <= 1000 THEN {_n('text', 'th')} + 1 ELSE {_n('left(text, 500)', 'th')} + {_n('right(text, 500)', 'th')} + 1 END AS BIGINT) AS sites FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", S.flank_motif_count(F.col("text"), "th", 500).alias("sites"))


@query("gc_windows", "WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) + 1, 1000)) AS s FROM documents), x AS (SELECT doc_id, s, substr(text, s, 1000) AS w FROM w) SELECT doc_id, s, s + length(w) - 1 AS e, CAST(floor(100.0::DOUBLE * (length(w) - length(translate(w, 'GCgc', ''))) / length(w)) AS BIGINT) AS gc FROM x")
def _(s, d):
    x = table(s, d, "documents").select("doc_id", "text", F.inline(S.windows(F.length("text"), 1000)))
    return x.select("doc_id", "s", "e", S.gc_percent(F.substring("text", F.col("s").cast("int"), F.lit(1000))).alias("gc"))


@query("fixed_windows", "WITH {contigs} SELECT ctg, s, least(s + 9999, len) AS e FROM (SELECT ctg, len, unnest(range(1, len + 1, 10000)) AS s FROM contigs)")
def _(s, d):
    return contigs(s, d).select("ctg", F.inline(S.windows(F.col("len"), 10_000)))


@query("revcomp", "SELECT doc_id, md5(array_to_string(list_reverse(string_split(translate(text, 'ATCGNatcgn', 'TAGCNtagcn'), '')), '')) AS seq_md5 FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(S.reverse_complement(F.col("text"))).alias("seq_md5"))


@query("subrange", "SELECT doc_id, substr(text, 5, 16) AS piece FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.substring("text", 5, 20 - 5 + 1).alias("piece"))


@query("nrun_hist", "SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'n+')) AS run FROM documents) GROUP BY run")
def _(s, d):
    return table(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(n+)"), 1)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


@query("kmer_canon", "WITH k AS (SELECT unnest(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))) AS k FROM documents), a AS (SELECT k FROM k WHERE regexp_full_match(k, '[acgt]+')) SELECT least(k, reverse(translate(k, 'ATCGNatcgn', 'TAGCNtagcn'))) AS kmer, count(*) AS n FROM a GROUP BY ALL")
def _(s, d):
    k = table(s, d, "documents").select(F.explode(S.kmers(F.col("text"), 4)).alias("k")).where(F.col("k").rlike(r"^[acgt]+\z"))  # a $ would let a line break stand last
    return k.groupBy(S.canonical(F.col("k")).alias("kmer")).agg(F.count("*").alias("n"))


@query("repeat_stats", f"SELECT doc_id, CAST({_n('text', 'thth')} AS BIGINT) AS doubled, CAST(strpos(text, 'th') AS BIGINT) AS first, CAST(CASE WHEN strpos(text, 'th') = 0 THEN 0 ELSE length(text) - strpos(array_to_string(list_reverse(string_split(text, '')), ''), 'ht') END AS BIGINT) AS last FROM documents")
def _(s, d):
    t = F.col("text")
    last = F.when(F.instr(t, "th") == 0, 0).otherwise(F.length(t) - F.instr(F.reverse(t), "ht"))
    return table(s, d, "documents").select("doc_id", (S.motif_count(t, "thth") - 1).alias("doubled"), F.instr(t, "th").cast("long").alias("first"), last.cast("long").alias("last"))


@query("kmer_classes", "WITH k AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5))) AS k FROM documents), own AS (SELECT k, min(lang) AS lo, max(lang) AS hi FROM k GROUP BY k) SELECT doc_id, count(*) FILTER (WHERE lo = hi) AS only_here, count(*) FILTER (WHERE lo <> hi) AS shared FROM k JOIN own USING (k) GROUP BY doc_id")
def _(s, d):
    from linkloom.operators.kmers import kmer_shares

    return kmer_shares(table(s, d, "documents"), "doc_id", "lang", "text", 5)


@query("name_parts", "SELECT c_custkey, split_part(c_name, '#', 1) AS stem, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("stem"), F.split_part("c_name", F.lit("#"), F.lit(2)).cast("long").alias("number"))


@query("allele_types", "WITH x AS (SELECT substr('ACGT', 1 + l_linenumber % 4, 1) AS a, CASE WHEN l_returnflag = 'R' THEN 'AC' ELSE substr('ACGT', CAST(1 + l_suppkey % 4 AS INTEGER), 1) END AS b FROM lineitem) SELECT CASE WHEN a = b THEN 'Identical' WHEN length(a) <> length(b) THEN 'InDel' WHEN least(a, b) || greatest(a, b) IN ('AG', 'CT') THEN 'SNP_transition' ELSE 'SNP_transversion' END AS kind, count(*) AS n FROM x GROUP BY ALL")
def _(s, d):
    base = lambda c: F.substring(F.lit("ACGT"), (1 + F.col(c) % 4).cast("int"), F.lit(1))
    x = table(s, d, "lineitem").select(base("l_linenumber").alias("a"), F.when(F.col("l_returnflag") == "R", "AC").otherwise(base("l_suppkey")).alias("b"))
    return x.groupBy(S.allele_type(F.col("a"), F.col("b")).alias("kind")).agg(F.count("*").alias("n"))


@query("clock_seconds", "SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS seconds FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", S.clock_seconds(F.date_format("ts", "HH:mm:ss")).alias("seconds"))


@query("renamed_ids", "SELECT o_custkey AS scaffold, string_agg(CAST(o_orderkey AS VARCHAR), '_' ORDER BY o_totalprice, o_orderkey) AS name FROM orders GROUP BY o_custkey")
def _(s, d):
    g = table(s, d, "orders").groupBy(F.col("o_custkey").alias("scaffold")).agg(F.sort_array(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("x"))
    return g.select("scaffold", F.array_join(F.transform("x", lambda v: v["o_orderkey"].cast("string")), "_").alias("name"))


@query("agp_layout", "WITH {layout}, {agp}, n AS (SELECT *, max(part) OVER (PARTITION BY scaffold) AS n FROM agp) SELECT scaffold, beg, fin, CAST(2 * part - 1 AS BIGINT) AS part, 'W' AS kind, CAST(ctg AS VARCHAR) AS component, orient FROM n UNION ALL SELECT scaffold, fin + 1, fin + 100, CAST(2 * part AS BIGINT), 'U', '100', 'yes' FROM n WHERE part < n")
def _(s, d):
    return Y.agp_rows(layout(s, d))


@query("agp_lift", "WITH {layout}, {agp}, p AS (SELECT l_orderkey AS ctg, l_linenumber AS k, l_partkey, CAST(floor(l_quantity * 10) AS BIGINT) AS pos FROM lineitem) SELECT ctg, k, l_partkey, pos, scaffold, CASE WHEN orient = '+' THEN beg + pos - 1 ELSE beg + len - pos END AS spos FROM p JOIN agp USING (ctg)")
def _(s, d):
    p = table(s, d, "lineitem").select(F.col("l_orderkey").alias("ctg"), F.col("l_linenumber").alias("k"), "l_partkey", F.floor(F.col("l_quantity") * 10).alias("pos"))
    return Y.lift(p, layout(s, d))


@query("agp_lift_plain", "WITH {layout}, {agp}, p AS (SELECT l_orderkey AS ctg, l_linenumber AS k, l_partkey, CAST(floor(l_quantity * 10) AS BIGINT) AS pos FROM lineitem) SELECT ctg, k, l_partkey, pos, scaffold, beg + pos AS spos FROM p JOIN agp USING (ctg)")
def _(s, d):
    p = table(s, d, "lineitem").select(F.col("l_orderkey").alias("ctg"), F.col("l_linenumber").alias("k"), "l_partkey", F.floor(F.col("l_quantity") * 10).alias("pos"))
    return Y.lift(p, layout(s, d), oriented=False)


@query("agp_flip", "WITH {layout}, {agp}, n AS (SELECT *, max(fin) OVER (PARTITION BY scaffold) AS size, max(part) OVER (PARTITION BY scaffold) AS n FROM agp) SELECT scaffold, ctg, len, CASE WHEN orient = '+' THEN '-' ELSE '+' END AS orient, CAST(n - part + 1 AS BIGINT) AS part, size - fin + 1 AS beg, size - beg + 1 AS fin FROM n")
def _(s, d):
    return Y.flip(Y.coordinates(layout(s, d))).withColumn("part", F.col("part").cast("long"))


@query("agp_gap_free", "WITH {layout}, {agp} SELECT scaffold, ctg, beg - 100 * (part - 1) AS beg, fin - 100 * (part - 1) AS fin FROM agp")
def _(s, d):
    return Y.without_gaps(Y.coordinates(layout(s, d))).select("scaffold", "ctg", "beg", "fin")


@query("scaffold_merge", "WITH {layout} SELECT scaffold, CAST(sum(len + 100) - 100 AS BIGINT) AS size, count(*) AS parts, string_agg(CAST(ctg AS VARCHAR) || orient, ' ' ORDER BY part) AS tour FROM layout GROUP BY scaffold")
def _(s, d):
    g = layout(s, d).groupBy("scaffold").agg((F.sum(F.col("len") + 100) - 100).alias("size"), F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("part", F.concat(F.col("ctg").cast("string"), "orient").alias("t")))).alias("p"))
    return g.select("scaffold", "size", "parts", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("tour"))


@query("scaffold_seq", "WITH {layout}, x AS (SELECT scaffold, part, CASE WHEN orient = '-' THEN reverse(translate(s, 'ATCGNatcgn', 'TAGCNtagcn')) ELSE s END AS piece FROM layout JOIN (SELECT o_orderkey AS ctg, o_orderpriority || o_orderkey AS s FROM orders) USING (ctg)) SELECT scaffold, md5(string_agg(piece, repeat('N', 100) ORDER BY part)) AS seq_md5 FROM x GROUP BY scaffold")
def _(s, d):
    seq = table(s, d, "orders").select(F.col("o_orderkey").alias("ctg"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("seq"))
    return Y.sequences(layout(s, d).join(seq, "ctg"), "seq").select("scaffold", F.md5("seq").alias("seq_md5"))


@query("scaffold_seq_trimmed", "WITH {layout}, x AS (SELECT *, lag(ctg) OVER (PARTITION BY scaffold ORDER BY part) AS before_ FROM layout), y AS (SELECT scaffold, part, CASE WHEN before_ IS NULL THEN s WHEN before_ % 3 = 0 THEN substr(s, 3) ELSE 'NNN' || s END AS piece FROM x JOIN (SELECT o_orderkey AS ctg, o_orderpriority || o_orderkey AS s FROM orders) USING (ctg)) SELECT scaffold, md5(string_agg(piece, '' ORDER BY part)) AS seq_md5 FROM y GROUP BY scaffold")
def _(s, d):
    lay = layout(s, d)
    seq = table(s, d, "orders").select(F.col("o_orderkey").alias("ctg"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("seq"))
    over = lay.select("ctg", F.lead("ctg").over(Window.partitionBy("scaffold").orderBy("part")).alias("following")).where("following is not null and ctg % 3 = 0").withColumn("overlap", F.lit(2))
    return Y.trimmed_sequences(lay.join(seq, "ctg"), "seq", over).select("scaffold", F.md5("seq").alias("seq_md5"))


@query("unit_to_contig", "WITH {layout}, t AS (SELECT *, ctg % 2 AS g FROM layout), n AS (SELECT *, CASE WHEN lag(g) OVER w IS NULL OR lag(g) OVER w <> g THEN 1 ELSE 0 END AS fresh FROM t WINDOW w AS (PARTITION BY scaffold ORDER BY part)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY scaffold ORDER BY part) AS run FROM n) SELECT scaffold, CAST(run AS INTEGER) AS part, g, CAST(sum(len) AS BIGINT) AS len, count(*) AS n FROM r GROUP BY ALL")
def _(s, d):
    return Y.collapse_runs(layout(s, d).withColumn("g", F.col("ctg") % 2), "g")


@query("pairs_to_scaffolds", "WITH {layout}, {agp}, p AS (SELECT l_partkey AS k, l_orderkey AS c1, 1 + l_linenumber AS p1, l_suppkey AS c2, 5 + l_linenumber AS p2, l_extendedprice AS x FROM lineitem) SELECT k, x, a.scaffold AS s1, CASE WHEN a.orient = '+' THEN a.beg + p1 - 1 ELSE a.beg + a.len - p1 END AS q1, b.scaffold AS s2, CASE WHEN b.orient = '+' THEN b.beg + p2 - 1 ELSE b.beg + b.len - p2 END AS q2 FROM p JOIN agp a ON a.ctg = c1 JOIN agp b ON b.ctg = c2")
def _(s, d):
    p = table(s, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("x"), F.col("l_orderkey").alias("ctg"), (1 + F.col("l_linenumber")).alias("pos"), F.col("l_suppkey").alias("c2"), (5 + F.col("l_linenumber")).alias("p2"))
    lay = layout(s, d)
    one = Y.lift(p, lay).select("k", "x", F.col("scaffold").alias("s1"), F.col("spos").alias("q1"), F.col("c2").alias("ctg"), F.col("p2").alias("pos"))
    return Y.lift(one, lay).select("k", "x", "s1", "q1", F.col("scaffold").alias("s2"), F.col("spos").alias("q2"))


@query("scaffold_sites", "WITH {layout}, {agp} SELECT scaffold, CAST(floor(sum((fin - beg + 1) / (2.0::DOUBLE * len) * (1 + o_orderkey % 9))) AS BIGINT) AS re_sites FROM agp JOIN orders ON o_orderkey = ctg GROUP BY scaffold")
def _(s, d):
    sites = layout(s, d).select("ctg", (1 + F.col("ctg") % 9).alias("re_sites"), (2 * F.col("len")).alias("len"))
    return Y.site_estimate(Y.coordinates(layout(s, d)), sites)


@query("single_scaffolds", "SELECT o_custkey AS grp, min(o_orderkey) || '+' AS tour FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def _(s, d):
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("ctg")).where("n = 1").select("grp", F.concat(F.col("ctg").cast("string"), F.lit("+")).alias("tour"))


@query("collinear_runs", "WITH t AS (SELECT l_orderkey AS scaffold, l_linenumber AS k, l_partkey, l_suppkey, l_quantity AS pos FROM lineitem), n AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR pos < lag(pos) OVER w THEN 1 ELSE 0 END AS fresh FROM t WINDOW w AS (PARTITION BY scaffold ORDER BY k, l_partkey, l_suppkey, pos)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY scaffold ORDER BY k, l_partkey, l_suppkey, pos ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT scaffold, CAST(run AS BIGINT) AS run, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM r GROUP BY ALL")
def _(s, d):
    w = Window.partitionBy("scaffold").orderBy("k", "l_partkey", "l_suppkey", "pos")
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("scaffold"), F.col("l_linenumber").alias("k"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("pos"))
    n = t.withColumn("fresh", (F.lag("pos").over(w).isNull() | (F.col("pos") < F.lag("pos").over(w))).cast("int"))
    r = n.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("scaffold", "run").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
