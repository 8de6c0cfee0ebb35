"""Text formats of the domain, each with an explicit schema; gzip files are read as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.windows import number_rows


def table(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False, comment: str | None = "#") -> DataFrame:
    """A delimited file. Lines that start with `comment` are left out; values that don't fit their type are null."""
    r = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("quote", "")
    return (r.option("comment", comment) if comment else r).csv(path)


def fasta(spark: SparkSession, path: str, keep_case: bool = False) -> DataFrame:
    """(ctg, seq): the first word of a header names the record, its lines are joined; a record is one row."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    rec = raw.select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    head = F.substring_index("r", "\n", 1)
    body = F.regexp_replace(F.substr("r", F.length(head) + 1), r"\s", "")
    return rec.select(F.regexp_extract(head, r"^(\S+)", 1).alias("ctg"), (body if keep_case else F.upper(body)).alias("seq"))


def fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    return fasta(spark, path, True).select("ctg", F.length("seq").cast("long").alias("len"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines in file order, from 1."""
    return number_rows(spark.read.text(path).withColumn("_o", F.monotonically_increasing_id()), [F.col("_o")], "line").drop("_o")


def fai(spark: SparkSession, path: str) -> DataFrame:
    """(ord, ctg, len): the line number counts."""
    p = F.split("value", "\t")
    return numbered_lines(spark, path).select(F.col("line").alias("ord"), p[0].alias("ctg"), p[1].cast("long").alias("len"))


def gfa_segments(spark: SparkSession, path: str) -> DataFrame:
    """(ctg, len, depth) of S lines; LN gives the length where the sequence is left out, rd the depth."""
    p = F.split("value", "\t")
    tag = lambda t, kind: F.regexp_extract("value", rf"\t{t}:{kind}:([\d.]+)", 1)
    ln, rd = tag("LN", "i"), tag("rd", "[if]")
    return spark.read.text(path).where(F.col("value").startswith("S\t")).select(p[1].alias("ctg"), F.when(ln != "", ln.cast("long")).otherwise(F.length(p[2])).alias("len"), F.when(rd != "", rd.cast("double").cast("int") + 1).alias("depth"))


def gfa_links(spark: SparkSession, path: str) -> DataFrame:
    """(src, src_strand, dst, dst_strand, overlap) of L lines."""
    p = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value").startswith("L\t")).select(p[1].alias("src"), p[2].alias("src_strand"), p[3].alias("dst"), p[4].alias("dst_strand"), F.regexp_extract(p[5], r"^(\d+)M", 1).cast("int").alias("overlap"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "read string, c1 string, pos1 long, c2 string, pos2 long, mapq string").withColumn("mapq", F.col("mapq").try_cast("int"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of a SAM text with the usual flag bits as columns."""
    t = table(spark, path, "read string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags string", comment="@")
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    return t.withColumns({"unmapped": bit(4), "reverse": bit(16), "mate_reverse": bit(32), "read1": bit(64), "secondary": bit(256), "supplementary": bit(2048), "proper": bit(2), "duplicate": bit(1024)})


def sam_pairs(alignments: DataFrame, min_mapq: int) -> DataFrame:
    """Pairs on different contigs from alignment lines; both mates yield a row."""
    return alignments.where((F.col("mapq") >= min_mapq) & (F.col("rnext") != "=")).select("read", F.col("rname").alias("c1"), F.col("pos").alias("pos1"), F.col("rnext").alias("c2"), F.col("pnext").alias("pos2"), "mapq")


def proper_first(alignments: DataFrame) -> DataFrame:
    """First mates of proper pairs on opposite strands, primary and mapped."""
    return alignments.where("read1 and proper and not (unmapped or secondary or supplementary) and reverse <> mate_reverse")


def re_counts(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "ctg string, re_sites int, len long")


def links(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, links) under the unordered key; of repeated keys the last line counts."""
    p = F.split("value", ",")
    x = numbered_lines(spark, path).where(~F.col("value").startswith("source")).select("line", F.least(p[0], p[1]).alias("a"), F.greatest(p[0], p[1]).alias("b"), p[2].cast("double").alias("links"))
    return x.groupBy("a", "b").agg(F.max_by("links", "line").alias("links"))


def similarity(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """(a, b, sim) under the unordered key; on request only names that start with `prefix`."""
    t = table(spark, path, "source string, target string, sim double", sep=",").where("source <> 'source'")
    if prefix:
        t = t.where(F.col("source").startswith(prefix) & F.col("target").startswith(prefix))
    return t.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "sim")


def sketch_similarity(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(a, b, sim) of S lines whose ids are line numbers of the index (ord, ctg) behind one character."""
    p = F.split("value", "\t")
    s = spark.read.text(path).where(F.col("value").startswith("S\t")).select(F.substr(p[1], F.lit(2)).cast("long").alias("o1"), F.substr(p[2], F.lit(2)).cast("long").alias("o2"), p[6].cast("double").alias("sim"))
    name = lambda k, n: index.select(F.col("ord").alias(k), F.col("ctg").alias(n))
    x = s.join(name("o1", "x"), "o1").join(name("o2", "y"), "o2")
    return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")


def copies(spark: SparkSession, path: str) -> DataFrame:
    """(ctg, copies): a value that is no whole number counts as 1."""
    return table(spark, path, "ctg string, n string").select("ctg", F.coalesce(F.col("n").try_cast("int"), F.lit(1)).alias("copies"))


def members(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """(grp, ctg) of lines `grp<tab>n<tab>members`."""
    p = F.split("value", "\t")
    # Parted before the list is laid out: else each member would carry its whole line.
    parts = spark.read.text(path).where(~F.col("value").startswith("#")).select(p[0].alias("grp"), F.split(F.trim(p[2]), sep).alias("members"))
    return parts.select("grp", F.explode("members").alias("ctg")).where("ctg <> ''")


def agp(spark: SparkSession, path: str) -> DataFrame:
    """Component and gap rows: scaffold, beg, fin, part, kind, component, cbeg, cend, orient (of gaps: component is the length)."""
    t = table(spark, path, "scaffold string, beg long, fin long, part int, kind string, component string, cbeg string, cend string, orient string")
    return t.withColumns({"cbeg": F.col("cbeg").try_cast("long"), "cend": F.col("cend").try_cast("long")})


def clm(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, orient, n, dists) of lines `a+ b-<tab>n<tab>distances`."""
    p, ends = F.split("value", "\t"), F.split(F.split("value", "\t")[0], " ")
    cut = lambda e: F.regexp_replace(e, "[+-]$", "")
    return spark.read.text(path).select(cut(ends[0]).alias("a"), cut(ends[1]).alias("b"), F.concat(F.right(ends[0], F.lit(1)), F.right(ends[1], F.lit(1))).alias("orient"), p[1].cast("long").alias("n"), F.transform(F.split(p[2], " "), lambda x: x.cast("long")).alias("dists"))


def tours(spark: SparkSession, path: str) -> DataFrame:
    """(grp, ord, ctg, orient) of tour files: the last line that isn't empty counts; the file name names the group."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("grp"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    tour = raw.select("grp", F.posexplode(F.split(F.trim(F.element_at("lines", -1)), r"\s+")).alias("k", "t"))
    return tour.select("grp", (F.col("k") + 1).alias("ord"), F.expr("left(t, length(t) - 1)").alias("ctg"), F.right("t", F.lit(1)).alias("orient"))


def repeated_in_tours(tour: DataFrame) -> DataFrame:
    """Contigs that stand in tours more than once: an error to raise on."""
    return tour.groupBy("ctg").agg(F.count("*").alias("n")).where("n > 1")


def assembly(spark: SparkSession, path: str) -> DataFrame:
    """(scaffold, ord, ctg, orient): `>name index length` lines, then signed index lists, one scaffold a line."""
    lines = numbered_lines(spark, path)
    p = F.split(F.substr("value", F.lit(2)), " ")
    names = lines.where(F.col("value").startswith(">")).select(p[1].cast("int").alias("idx"), p[0].alias("ctg"))
    order = lines.where(~F.col("value").startswith(">") & (F.trim("value") != ""))
    first = order.agg(F.min("line").alias("first"))
    x = order.crossJoin(F.broadcast(first)).select((F.col("line") - F.col("first") + 1).alias("scaffold"), F.posexplode(F.split(F.trim("value"), " ")).alias("k", "v"))
    return x.select("scaffold", (F.col("k") + 1).alias("ord"), F.abs(F.col("v").cast("int")).alias("idx"), F.when(F.col("v").startswith("-"), "-").otherwise("+").alias("orient")).join(names, "idx").select("scaffold", "ord", "ctg", "orient")


def paf(spark: SparkSession, path: str, min_mapq: int = 1, min_span: int = 5000) -> DataFrame:
    t = table(spark, path, "query string, qlen long, qstart long, qend long, strand string, ref string, rlen long, rstart long, rend long, matches long, block long, mapq int", comment=None)
    return t.where((F.col("mapq") >= min_mapq) & (F.col("qend") - F.col("qstart") >= min_span))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, sp, ep, value): starts become 1-based."""
    return table(spark, path, "chrom string, sp long, ep long, value double").withColumn("sp", F.col("sp") + 1)


def fastq(spark: SparkSession, path: str, min_len: int = 0) -> DataFrame:
    """(read, seq, qual): four lines a record."""
    x = numbered_lines(spark, path).withColumn("rec", F.floor((F.col("line") - 1) / 4)).withColumn("k", (F.col("line") - 1) % 4)
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    g = x.groupBy("rec").agg(part(0).alias("h"), part(1).alias("seq"), part(3).alias("qual"))
    return g.where(F.length("seq") >= min_len).select(F.regexp_extract("h", r"^@(\S+)", 1).alias("read"), "seq", "qual")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the first column of each line, once."""
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", r"\s+")[0].alias("id")).where("id <> ''").distinct()


def group_files(spark: SparkSession, path: str) -> DataFrame:
    """(grp, ctg) of many group files; the file name names the group."""
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("grp"), "value").where(~F.col("value").startswith("#")).select("grp", F.split("value", r"\s+")[0].alias("ctg"))


def log_metric(spark: SparkSession, path: str, pattern: str, kind: str = "double") -> DataFrame:
    """(value): the first group of a pattern, wherever a log line matches it."""
    found: Column = F.regexp_extract("value", pattern, 1)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(found.cast(kind).alias("value"))


def mnd(spark: SparkSession, path: str) -> DataFrame:
    """(strand1, c1, pos1, frag1, strand2, c2, pos2, frag2) of a merged-no-duplicates list; further fields are left out."""
    p = F.split(F.trim("value"), r"\s+")
    kinds = ("strand1 int", "c1 string", "pos1 long", "frag1 long", "strand2 int", "c2 string", "pos2 long", "frag2 long")
    return spark.read.text(path).where(F.trim("value") != "").select(*(F.get(p, F.lit(k)).try_cast(x.split()[1]).alias(x.split()[0]) for k, x in enumerate(kinds)))


def within_source(rows: DataFrame) -> DataFrame:
    """Rows whose two contigs come from one source (the name before the first `_`), with it."""
    of = lambda c: F.split_part(c, F.lit("_"), F.lit(1))
    return rows.where(of("c1") == of("c2")).withColumn("source", of("c1"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, ord, ctg, orient): `>chromosome` lines, each with the lines `contig orientation` that follow it."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.split(F.regexp_replace("value", "^>", ""), "\n").alias("x"))
    rows = rec.select(F.regexp_extract(F.col("x")[0], r"^(\S+)", 1).alias("chrom"), F.posexplode(F.filter(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda v: F.trim(v) != "")).alias("k", "v"))
    p = F.split(F.trim("v"), r"\s+")
    return rows.select("chrom", (F.col("k") + 1).alias("ord"), p[0].alias("ctg"), F.get(p, F.lit(1)).alias("orient"))


def allele_info(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, bases, ploidy) of lines `name chromosome place reference-base base...`; the first line of the file is a header."""
    p = F.split(F.trim("value"), r"\s+")
    lines = numbered_lines(spark, path).where((F.col("line") > 1) & (F.trim("value") != ""))
    bases = F.slice(p, 4, F.greatest(F.size(p) - 3, F.lit(0)))
    return lines.select(p[1].alias("chrom"), p[2].cast("long").alias("pos"), bases.alias("bases"), (F.size(bases) - 1).alias("ploidy"))


def lachesis_order(spark: SparkSession, path: str) -> DataFrame:
    """(grp, ord, ctg, orient) of ordering files, named after their group: local id, contig, 0 for forwards or 1, ..."""
    p = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("grp"), F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")).alias("lines"))
    rows = raw.select("grp", F.posexplode("lines").alias("k", "value"))
    return rows.select("grp", (F.col("k") + 1).alias("ord"), p[1].alias("ctg"), F.when(p[2] == "0", "+").otherwise("-").alias("orient"))


def agp_tour(rows: DataFrame) -> DataFrame:
    """(grp, ord, ctg, orient) of the component rows of an AGP table."""
    from pyspark.sql import Window

    w = Window.partitionBy("scaffold").orderBy("part")
    return rows.where("kind = 'W'").select(F.col("scaffold").alias("grp"), F.row_number().over(w).alias("ord"), F.col("component").alias("ctg"), "orient")


def numbered_breaks(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ctg, breaks): places at which contigs were broken into pieces `contig_number`, from the pieces' lengths in an AGP table.

    contigs: the names before breaking. A contig with no piece has no breaks.
    """
    from pyspark.sql import Window

    raw = contigs.select("ctg").distinct()
    used = rows.where("kind = 'W'").join(raw.withColumnRenamed("ctg", "component"), "component", "left_anti")
    pieces = used.select(F.regexp_extract("component", r"^(.*)_(\d+)$", 1).alias("ctg"), F.regexp_extract("component", r"^(.*)_(\d+)$", 2).try_cast("int").alias("n"), F.col("cend").alias("len")).distinct()
    w = Window.partitionBy("ctg").orderBy("n")
    at = pieces.select("ctg", "n", F.sum("len").over(w).alias("at"), F.lead("n").over(w).alias("next")).where("next is not null")
    lists = at.groupBy("ctg").agg(F.sort_array(F.collect_list("at")).alias("breaks"))  # of one contig
    return raw.join(lists, "ctg", "left").select("ctg", F.coalesce("breaks", F.array().cast("array<bigint>")).alias("breaks"))
