"""Text formats as the domain writes them, and the link graph's components."""

import random

import pytest

from linkloom.operators.components import components
from linkloom.sources import formats as R


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "x.fa", ">c1 some words\nACgt\nAC\n\n>c2\nNNN\n")
    assert got(R.fasta(spark, p)) == [("c1", "ACGTAC"), ("c2", "NNN")]
    assert got(R.fasta(spark, p, keep_case=True))[0] == ("c1", "ACgtAC")
    assert got(R.fasta_lengths(spark, p)) == [("c1", 6), ("c2", 3)]


def test_index_and_sketch(spark, tmp_path):
    index = R.fai(spark, put(tmp_path, "x.fai", "b\t10\t1\nA\t20\t2\nc\t30\t3\n"))
    assert got(index) == [(1, "b", 10), (2, "A", 20), (3, "c", 30)]
    sketch = put(tmp_path, "p.txt", "H\tx\nS\tq3\tq1\t.\t.\t.\t0.75\nS\tq1\tq2\t.\t.\t.\t0.5\n")
    assert got(R.sketch_similarity(spark, sketch, index)) == [("A", "b", 0.5), ("b", "c", 0.75)]


def test_gfa(spark, tmp_path):
    p = put(tmp_path, "x.gfa", "H\tVN:Z:1.0\nS\tu1\tACGT\tLN:i:4\trd:i:7\nS\tu2\tACG\nL\tu1\t+\tu2\t-\t12M\n")
    assert got(R.gfa_segments(spark, p)) == [("u1", 4, 8), ("u2", 3, None)]
    assert got(R.gfa_links(spark, p)) == [("u1", "+", "u2", "-", 12)]


def test_pairs_and_sam(spark, tmp_path):
    p = put(tmp_path, "x.pairs", "## pairs\n#columns\nr1\ta\t5\tb\t6\t30\nr2\ta\t1\ta\t9\t.\n")
    assert got(R.pairs(spark, p)) == [("r1", "a", 5, "b", 6, 30), ("r2", "a", 1, "a", 9, None)]
    sam = R.sam(spark, put(tmp_path, "x.sam", "@SQ\tSN:a\nr1\t99\ta\t5\t40\t5M\tb\t9\t0\tAAAAA\tIIIII\tNM:i:1\nr1\t147\tb\t9\t40\t5M\ta\t5\t0\tAAAAA\tIIIII\t\nr2\t65\ta\t5\t2\t5M\tb\t9\t0\tA\tI\t\n"))
    assert got(R.sam_pairs(sam, 10)) == [("r1", "a", 5, "b", 9, 40), ("r1", "b", 9, "a", 5, 40)]
    assert [r.read for r in R.proper_first(sam).collect()] == ["r1"]


def test_tables(spark, tmp_path):
    assert got(R.re_counts(spark, put(tmp_path, "re", "#Contig\tRECounts\tLength\nc\t3\t100\n"))) == [("c", 3, 100)]
    assert got(R.links(spark, put(tmp_path, "l.csv", "source,target,links\nb,a,3\na,b,4\n"))) == [("a", "b", 4.0)]
    assert got(R.copies(spark, put(tmp_path, "n", "a\t3\nb\tx\nc\t2.5\n"))) == [("a", 3), ("b", 1), ("c", 1)]
    assert got(R.members(spark, put(tmp_path, "c", "g1\t2\ta b\ng2\t1\tc\n"))) == [("g1", "a"), ("g1", "b"), ("g2", "c")]
    assert got(R.similarity(spark, put(tmp_path, "s", "source,target,sim\nu2,u1,0.5\nx1,u1,0.9\n"), prefix="u")) == [("u1", "u2", 0.5)]
    assert got(R.ids(spark, put(tmp_path, "i", "#h\na 1\na 2\nb\n"))) == [("a",), ("b",)]
    assert got(R.bed(spark, put(tmp_path, "b", "c\t0\t10\t1.5\n"))) == [("c", 1, 10, 1.5)]


def test_layouts(spark, tmp_path):
    agp = R.agp(spark, put(tmp_path, "x.agp", "# agp\ns\t1\t10\t1\tW\tc\t1\t10\t-\ns\t11\t110\t2\tU\t100\tscaffold\tyes\tna\n"))
    assert got(agp)[0][4:] == ("W", "c", 1, 10, "-") and got(agp)[1][6] is None
    assert got(R.clm(spark, put(tmp_path, "x.clm", "a+ b-\t2\t5 7\n"))) == [("a", "b", "+-", 2, [5, 7])]
    tour = R.tours(spark, put(tmp_path, "g1.tour", ">old\na+ b+\n>new\nb- a+\n\n"))
    assert got(tour) == [("g1", 1, "b", "-"), ("g1", 2, "a", "+")]
    assert R.repeated_in_tours(tour).count() == 0
    assert got(R.assembly(spark, put(tmp_path, "x.assembly", ">a 1 10\n>b 2 20\n2 -1\n1\n"))) == [(1, 1, "b", "+"), (1, 2, "a", "-"), (2, 1, "a", "+")]


def test_reads_and_logs(spark, tmp_path):
    assert got(R.fastq(spark, put(tmp_path, "x.fq", "@r1 x\nACG\n+\n@II\n@r2\nA\n+\nI\n"), 2)) == [("r1", "ACG", "@II")]
    assert got(R.log_metric(spark, put(tmp_path, "x.log", "a\nbest inflation 1.5 found\n"), r"inflation ([\d.]+)")) == [(1.5,)]
    (tmp_path / "groups").mkdir()
    for g in "xy":
        (tmp_path / "groups" / f"{g}.txt").write_text(f"#Contig\tn\n{g}1\t3\n")
    assert got(R.group_files(spark, f"file://{tmp_path}/groups")) == [("x", "x1"), ("y", "y1")]


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(200)] + [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(150)] + [(5000, 6000 + k) for k in range(300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    assert set(map(tuple, components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def bam_bytes(refs, rows, order="unsorted"):
    """A small BAM file by the format's definition, in blocks of a few bytes so that records span them."""
    import struct
    import zlib

    text = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    raw = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, size in refs:
        raw += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    for name, flag, ref, pos, mapq, cigar, nref, npos, seq, nm, de in rows:
        packed = bytes(("=ACMGRSVTWYHKDBN".index(a) << 4) | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(seq[::2], seq[1::2] + "=" * (len(seq) % 2)))
        tags = b"NMC" + struct.pack("<B", nm) + b"XZZab\0" + b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"def" + struct.pack("<f", de)
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), nref, npos - 1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar) + packed + b"\xff" * len(seq) + tags
        raw += struct.pack("<i", len(body)) + body
    out = b""
    for k in [*range(0, len(raw), 50), None]:
        part = raw[k : k + 50] if k is not None else b""
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam(spark, tmp_path):
    from linkloom.sources import bam as B

    rows = [("r1", 99, 0, 5, 40, [(4, "S"), (10, "M"), (2, "D")], 1, 9, "ACGTN", 1, 0.01), ("r1", 147, 1, 9, 40, [(12, "M")], 0, 5, "AC", 0, 0.2), ("r2", 4, -1, 0, 0, [], -1, 0, "", 0, 0.0), ("r3", 65, 0, 5, 2, [(20, "M")], 0, 7, "A", 3, 0.0)]
    for k in range(2):
        (tmp_path / f"{k}.bam").write_bytes(bam_bytes([("a", 100), ("b", 200)], rows, ("unsorted", "coordinate")[k]))
    paths = [f"file://{tmp_path}/{k}.bam" for k in range(2)]
    x = B.bam(spark, paths)
    one = [(r.read, r.flag, r.rname, r.pos, r.mapq, r.cigar, r.rnext, r.pnext, r.seq, r.nm) for r in x.collect()]
    want = [("r1", 99, "a", 5, 40, "4S10M2D", "b", 9, "ACGTN", 1), ("r1", 147, "b", 9, 40, "12M", "a", 5, "AC", 0), ("r2", 4, "*", 0, 0, "*", "*", 0, "*", 0), ("r3", 65, "a", 5, 2, "20M", "=", 7, "A", 3)]
    assert sorted(one) == sorted(want * 2)
    assert [r.read for r in B.passing(B.bam(spark, paths[:1]), 10, 95, 12).collect()] == ["r1"]
    assert got(R.sam_pairs(B.bam(spark, paths[:1]), 10)) == [("r1", "a", 5, "b", 9, 40), ("r1", "b", 9, "a", 5, 40)]
    assert B.sort_order(paths[1]) == "coordinate" and B.require_unsorted(paths[:1]) == paths[:1]
    with pytest.raises(ValueError):
        B.require_unsorted(paths)


def test_lists_of_other_tools(spark, tmp_path):
    m = R.mnd(spark, put(tmp_path, "x.mnd", "0 s1_a 5 0 16 s1_b 9 1 40 M A 30 M C x y\n0 s1_a 5 0 0 s2_a 7 1\n"))
    assert got(R.within_source(m)) == [(0, "s1_a", 5, 0, 16, "s1_b", 9, 1, "s1")]
    t = R.truth(spark, put(tmp_path, "t", ">chr1 x\na +\nb -\n\n>chr2\nc +\n"))
    assert got(t) == [("chr1", 1, "a", "+"), ("chr1", 2, "b", "-"), ("chr2", 1, "c", "+")]
    assert got(R.allele_info(spark, put(tmp_path, "a", "h h h h\nx chr1 7 A C G\n"))) == [("chr1", 7, ["A", "C", "G"], 2)]
    (tmp_path / "order").mkdir()
    (tmp_path / "order" / "group1.ordering").write_text("#x\n1\tc2\t0\t5\n2\tc1\t1\t.\n")
    assert got(R.lachesis_order(spark, f"file://{tmp_path}/order")) == [("group1", 1, "c2", "+"), ("group1", 2, "c1", "-")]
    agp = R.agp(spark, put(tmp_path, "x.agp", "s\t1\t10\t1\tW\tc_2\t1\t10\t-\ns\t11\t12\t2\tN\t2\tscaffold\tyes\tna\ns\t13\t16\t3\tW\tc_1\t1\t4\t+\nt\t1\t9\t1\tW\td\t1\t9\t+\nt\t1\t9\t1\tW\tc_3\t1\t9\t+\n"))
    assert got(R.agp_tour(agp.where("scaffold = 's'"))) == [("s", 1, "c_2", "-"), ("s", 2, "c_1", "+")]
    assert got(R.numbered_breaks(agp, spark.createDataFrame([("c",), ("d",)], "ctg string"))) == [("c", [4, 14]), ("d", [])]


def test_truth_and_delta_files(spark, tmp_path):
    from linkloom.sources import sinks as W

    rows = spark.createDataFrame([("chr1", 2, "b", "-"), ("chr1", 1, "a", "+"), ("chr2", 1, "c", "+")], "chrom string, ord int, ctg string, orient string")
    W.truth(rows, f"file://{tmp_path}/truth")
    assert got(R.truth(spark, f"file://{tmp_path}/truth")) == [("chr1", 1, "a", "+"), ("chr1", 2, "b", "-"), ("chr2", 1, "c", "+")]
    runs = spark.createDataFrame([("r", 1, 9, "q", 11, 19, "-", 50, 60)], "ref string, rs long, re long, query string, qs long, qe long, orient string, ref_len long, query_len long")
    W.delta(runs, f"file://{tmp_path}/delta")
    lines = {r.value for r in spark.read.text(f"file://{tmp_path}/delta").collect()}
    assert lines == {"ref.fa query.fa", "NUCMER", ">r q 50 60", "1 9 19 11 0 0 0", "0"}
    tagged = W.haplotype_tag(spark.createDataFrame([("x", "c_12_3", 0.5)], "tag string, ctg string, density double"))
    assert got(tagged) == [("x", 0.5, "nhap2")]


def test_steps_resume_and_passing_tables_go(spark, tmp_path):
    import os

    from linkloom.functions import storage as S

    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert S.step(spark, f"file://{tmp_path}/run", "links", make).count() == 3
    assert made == [1]
    kept = []
    with S.passing_tables(spark, lambda: kept):
        inner = S.stored(spark.range(5))
        names = inner.inputFiles()
        kept.append(S.stored(inner.where("id > 1")))
    assert kept[0].count() == 3
    assert not any(os.path.exists(p.removeprefix("file://")) for p in names)
