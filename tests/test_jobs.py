"""The two jobs: against SQL, run again, over growing input, after a failure, and from the command line."""

import glob
import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import contig_catalogue, link_tables, registered
from jobs._common import settings
from tests.test_catalog import rows

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same(got, want):
    a, b = rows(got), rows(want)
    assert sorted(got.columns) == sorted(want.columns) and len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert all((u == pytest.approx(v, rel=1e-9, abs=1e-9)) if isinstance(u, float) and isinstance(v, float) else u == v for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_against_sql(spark, con, name):
    before = spark.conf.get(contig_catalogue.STORE)
    same(registered.QUERIES[name](spark, SF).toPandas(), con.execute(registered.ORACLES[name]).fetchdf())
    assert spark.conf.get(contig_catalogue.STORE) == before


def listed(out):
    return sorted(os.path.relpath(f, out) for f in glob.glob(f"{out}/**/*.parquet", recursive=True))


def test_catalogue_takes_only_what_is_new(spark, con, tmp_path, caplog):
    docs = con.execute("SELECT * FROM documents ORDER BY doc_id").fetchdf()
    given, out, config = tmp_path / "given", str(tmp_path / "out"), settings(spark, contig_catalogue.CONFIG)
    given.mkdir()
    docs[:90].to_parquet(given / "a.parquet")
    with caplog.at_level("INFO"):
        contig_catalogue.run(spark, str(given), out, config)
        assert spark.read.parquet(f"{out}/catalogue").count() == 90
        first = listed(f"{out}/catalogue")
        docs[90:].to_parquet(given / "b.parquet")
        again = docs[50:70].copy()
        again["text"] = "delivered again"
        again.to_parquet(given / "c.parquet")
        contig_catalogue.run(spark, str(given), out, config)
        assert f"read {len(docs) - 90 + 20} rows of new files" in caplog.text
    assert set(first) <= set(listed(f"{out}/catalogue"))  # what was there is not written again
    same(contig_catalogue.read_back(spark, out).toPandas(), con.execute(registered.ORACLES["job2_contig_catalogue"]).fetchdf())
    everything = listed(out)
    contig_catalogue.run(spark, str(given), out, config)
    assert listed(out) == everything


def test_catalogue_after_a_failed_batch(spark, con, tmp_path, monkeypatch):
    given, out, config = tmp_path / "given", str(tmp_path / "out"), settings(spark, contig_catalogue.CONFIG)
    shutil.copytree(SF, given, ignore=lambda d, names: [n for n in names if n != "documents.parquet"])
    broken = lambda catalogue: (_ for _ in ()).throw(RuntimeError("lost"))
    with monkeypatch.context() as m:
        m.setattr(contig_catalogue, "summed", broken)
        with pytest.raises(Exception):
            contig_catalogue.run(spark, str(given), out, config)
    contig_catalogue.run(spark, str(given), out, config)
    same(contig_catalogue.read_back(spark, out).toPandas(), con.execute(registered.ORACLES["job2_contig_catalogue"]).fetchdf())


def test_catalogue_of_odd_rows(spark, tmp_path):
    given, out = str(tmp_path / "given"), str(tmp_path / "out")
    config = {"motif": "ga", "flank": 2, "parts": 3, "files_per_batch": 1}
    odd = [(1, None, None), (2, "", ""), (None, "gaga", "x"), (None, "gaga", "x"), (None, None, None), (3, "gcGAtc" * 100, "001"), (3, "other", "001"), (4, "ga", "__HIVE_DEFAULT_PARTITION__")]
    spark.createDataFrame(odd[:6] + odd[7:], contig_catalogue.GIVEN).withColumn("part", F.lit("clash")).repartition(3).write.parquet(given)
    contig_catalogue.run(spark, given, out, config)
    got = {(r.contig, r.source): (r.len, r.sites, r.end_sites, r.gc, r.contigs) for r in contig_catalogue.read_back(spark, out).collect()}
    assert got == {
        (1, None): (0, 1, 1, None, 2), (2, ""): (0, 1, 1, None, 1), (None, "x"): (4, 3, 3, 50, 1), (None, None): (0, 1, 1, None, 2),
        (3, "001"): (600, 101, 1, 66, 1), (4, "__HIVE_DEFAULT_PARTITION__"): (2, 2, 2, 50, 1),
    }


def test_catalogue_of_nothing(spark, tmp_path):
    given, out = tmp_path / "given", str(tmp_path / "out")
    given.mkdir()
    contig_catalogue.run(spark, str(given), out, settings(spark, contig_catalogue.CONFIG))
    assert contig_catalogue.read_back(spark, out).count() == 0


def test_lanes_are_replaced_one_by_one(spark, con, tmp_path):
    out, config = str(tmp_path / "out"), settings(spark, link_tables.CONFIG)
    pairs, contigs = str(tmp_path / "pairs.parquet"), f"{SF}/part.parquet"
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    early = F.col("l_shipdate") < "1996-01-01"
    lines.where(early).write.parquet(pairs)
    link_tables.run(spark, pairs, contigs, out, config)
    kept = listed(f"{out}/lanes")
    late = sorted(r[0] for r in lines.where(~early).select(F.date_format("l_shipdate", "yyyy-MM")).distinct().collect())
    link_tables.run(spark, f"{SF}/lineitem.parquet", contigs, out, config | {"lanes": late})
    assert set(kept) < set(listed(f"{out}/lanes"))  # other lanes stay as they are
    want = con.execute(registered.ORACLES["job1_link_tables"]).fetchdf()
    same(link_tables.read_back(spark, out).toPandas(), want)
    link_tables.run(spark, f"{SF}/lineitem.parquet", contigs, out, config | {"lanes": late[:3]})
    same(link_tables.read_back(spark, out).toPandas(), want)
    assert {d[:6] for d in os.listdir(f"{out}/links") if d.startswith("chunk")} == {"chunk="}


def test_command_lines(tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"motif": "th", "flank": 100, "parts": 2, "files_per_batch": 5}))
    for module, args in (
        ("jobs.contig_catalogue", ["--sequences", f"{SF}/documents.parquet*", "--config", str(config)]),
        ("jobs.link_tables", ["--pairs", f"{SF}/lineitem.parquet", "--contigs", f"{SF}/part.parquet"]),
    ):
        out = tmp_path / module
        done = subprocess.run([sys.executable, "-m", module, *args, "--out", str(out)], cwd=REPO, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read " in done.stderr and "wrote " in done.stderr
        assert list(out.glob("*/*=*"))
