"""The pipeline and the registered queries, on the smallest tables."""

import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import queries
from linkloom.llm._shared import stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns


def test_stages_do_their_work(spark, steps):
    raw, told, single, clean, mixed, tokens = ([r for r in df.collect()] for df in steps)
    assert {r.doc_id for r in raw if WORD.search(r.text) and len(r.text) > 20} <= {r.doc_id for r in told}
    from test_similarity import slow_components, slow_fingerprint

    want = slow_components([slow_fingerprint(r.text) for r in told], [r.doc_id for r in told])
    assert Counter(r.doc_id for r in single) == Counter(set(want))
    fold = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [fold(r.text)] for k in range(max(1, len(w) - 9))}
    before = {r.doc_id: r for r in single}
    for r in clean:
        w = fold(r.text)
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w)))
        assert len(r.text) == r.n_chars
    assert sum(r.text != before[r.doc_id].text for r in clean) < len(clean) / 4
    size = lambda r: len(r.text.split())
    total = sum(map(size, clean))
    assert abs(sum(map(size, mixed)) - 1.5 * total) < 0.02 * total
    assert Counter(r.doc_id for r in mixed).most_common(1)[0][1] <= 2
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mixed)


def test_run(spark, steps):
    key = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[-1])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_give_a_row_per_document(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert "doc_id" in df.columns and df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda df: sorted(tuple(None if pd.isna(v) else v for v in r) for r in df[cols].itertuples(index=False))
    assert plain(got.drop(columns="grown_shard", errors="ignore").assign(**{c: None for c in {"grown_shard"} & set(cols)})) == plain(want)


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_messy_and_empty_tables(spark, messy, nothing, at):
    stage = corpus_pipeline.STAGES[at][1]
    got = stage(spark, messy, SF)
    assert got.count() > 0
    assert stage(spark, nothing, SF).count() == 0
    if at < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == messy.columns and dict(got.dtypes) == dict(messy.dtypes)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_take_messy_tables(spark, messy, tmp_path, name):
    """Whole queries over a folder of tables with nulls, repeats and clashing columns, and over empty ones."""
    for k, keep in enumerate(("true", "false")):
        d = tmp_path / str(k)
        messy.where(keep).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").where(keep).write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "the of and river stone light under harbour walks slowly when"), (None, None)], "item_id long, text string").where(keep).write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(1, "https://a.example.org/", '<html lang="en"><body><p>the of and river stone</p></body></html>'), (2, None, None), (None, "x", "<p>no end")], "page_id long, url string, html string").where(keep).write.parquet(f"{d}/pages.parquet")
        assert queries.QUERIES[name](spark, str(d)).count() == (messy.count() if keep == "true" else 0)


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns_named_like_their_own(spark, at):
    """Extra columns may have the names that operators give to what they add."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    names = ["__linkloom_row", "k", "c0", "_text", "language", "host", "part", "frame", "bin", "pattern", "own", "kept", "fp", "component", "sources", "taken", "words", "head", "h", "bucket", "bits", "held", "gone_id"]
    clash = docs.select("*", *(F.lit(7).alias(n) for n in names))
    stage = corpus_pipeline.STAGES[at][1]
    got, want = stage(spark, clash, SF), stage(spark, docs, SF)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in want.collect())
    if at < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == clash.columns and got.select(names).distinct().count() == 1
