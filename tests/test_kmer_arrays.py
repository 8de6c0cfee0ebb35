"""K-mers as arrays against Spark's own columns and a plain recomputation."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.functions.sequence import canonical, kmers
from linkloom.operators import kmers as M
from linkloom.plans import catalog

LETTERS = ["acgtnACGT", "acgt é", "a\U0001f600ctgü中\n", "\U0001f600中"]


def _texts(n):
    rng = random.Random(5)
    return ["".join(rng.choices(rng.choice(LETTERS), k=rng.choice([0, 1, 3, 16, 17, 18, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize(("k", "w"), [(17, 17), (5, 3), (1, 4)])
def test_sketches_equal_those_of_columns(spark, k, w):
    texts = [*_texts(120), None]
    hashes = F.transform(kmers(F.col("seq"), k), lambda x: F.xxhash64(canonical(x)))
    df = spark.createDataFrame(list(enumerate(texts)), "ctg long, seq string").repartition(3)
    want = {}
    for c, h in df.select("ctg", hashes.alias("h")).collect():
        if h:
            want[c] = sorted({min(h[i : i + w]) for i in range(max(1, len(h) - w + 1))})
    assert {r.ctg: r.sketch for r in M.sketches(df, k, w).collect()} == want


@pytest.mark.parametrize("lot", [1, 200, 1 << 21])
def test_shares_of_unknown_languages_and_repeated_names(spark, tmp_path, monkeypatch, lot):
    monkeypatch.setattr(M, "LOT", lot)
    rng = random.Random(6)
    texts = [*_texts(80), "zzzzzzz", None]
    rows = [(k // 2 if k % 9 else None, t, rng.choice(["de", "en", None]) if t != "zzzzzzz" else None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.oracles()["kmer_classes"]).fetchall()
    got = catalog.queries()["kmer_classes"](spark, str(tmp_path)).select("doc_id", "only_here", "shared").collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
