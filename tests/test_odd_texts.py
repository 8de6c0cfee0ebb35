"""Sequence and interval queries on small tables of odd rows, against their SQL in DuckDB or a plain recomputation."""

import duckdb
import pytest

from linkloom.operators import windows as W
from linkloom.plans import catalog

TEXTS = ["acg\nacg\r\nttt", "acgt\n", "tag ", "a\U0001f600acgta\U0001f600", "acg", "", None, "ac\U0001f600gt\U0001f601\n", "nnacgtnn"]


@pytest.mark.parametrize("name", ["kmer_canon", "kmer_classes"])
def test_line_breaks_and_wide_characters(spark, tmp_path, name):
    rows = [(k, t, ("de", "en")[k % 2], "s", None) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.queries()[name](spark, str(tmp_path))
    want = con.execute(catalog.oracles()[name]).fetchdf()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.itertuples(index=False)))


def test_equal_intervals_join_only_what_touches(spark):
    """Intervals that stand there twice neither part a union nor lengthen the one before."""
    rows = [(k % 50, s, s + 5 + k % 3) for k in range(400) for s in (3 * (k % 13), 9 * (k % 7))] * 2
    places = {c: sorted({x for d, s, e in rows if d == c for x in range(s, e + 1)}) for c in range(50)}
    want = [(c, x, next(y for y in range(x, 999) if y + 1 not in held)) for c, v in places.items() for held in [set(v)] for x in v if x - 1 not in held]
    x = spark.createDataFrame(rows, "ctg long, s long, e long").repartition(5)
    assert sorted(map(tuple, W.merge_intervals(x, ["ctg"], "s", "e").select("ctg", "s", "e").collect())) == sorted(want)
