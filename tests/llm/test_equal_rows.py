"""Of rows equal in every column one stays."""

from collections import Counter

from linkloom.llm import _shared, simhash


def test_one_of_equal_rows_stays(messy):
    kept = Counter(tuple(r) for r in simhash.drop_near_duplicates(messy).collect())
    assert max(kept.values()) == 1 and any(r[0] == 120 for r in kept)


def test_many_removed_rows_go_by_a_bitmap(spark, messy, monkeypatch):
    """Beyond MAX_GONE the rows that stay are the same, nulls, repeats and columns too."""
    more = messy.union(spark.createDataFrame([(k, f"text {k}", "en", "s", 1, 7, 3, "h", 0.5, "r", 1, "l") for k in range(5000, 9000)], messy.schema))
    gone = more.where("doc_id % 3 = 0 or doc_id is null").select(_shared.row_key(more, "doc_id").alias("k")).select("k.id", "k.hash")
    want = Counter(map(tuple, _shared.without(more, gone, "doc_id").collect()))
    assert want == Counter(map(tuple, more.where("doc_id % 3 <> 0").collect()))
    monkeypatch.setattr(_shared, "MAX_GONE", 0)
    kept = _shared.without(more, gone, "doc_id")
    assert Counter(map(tuple, kept.collect())) == want and kept.schema == more.schema
    monkeypatch.setattr(_shared, "MAX_FILTER_BITS", 4)  # full: all rows are confirmed
    assert Counter(map(tuple, _shared.without(more, gone, "doc_id").collect())) == want
