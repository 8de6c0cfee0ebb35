"""The registered mix against a plain recomputation, and its targets against their law."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def slow_targets(sizes, order, weights=(5, 2, 1), share=1.5, most=2):
    """Dealing by weight; the most overfull sources are closed in each turn, until none is above its cap."""
    closed, words = {}, share * sum(sizes.values())
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    while True:
        open_ = [s for s in order if s not in closed]
        rest = words - sum(closed.values())
        deal = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if deal[s] > most * sizes[s]]
        if not above:
            return closed | deal
        closed |= {s: float(most * sizes[s]) for s in above}


def test_registered_mix_against_plain_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    sizes = Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = slow_targets(sizes, order)
    got = queries.QUERIES["op8_flow_mix"](spark, SF).collect()
    assert len(got) == len(docs)
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]])
        assert r.target == pytest.approx(targets[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in order)


@pytest.mark.parametrize("seed", range(20))
def test_targets_keep_their_law(seed):
    r = random.Random(seed)
    sizes = {f"s{k:02d}": r.choice([0, 1, r.randint(1, 50), r.randint(1, 10_000)]) for k in range(r.randint(1, 12))}
    got = mixing.weighted_targets(sizes, sorted(sizes), (5, 2, 1), 1.5 * sum(sizes.values()), 2)
    assert got == pytest.approx(slow_targets(sizes, sorted(sizes)))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(got[s] <= 2 * sizes[s] + 1e-6 for s in sizes)


def test_null_ids_and_equal_ids_are_taken_in_a_fixed_order(spark):
    rows = [(None if k % 2 else 7, f"word{k} and more words of its own", "a" if k % 3 else None) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda df: Counter((r.text,) for r in mixing.mixed_documents(df).collect())
    assert key(docs) == key(docs.repartition(5).orderBy(F.rand(3)))
    assert mixing.mix(docs).agg(F.sum("taken")).first()[0] == round(1.5 * 7 * 300)
