"""Sketches are compared by numbers of eight bytes, not by their digests, with the same pairs as by brute force."""

import random

from linkloom.operators import alignments as A


def test_pairs_by_id_against_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("acgt") for _ in range(120)) for _ in range(12)]
    texts = [(k, b[:cut] + base[(k + 1) % 12][:30]) for k, b in enumerate(base) for cut in (40, 80, 120)] + [(3, base[5]), (3, base[7]), (None, base[2])]
    df = spark.createDataFrame(texts, "ctg long, seq string").repartition(4)
    _, one = A._classes(df, 11, 5)
    held = {x.id: set(x.sketch) for x in one.collect()}
    assert len(held) == one.count()
    want = {(x, y) for x in held for y in held if x < y and len(held[x] & held[y]) / min(len(held[x]), len(held[y])) >= 0.3}
    alike = A._alike(one, 2, 0.3)
    assert dict(alike.dtypes)["x"] == "bigint"
    got = [(min(p.x, p.y), max(p.x, p.y)) for p in alike.collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
