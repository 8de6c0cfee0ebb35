"""SimHash groups and benchmark decontamination."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import prose  # noqa: F401

from linkloom.llm import decontaminate, simhash

FOLD = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", FOLD(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, ids):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, x in enumerate(ids):
        if x is not None:
            least[find(k)] = min(least.get(find(k), x), x)
    return [least.get(find(k)) for k in range(len(ids))]


def test_groups_against_brute_force(messy):
    rows = messy.collect()
    want = Counter(zip([r.doc_id for r in rows], prints := [slow_fingerprint(r.text) for r in rows], slow_components(prints, [r.doc_id for r in rows])))
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(messy).collect()) == want


@pytest.mark.parametrize("limit", [20_000, 40, 15])
def test_links_of_dense_prints(spark, limit):
    """Chains and dense balls of fingerprints; small group limits force the recursive splitting."""
    r = random.Random(limit)
    prints = {0}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(60):
            y = x
            for _ in range(r.randint(0, 3)):
                y ^= 1 << r.randrange(64)
            prints.add(y)
    x = r.getrandbits(64)
    for k in range(40):  # a chain that ends far from its start
        x ^= 1 << k
        prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    edges = [(e.a, e.b) for e in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), group_limit=limit).collect()]
    at = {s: k for k, s in enumerate(signed)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (2**64 - 1)).bit_count() or a != b
        i, j = find(at[a]), find(at[b])
        root[max(i, j)] = min(i, j)
    assert [find(k) for k in range(len(prints))] == slow_components(prints, list(range(len(prints))))


def test_tree_prunes_to_the_same_groups():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    bit = lambda n: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [b ^ bit(40) ^ bit(40) for b in base]))
    rank = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    x = x[np.argsort(rank)]
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    want = np.arange(len(x))
    for _ in range(60):
        want = np.where(near, want[None], len(x)).min(1)
    assert (simhash.tree_links(x) == want).all()


def test_one_of_each_group_stays(messy):
    kept = simhash.drop_near_duplicates(messy)
    assert kept.schema == messy.schema
    rows = messy.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    comp = slow_components(prints, list(range(len(rows))))
    groups = {}
    for r, c in zip(rows, comp):
        groups.setdefault(c, []).append(r)
    first = {min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)).doc_id for g in groups.values()}
    got = kept.collect()
    assert {r.doc_id for r in got} == first
    assert len({(r.doc_id, r.text) for r in got}) == len(groups)


def test_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).columns == nothing.columns


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_hits(text, windows):
    w = WORD.findall(FOLD(text))
    hit, items = set(), set()
    for win, owners in windows.items():
        for s in range(len(w) - len(win) + 1):
            if tuple(w[s : s + len(win)]) == win:
                hit |= set(range(s, s + len(win)))
                items |= owners
    return len(w), len(hit), sorted(map(str, items)), hit


def windows_of(items):
    out = {}
    for i, t in items:
        w = WORD.findall(FOLD(t))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            out.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else i)
    return out


def bench_items():
    return [(1, prose(1, 14)), (2, prose(2, 40)), (10, prose(1, 14)), (3, "Harbour, walks!"), (4, None), (5, ""), (6, "?!"), (None, prose(300, 12)), (7, "ñandú 中文"), (8, "the the the the the the the the the the the the")]


def with_passages(spark, messy):
    more = [(500, prose(41, 20) + " " + prose(2, 40)[30:] + " " + prose(42, 20)), (501, prose(2, 40).upper().replace(" ", "-- ")), (502, "the " * 60), (503, "xx Harbour   walks yy harbour.walks"), (504, prose(300, 12) * 2)]
    return messy.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)


@pytest.mark.parametrize("blocks,shard", [(1 << 24, 1 << 24), (200, 3000)])
def test_hits_against_brute_force(spark, messy, blocks, shard):
    docs = with_passages(spark, messy)
    bench = spark.createDataFrame(bench_items(), "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, block_bytes=blocks, shard_bytes=shard)
    windows = windows_of(bench_items())
    want = Counter()
    for r in docs.collect():
        n, h, items, _ = slow_hits(r.text, windows)
        want[r.doc_id, n, h, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), h > 0] += 1
    assert Counter(tuple(r) for r in decontaminate.digest(found).collect()) == want


def test_passages_are_cut(spark, messy):
    docs = with_passages(spark, messy)
    bench = spark.createDataFrame(bench_items(), "item_id long, text string")
    got = decontaminate.remove_contamination(docs, bench)
    assert got.schema == docs.schema
    windows = windows_of(bench_items())
    want = Counter()
    for r in docs.collect():
        w = WORD.findall(FOLD(r.text))
        hit = slow_hits(r.text, windows)[3]
        if not hit or len(hit) < len(w):
            want[r.doc_id, r.text is None, tuple(x for k, x in enumerate(w) if k not in hit)] += 1
    assert Counter((r.doc_id, r.text is None, tuple(WORD.findall(FOLD(r.text)))) for r in got.collect()) == want


def test_no_benchmark_and_no_documents(spark, messy, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(messy, none).where("size(spans) > 0").count() == 0
    assert decontaminate.find_contamination(nothing, none).count() == 0


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    for sigma in (3, 5, 9):
        text = rng.integers(1, sigma, 400)
        index = decontaminate.FMIndex(text, sigma)
        for length in (1, 2, 3, 7):
            patterns = rng.integers(1, sigma, (40, length))
            lo, hi = index.search(patterns)
            for k, p in enumerate(patterns):
                want = [s for s in range(len(text) - length + 1) if (text[s : s + length] == p).all()]
                assert sorted(index.locate(np.arange(lo[k], hi[k]))) == want
