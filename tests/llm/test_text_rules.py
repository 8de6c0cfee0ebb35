"""Line de-duplication, quality rules, personal data."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import prose  # noqa: F401
from pyspark.sql import functions as F

from linkloom.llm import linededup, pii, quality

FOLD = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
STRIP = " \t\n\x0b\x0c\r"


def with_lines(spark, messy):
    line = "This Licence line stands in many documents of the corpus"
    wide = "é" * 39
    more = [(600 + k, f"first {k}\n  {line.upper() if k % 2 else line}\t\nown line number {k} of some greater length indeed\n{line}" + ("\n" + wide if k % 3 == 0 else "")) for k in range(8)]
    more += [(700 + k, "four documents share this line, which is one too few here\nx") for k in range(4)] + [(710 + k, wide + "e\n" + wide) for k in range(6)]
    more += [(None, line), (720, None), (720, line)]
    return messy.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)


def slow_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: FOLD(x.strip(STRIP))
    held = {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= min_chars and r.doc_id is not None:
                held.setdefault(key(x), set()).add(r.doc_id)
    keep = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        stay = [x for x in lines if key(x) not in keep or keep[key(x)] == r.doc_id]
        out[r.doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


@pytest.mark.parametrize("bits,broadcast", [(1 << 30, 200_000), (1 << 20, 0)])
def test_lines_against_brute_force(spark, messy, bits, broadcast):
    docs = with_lines(spark, messy)
    got = linededup.dedup_lines(docs, max_bits=bits, max_broadcast=broadcast).collect()
    want = slow_lines(docs.collect())
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == want
    assert sum(r.n_dropped for r in got) > 10


def test_filters_lose_no_repeat():
    """Keys seen once each in two partial filters are in the merged one."""
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    once = []
    for part in (h[:1200], h[800:]):
        bits = np.zeros(4 * linededup.SEGMENT_BITS // 8, np.uint8)
        at = linededup._bits(part, 4).astype(np.int64)
        np.bitwise_or.at(bits, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())
        once.append(bits)
    found = linededup.TwiceFilter(once[0] & once[1], 4).has(h)
    assert found[800:1200].all() and found.mean() < 0.4


def test_lines_of_nothing(nothing):
    assert linededup.dedup_lines(nothing).count() == 0


def slow_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if x.strip(STRIP)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark, messy):
    more = [(800, "a b c d e a b c d e f"), (801, "x " * 12), (802, "a b c d e\na b c d e\n\n \n\na b c d e"), (803, "| # a\x0bb\x0cc $"), (804, "a b c d e f g a b c d e f g h")]
    docs = messy.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = quality.measure(docs.select("doc_id", "text"), ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r.doc_id, *slow_counts(r.text)) for r in docs.collect())


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (0, 500), (3, 400), (7, 350), (20, 1000), (9, 100)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        want = sum(math.comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)) if r.k <= r.n * 0.02 else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def test_levels_are_proven_per_stratum(spark):
    """A stratum with too few labels has no level; others take none that rejects more good texts than proven."""
    rows = [("big", 16, 1)] * 3000 + [("big", 12, 1)] * 300 + [("big", 6, 0)] * 400 + [("small", 6, 0)] * 20 + [("small", 16, 1)] * 30 + [("=", 4, 0)]
    got = {r.stratum: r.chosen for r in quality.proven_levels(spark.createDataFrame(rows, "stratum string, level int, quality int")).collect()}
    assert got == {"big": 6}


def test_verdicts(spark, messy):
    labels = messy.select("doc_id", F.lit(1).alias("quality")).union(spark.createDataFrame([(3, 0), (None, 0), (4, None)], "doc_id long, quality int"))
    got = quality.judge(messy, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in messy.collect())
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels to prove a cutoff


def test_rules_of_nothing(spark, nothing):
    assert quality.judge(nothing, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def slow_luhn(digits):
    double = lambda v: v * 2 - 9 if v > 4 else v * 2
    return sum(double(int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def slow_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and slow_luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_the_plain_patterns():
    import random

    r = random.Random(2)
    parts = ["1", "2", "55", "255", "0", ".", ".", "@", "a.b", "-", " ", "+", "(", ")", "é", "%", "a", "4111 1111 1111 1111", "x@y.z", "\n", "1.2.3.4", "+49 30 123456"]
    for _ in range(30_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 24)))
        assert pii.base_spans(t) == slow_spans(t), repr(t)


def test_long_runs_are_linear():
    for t in ("9" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1 " * 60_000, "a@" * 100_000):
        pii.base_spans(t)


def test_patterns_find_unseen_identifiers(spark, messy):
    seeds = [(900 + k, f"hello my account phone: +1 555 010 {1000 + k} thanks") for k in range(8)]
    unseen = [(950 + k, f"hello my account phone: 555-018-{2000 + k} thanks") for k in range(5)]
    clean = [(970 + k, f"order total was {123456 + k} units sold") for k in range(5)]
    docs = messy.unionByName(spark.createDataFrame(seeds + unseen + clean, "doc_id long, text string"), allowMissingColumns=True)
    got = pii.find_personal_data(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    added = {r.doc_id: [text[r.doc_id][x.start : x.end] for x in r.added] for r in got if r.added}
    assert added == {k: [f"555-018-{2000 + k - 950}"] for k, _ in unseen}
    assert all(r.added[0].kind == 3 for r in got if r.added)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    want = Counter((r.doc_id, tuple(slow_spans(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple((x.start, x.kind, x.end) for x in r.base)) for r in got) == want


def test_digest_of_spans(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co and 10.0.0.1"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(docs)).collect()}
    assert got[1].spans == "email:5:11,ip:16:24" and got[1].base_sha256 == hashlib.sha256(b"email:5:11,ip:16:24").hexdigest()
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 0)
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_personal_data_of_nothing(nothing):
    assert pii.digest(pii.find_personal_data(nothing)).count() == 0
