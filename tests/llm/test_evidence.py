"""Language evidence against a plain Bayes computation; features of toxicity against a plain count."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from linkloom.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def soft(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


def slow_posteriors(rows, model):
    """rows: (id, text, declared, host, suffix, teaches)."""
    n = len(model.languages)
    heard, alone = [], []
    for _, text, *_ in rows:
        letters, ll = model.score((text or "").encode())
        h = np.array(ll) * min(letters, langid.MAX_EVIDENCE)
        heard.append(h)
        alone.append(soft(h) if letters >= langid.MIN_LETTERS else None)
    sums = {k: defaultdict(lambda: [np.zeros(n), 0]) for k in ("declared", "host", "suffix", "all")}
    home = {}
    for (_, _, declared, host, suffix, teaches), p in zip(rows, alone):
        if p is None or not teaches:
            continue
        for kind, key in (("declared", declared), ("host", host), ("suffix", suffix), ("all", 0)):
            if key is not None:
                sums[kind][key][0] += p
                sums[kind][key][1] += 1
        if host is not None and suffix is not None:
            home[host] = max(home.get(host, ""), suffix)
    total, count = sums["all"][0]
    base = (total + 1) / (count + n)
    suffixes = {k: (s + langid.SUFFIX_WEIGHT * base) / (c + langid.SUFFIX_WEIGHT) for k, (s, c) in sums["suffix"].items()}
    hosts = {k: (s + langid.HOST_WEIGHT * suffixes.get(home.get(k), base)) / (c + langid.HOST_WEIGHT) for k, (s, c) in sums["host"].items()}
    told = {k: (s + langid.HOST_WEIGHT * base) / (c + langid.HOST_WEIGHT) / base for k, (s, c) in sums["declared"].items()}
    return [soft(h + np.log(hosts.get(host, suffixes.get(suffix, base))) + np.log(told.get(declared, np.ones(n)))) for h, (_, _, declared, host, suffix, _) in zip(heard, rows)]


def test_posteriors_are_those_of_bayes(spark):
    r = random.Random(3)
    words = {"en": "the river was and with children went", "fr": "le temps beau avec les enfants et", "de": "der fluss war und mit kindern ging"}
    rows = []
    for k in range(240):
        lang = r.choice(sorted(words))
        host = r.choice([None, "a.fr", "b.de", "c.com", "d.com"])
        suffix = host and host.rsplit(".", 1)[1]
        text = r.choice([None, "", "x1 !", " ".join(r.choice(words[lang].split()) for _ in range(r.randint(1, 12)))]) if k % 5 == 0 else " ".join(r.choice(words[lang].split()) for _ in range(r.randint(1, 12)))
        rows.append((k if k % 50 else None, text, r.choice([None, lang, "en", "zz"]), host, suffix, k % 4 > 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string, teaches boolean")
    model = langid.fit_text_model(docs.where("declared <> 'zz'"), F.col("declared"))
    got = langid.identify(docs, model, declared=F.col("declared"), host=F.col("host"), suffix=F.col("suffix"), teaches=F.col("teaches")).collect()
    want = defaultdict(list)
    for row, p in zip(rows, slow_posteriors(rows, model)):
        want[row[0]].append(np.round(p, 6).tolist())
    have = defaultdict(list)
    for x in got:
        have[x.doc_id].append(np.round(x.evidence, 6).tolist())
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_accuracy_with_and_without_each_evidence(spark):
    """On rows that the text model was not fitted on, against the language column; all texts of 20 letters or more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, evidence = queries.language_evidence(spark, docs, SF)
    truth = {r.doc_id: r.lang for r in docs.where(evidence["teaches"]).collect()}
    right = {}
    for name, off in {"all": (), "no declaration": ("declared",), "no host": ("host",), "text alone": ("declared", "host", "suffix")}.items():
        found = langid.identify(docs, model, **{k: v for k, v in evidence.items() if k not in off}).where("letters >= 20").collect()
        right[name] = np.mean([r.language == truth[r.doc_id] for r in found if r.doc_id in truth])
    print(right)
    assert min(right.values()) >= 0.97, right


def test_more_than_two_hundred_languages(spark, monkeypatch):
    """None is dropped; with a small model trigrams share buckets."""
    monkeypatch.setattr(langid, "MODEL_CELLS", 1 << 21)
    rows = [(k, " ".join(chr(0x4E00 + 20 * (k % 205) + (k * j) % 20) * 3 for j in range(1, 9)), f"l{k % 205:03d}") for k in range(820)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_text_model(docs, F.col("lang"))
    assert len(model.languages) == 205 and model.table.shape == (8192, 205)
    scores = [model.score(t.encode())[1] for _, t, _ in rows]
    assert np.mean([model.languages[int(np.argmax(s))] == lang for s, (_, _, lang) in zip(scores, rows)]) > 0.95


def slow_features(text, words):
    """The features by their names, one after the other."""
    tokens = text.split()
    if not tokens:
        return [0.0] * len(toxicity.FEATURES)
    n, raw = len(tokens), text.encode()
    told = [toxicity.Words(words.lexicon)[t] for t in tokens]
    weight = [w[0] for w in told]
    hits = [k for k, w in enumerate(weight) if w > 0]
    you = [k for k, w in enumerate(told) if w[3]]
    rate = lambda chars: sum(raw.count(c.encode()) for c in chars) / len(raw)
    return [
        math.log1p(n), len(hits) / n, sum(w >= 5 for w in weight) / n, sum(weight) / n, math.log1p(len(hits)), max(weight),
        sum(any(abs(h - y) <= 5 for y in you) for h in hits) / n, len(you) / n, sum(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in raw) / len(raw),
        sum(len(x) > 1 and x.isupper() for x in (t.strip(toxicity._EDGE) for t in tokens)) / n, rate("!"), rate("?"), rate("!\"'(),-./:;?"), rate("#$%&*<>@|"), rate("0123456789"),
        sum(bool(toxicity._MIXED.search(t.strip(toxicity._EDGE))) for t in tokens) / n, sum(w[2] for w in told) / n, len(re.findall("!!", text)) / n,
    ]


@pytest.mark.parametrize("seed", range(40))
def test_features_against_plain_counts(seed):
    r = random.Random(seed)
    words = toxicity.Words({"idiot": 5.0, "scum": 3.0, "riv~": 1.0, "river": 2.0})
    parts = [*prose(seed, 12).split(), "you", "YOU", "idiot!!", "1d10t", "SCUM", "i.d.i.o.t", "naïve", "a@b", "...", "rivers?", "#x", "du,"]
    text = " ".join(r.choice(parts) for _ in range(r.randint(0, 30)))
    assert toxicity.features(text, words) == pytest.approx(slow_features(text, words))


def test_a_tree_takes_the_best_first_cut():
    """Of one tree of depth one, the cut is the one that a search over all edges finds best."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (200, 3)).astype(float)
    y = ((x[:, 1] > 11) ^ (rng.random(200) < 0.1)).astype(float)
    t = toxicity.Trees(rounds=1, depth=1).fit(x, y)
    p = 1 / (1 + np.exp(-t.base))
    g, h = p - y, np.full(200, p * (1 - p))

    def gain(f, cut):
        left = x[:, f] < cut
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + t.ridge) if m.any() else 0.0
        return part(left) + part(~left) if min(h[left].sum(), h[~left].sum()) >= t.min_child else -1.0

    best = max(gain(f, c) for f in range(3) for c in t.edges[f])
    feature, cut, _ = t.trees[0]
    assert gain(int(feature[0]), cut[0]) == pytest.approx(best)
