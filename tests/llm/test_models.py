"""Toxicity and language models."""

import random

import numpy as np
import pytest
from conftest import prose  # noqa: F401
from pyspark.sql import functions as F

from linkloom.llm import langid, toxicity


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = toxicity.Trees().fit(x[:2000], y[:2000])
    assert ((t.predict(x[2000:]) > 0) == y[2000:]).mean() > 0.95


@pytest.mark.parametrize("values", [400, 25, 1])
def test_isotonic_is_the_monotone_fit(values):
    """Against the minimax formula over the distinct scores: the largest mean that starts no later, of the least that end no earlier."""
    rng = np.random.default_rng(values)
    z = np.round(rng.random(400) * values) / values if values < 400 else rng.random(400)
    y = (rng.random(400) < z).astype(float)
    at, p = toxicity.isotonic(z, y)
    assert (np.diff(at) > 0).all() and (np.diff(p) > 0).all()
    u = np.unique(z)
    total, count = np.array([y[z == v].sum() for v in u]), np.array([(z == v).sum() for v in u])
    mean = lambda j, k: total[j : k + 1].sum() / count[j : k + 1].sum()
    want = [max(min(mean(j, k) for k in range(i, len(u))) for j in range(i + 1)) for i in range(len(u))]
    assert np.allclose(np.unique(np.round(want, 9)), np.round(p, 9))
    assert np.allclose([np.average(z[np.isin(z, u[np.isclose(want, q)])]) for q in p], at)


def test_tied_scores_are_pooled():
    at, p = toxicity.isotonic(np.zeros(10), np.arange(10) % 2)
    assert at.tolist() == [0] and p.tolist() == [0.5]


def toxic_table(spark, n=1200):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        bad = k % 7 == 0
        words = prose(k, r.randint(20, 60)).split()
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grubbl", "snarfer", "idiot", "You moron"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = toxic_table(spark)
    allowed = F.col("doc_id") % 3 != 1
    got = toxicity.score(docs, toxicity.fit(docs, labels, allowed)).join(labels, "doc_id").where(~allowed).collect()
    bad, good = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([s >= 0.7 for s in bad]) > 0.9 and np.mean([s >= 0.7 for s in good]) < 0.02


def test_reruns_agree(spark):
    docs, labels = toxic_table(spark, 300)
    one, two = ({r.doc_id: r.score for r in toxicity.score(d, toxicity.fit(d, labels, F.lit(True))).collect()} for d in (docs, docs.repartition(7)))
    assert one == two


def test_messy_rows_and_no_labels(spark, messy, nothing):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(messy.select("doc_id", "text"), none, F.lit(True))
    got = toxicity.score(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, model).count() == 0


def test_features_see_masked_insults():
    words = toxicity.Words({"idiot": 5.0})
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are such an 1d10t, you i.d.i.o.t!", words)))
    assert f["hits"] == pytest.approx(2 / 7) and f["masked_hits"] > 0 and f["near_you"] > 0
    assert toxicity.features("", words) == [0.0] * len(toxicity.FEATURES)


EN = "the weather was fine and they went with the children to the river because it had been raining for weeks".split()
FR = "le temps était beau et ils sont allés avec les enfants à la rivière parce que il avait plu pendant des semaines".split()


def tongue(seed, words, n=30):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def language_table(spark):
    rows = [(k, tongue(k, EN if k % 2 else FR), "en" if k % 2 else "fr", "news.fr" if k % 2 == 0 else "site.uk") for k in range(400)]
    rows += [(1000, tongue(1, FR), "en", "news.fr"), (1001, "12345 !!! ###", "en", "site.uk"), (1002, None, "fr", None), (1003, "", None, None), (1004, tongue(9, EN), None, None)]
    rows += [(1005, "il avait plu", None, "news.fr"), (1005, "il avait plu", None, "news.fr"), (None, tongue(3, EN), "xx", "odd")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")


def identify(docs):
    model = langid.fit_text_model(docs, F.col("lang"))
    return langid.identify(docs, model, declared=F.col("lang"), host=F.col("host"), suffix=F.regexp_extract("host", r"\.([a-z]+)$", 1))


def test_languages(spark):
    docs = language_table(spark)
    got = identify(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.language for r in got}
    assert all(by[k] == ("en" if k % 2 else "fr") for k in range(400))
    assert by[1000] == "fr" and by[1004] == "en" and by[None] == "en"
    assert by[1001] is None and by[1002] is None and by[1003] is None
    assert [r.language for r in got if r.doc_id == 1005] == ["fr", "fr"]


def test_host_prior_decides_between_equal_texts(spark):
    rows = [(k, tongue(k, EN), "en", "a") for k in range(60)] + [(100 + k, tongue(k, FR), "fr", "b") for k in range(60)] + [(500, "xyzzy", None, "a"), (501, "xyzzy", None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = langid.fit_text_model(docs, F.col("lang"))
    got = {r.doc_id: r.evidence for r in langid.identify(docs, model, host=F.col("host")).collect()}
    en = model.languages.index("en")
    assert got[500][en] > got[501][en]


def test_rejected_go_and_columns_stay(spark, messy, nothing):
    docs = language_table(spark)
    model = langid.fit_text_model(docs, F.col("lang"))
    kept = langid.drop_rejected(docs, model, declared=F.col("lang"), host=F.col("host"))
    assert kept.schema == docs.schema and kept.where("doc_id in (1001, 1002, 1003)").count() == 0 and kept.count() == docs.count() - 3
    assert langid.drop_rejected(messy, model).schema == messy.schema
    assert langid.drop_rejected(nothing, model).count() == 0
    empty = langid.fit_text_model(nothing, F.col("lang"))
    assert langid.identify(messy, empty).where("language is not null").count() == 0


def test_pages_by_markup_and_address(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.example.{'fr' if k % 2 == 0 else 'co'}/", f'<html lang="{"en" if k % 2 else "fr"}"><p>{tongue(k, EN if k % 2 else FR)}</p></html>') for k in range(80)], "page_id long, url string, html string")
    x = pages.select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"), F.regexp_extract("html", 'lang="([^"]+)"', 1).alias("declared"), F.parse_url("url", F.lit("HOST")).alias("host"))
    model = langid.fit_text_model(x, F.col("declared"), "page_id")
    got = langid.identify(x, model, "page_id", declared=F.col("declared"), host=F.col("host"), suffix=F.regexp_extract("host", r"\.([a-z]+)$", 1)).collect()
    assert all(r.language == ("en" if r.doc_id % 2 else "fr") for r in got)
