"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a weighted lexicon, how near its hits stand to second-person
words, capitals, punctuation and obfuscation rates. The lexicon is a short list of common insults
plus words and word beginnings that labelled texts show to go with the label (log-odds of document
counts). Everything that learns from labels uses a bounded sample of labelled rows (`SAMPLE_ROWS`),
drawn by hash where it lies: the lexicon's counts are summed by Spark, the trees are fitted
by histograms on the sample's feature matrix, and the isotonic curve on scores of trees that did not
see the row. Three folds keep all of that honest: a sampled row's features come from a lexicon
counted without its fold. Then every document is scored where it lies; nothing is shuffled.

Defined cases: a null or empty text has all features zero and gets the score the model gives those;
a row with several labels counts as toxic if any is; null labels and ids teach nothing; without any
usable label the score is the share of the listed insults' hits, 0 for none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm._shared import lean, small_batches, stored

SAMPLE_ROWS, FOLDS, MIN_TOXIC_DOCS = 24_000, 3, 4
MIN_LOG_ODDS, THRESHOLD = 2.5, 0.7
#: Common insults, and words that address somebody, in English, German, French and Spanish.
INSULTS = "idiot moron stupid dumb fool loser scum trash pathetic worthless disgusting clown imbecile filth garbage vermin dummkopf trottel abschaum arschloch blödmann crétin imbécile salaud connard ordure estúpido basura imbécil tonto inútil".split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
_EDGE = "\"'()[]{}<>.,;:!?*#$%&|=-_~/\\"
#: Characters that stand for letters in masked words.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
_MIXED = re.compile(r"[^\W\d_][@$*0-9._!-]+[^\W\d_]")
PREFIXES, MEMO_WORDS = (4, 5, 6, 7, 8), 600_000
FEATURES = ("log_words", "hits", "strong", "weight", "log_hits", "max_weight", "near_you", "you", "capitals", "caps_words", "exclaims", "questions", "punctuation", "symbols", "digits", "masked", "masked_hits", "runs")


def terms(word: str) -> list[str]:
    """The word, and its beginnings marked as such."""
    return [word, *(word[:k] + "~" for k in PREFIXES if len(word) > k)]


class Words(dict):
    """Memo of words: (weight, is masked, masked word with weight, second person, all caps)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.same: dict[tuple, tuple] = {}  # nearly all words share a few descriptions

    def _weight(self, w: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms(w)), default=0.0)

    def __missing__(self, word: str) -> tuple[float, bool, bool, bool, bool]:
        if len(self) > MEMO_WORDS:
            self.clear()
        bare = word.strip(_EDGE)
        low = bare.lower()
        weight, hidden = self._weight(low), False
        masked = bool(_MIXED.search(bare))
        if masked and not weight:
            weight = self._weight(low.translate(_LEET))
            hidden = weight > 0
        got = (weight, masked, hidden, low in SECOND_PERSON, len(bare) > 1 and bare.isupper())
        self[word] = got = self.same.setdefault(got, got)
        return got


def features(text: str, words: Words) -> list[float]:
    got = list(map(words.__getitem__, text.split()))
    n = len(got)
    if not n:
        return [0.0] * len(FEATURES)
    weight, masked, hidden, you, caps = zip(*got)
    hits = [k for k, w in enumerate(weight) if w > 0]
    addressed = [k for k, y in enumerate(you) if y]
    near = 0
    if hits and addressed:
        at, gaps = np.array(addressed), np.array(hits)
        right = np.searchsorted(at, gaps)
        gap = np.minimum(np.abs(at[np.minimum(right, len(at) - 1)] - gaps), np.abs(gaps - at[np.maximum(right - 1, 0)]))
        near = float((gap <= 5).sum())
    c = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = int(c.sum())
    strong = sum(w >= 5 for w in weight)
    capitals, digits = int(c[65:91].sum()), int(c[48:58].sum())
    symbols = int(c[[35, 36, 37, 38, 42, 60, 62, 64, 124]].sum())
    punctuation = int(c[[33, 34, 39, 40, 41, 44, 45, 46, 47, 58, 59, 63]].sum())
    total = sum(weight)
    return [np.log1p(n), len(hits) / n, strong / n, total / n, np.log1p(len(hits)), max(weight), near / n, len(addressed) / n, capitals / size, sum(caps) / n, c[33] / size, c[63] / size, punctuation / size, symbols / size, digits / size, sum(masked) / n, sum(hidden) / n, text.count("!!") / n]


class Trees:
    """Gradient-boosted trees on the logistic loss, grown level by level on feature histograms."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, min_child: float = 2.0, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.min_child, self.ridge = rounds, depth, rate, bins, min_child, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], 1)
        flat = b + np.arange(m) * self.bins
        z, self.trees = np.full(n, self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for d in range(self.depth):
                first, width = 2**d - 1, m * self.bins
                key = (node[:, None] * width + flat).ravel()
                size = 2**d * width
                gs = np.bincount(key, np.repeat(g, m), size).reshape(2**d, m, self.bins)
                hs = np.bincount(key, np.repeat(h, m), size).reshape(2**d, m, self.bins)
                gl, hl = gs.cumsum(2)[:, :, :-1], hs.cumsum(2)[:, :, :-1]
                gt, ht = gs.sum(2, keepdims=True), hs.sum(2, keepdims=True)
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.min_child) | (ht - hl < self.min_child)] = 0
                best = gain.reshape(2**d, -1).argmax(1)
                for k, at in enumerate(best.tolist()):
                    f, s = divmod(at, self.bins - 1)
                    if gain[k, f, s] > 1e-6 and s < len(self.edges[f]):
                        feature[first + k], cut[first + k] = f, self.edges[f][s]
                node = node * 2 + (x[np.arange(n), feature[first + node]] >= cut[first + node])
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = -self.rate * gs / (hs + self.ridge)
            z += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                at = 2**d - 1 + node
                node = node * 2 + (x[rows, feature[at]] >= cut[at])
            z += leaf[node]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (raw score, probability) to interpolate between. Rows of one score are one block from the start."""
    at, of, count = np.unique(z, return_inverse=True, return_counts=True)
    blocks: list[list[float]] = []  # sum of y, count, sum of z
    for a, n, b in zip(at.tolist(), count.tolist(), np.bincount(of, y, len(at)).tolist()):
        blocks.append([b, n, a * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([s / c for _, c, s in blocks]), np.array([s / c for s, c, _ in blocks])


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, curve: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.clip(x[:, FEATURES.index("hits")] * 10, 0, 1)
        return np.clip(np.interp(self.trees.predict(x), *self.curve), 0, 1)


def weigh(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds weights of terms by how many toxic and clean documents hold them; the listed insults have 5 from the start."""
    odds = {t: np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)) for t, a, b in counts if a >= MIN_TOXIC_DOCS}
    return {w: 5.0 for w in INSULTS} | {t: float(w) for t, w in sorted(odds.items()) if w >= MIN_LOG_ODDS}


def _doc_terms(text: str) -> set[str]:
    return {t for w in {x.strip(_EDGE).lower() for x in text.split()} if len(w) > 2 for t in terms(w)}


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, fold, text) of about `rows` labelled documents, chosen by a hash of the id. docs: doc_id, text."""
    marked = labels.where("toxic is not null and doc_id is not null").where(allowed).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marked.count()
    cut = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * rows // max(n, 1))
    chosen = marked.where(F.xxhash64("doc_id", F.lit(5)) <= cut).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int"))
    chosen = stored(chosen, few=True)  # about `rows` narrow rows: that bounds the broadcast
    return stored(docs.where("text is not null").join(F.broadcast(chosen), "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic; allowed: which ids may teach."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, allowed, rows)
    sizes = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    toxic, clean = (sum(c for (_, y), c in sizes.items() if y == k) for k in (1, 0))
    if not toxic or not clean:
        return Model(weigh([], 0, 0), None, None)

    def count(known: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sums: dict[int, Counter] = {}
                for text, fold in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = _doc_terms(text)
                    sums.setdefault(fold, Counter()).update(own if known is None else own & known)
                for fold, c in sums.items():
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([fold] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["term", "fold", "n"])

        return run

    schema = "term string, fold int, n long"
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"f{k}") for k in range(FOLDS)]
    bad = sample.where("toxic = 1").select("text", "fold").mapInArrow(lean(count(None)), schema).groupBy("term").agg(F.sum("n").alias("n"), *by_fold).where(F.col("n") >= MIN_TOXIC_DOCS)
    found = {r.term: [r[f"f{k}"] for k in range(FOLDS)] for r in bad.collect()}  # terms of the sample alone
    good = sample.where("toxic = 0").select("text", "fold").mapInArrow(lean(count(frozenset(found))), schema).groupBy("term").agg(*by_fold)
    against = {r.term: [r[f"f{k}"] for k in range(FOLDS)] for r in good.collect()}  # of terms in `found` alone
    none = [0] * FOLDS

    def lexicon(without: int | None) -> dict[str, float]:
        use = [k for k in range(FOLDS) if k != without]
        rest = lambda y: sum(sizes.get((k, y), 0) for k in use)
        return weigh([(t, sum(v[k] for k in use), sum(against.get(t, none)[k] for k in use)) for t, v in found.items()], rest(1), rest(0))

    lexicons = [lexicon(k) for k in range(FOLDS)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words(x) for x in lexicons]
        for b in batches:
            rows = [features(t, words[f]) for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(rows, pa.list_(pa.float64()))], ["fold", "toxic", "doc_id", "x"])

    got = sample.select("text", "fold", "toxic", "doc_id").mapInArrow(lean(describe), f"fold int, toxic int, doc_id {dict(sample.dtypes)['doc_id']}, x array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))  # about `rows` rows; a fixed order makes reruns agree
    x, y, fold = np.array([r.x for r in got]), np.array([r.toxic for r in got], float), np.array([r.fold for r in got])
    z = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            z[fold == k] = Trees().fit(x[fold != k], y[fold != k]).predict(x[fold == k])
    return Model(lexicon(None), Trees().fit(x, y), isotonic(z, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of the sample and the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.lexicon)
        for b in batches:
            x = np.array([features(t.as_py(), words) for t in pc.fill_null(b.column(1), "")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(lean(run), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double")
