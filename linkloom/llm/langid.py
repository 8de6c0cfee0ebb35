"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per document:
  text      trigram likelihoods of the whole text, from a model fitted on a bounded labelled sample;
  declared  the declared markup language (html lang, or a table's language column): it says the
            truth with a probability estimated for each declared language over all documents;
  suffix    the country suffix of the address (.fr, .de, ...), estimated the same way;
  host      a prior per host, smoothed towards its suffix's mix and that towards the mix of all documents
            (Dirichlet pseudo-counts), from sums over all documents grouped by host.
Texts are read once for their likelihoods; everything after that is grouped aggregation and
arithmetic on a narrow table, so a host with a third of all rows is summed up where it lies.

A document is rejected (language null) if its text has too few letters to tell, or no language
reaches `min_posterior`, or its letters fit no language of the model better than noise does.

Defined cases: null and empty texts have no text evidence and are rejected; a null or unknown
declared language, host or suffix is no evidence; with no labelled sample at all every document is
rejected; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm._shared import ROW, lean, row_key, small_batches, stored, without, worker_keeps

#: Sampled texts per language for the fit; cells of the model (64 MB): with more than 64 languages trigrams share buckets.
SAMPLE_DOCS, MODEL_CELLS = 1500, 1 << 24
BUCKETS, MIN_POSTERIOR, MIN_LETTERS = 1 << 18, 0.6, 3
#: Pseudo-counts of the priors, and how many independent trigrams a text counts as at most.
HOST_WEIGHT, SUFFIX_WEIGHT, MAX_EVIDENCE = 20.0, 50.0, 200.0
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the letters, other bytes as one space; those within spaces are left out."""
    t = b" " + b" ".join(text.translate(_LOWER).split()) + b" "
    if len(t) < 4:
        return np.zeros(0, np.int64)
    b = np.frombuffer(t, np.uint8).astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(14)).astype(np.int64)  # 18 bits


class TextModel:
    """Mean log-likelihood ratio of a text's trigrams under each language, against a flat model."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: language x bucket, a power of two of these, at most BUCKETS."""
        self.languages = languages
        self.shift = (BUCKETS // counts.shape[1]).bit_length() - 1
        smooth = counts + 0.05
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)  # bucket x language
        self.noise = np.float32(np.log(1 / 20_000))

    def score(self, text: bytes) -> tuple[int, list[float]]:
        """(letters, log-likelihood per trigram of each language above noise)."""
        g = trigrams(text) >> self.shift
        if not len(g):
            return 0, [0.0] * len(self.languages)
        total = np.zeros(len(self.languages))
        for k in range(0, len(g), 1 << 16):
            total += self.table[g[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return len(g), (total / len(g) - self.noise).tolist()


def fit_text_model(docs: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text", per_language: int = SAMPLE_DOCS) -> TextModel:
    """Fit on whole texts of each labelled language, about per_language of them (all, if there are fewer).

    The sample is a range of a hash of id and text, as wide as the language's share asks for, so it
    is drawn where the texts lie. The executors count; the driver gets a row per language and bucket.
    """
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    marked = docs.select(label.cast("string").alias("language"), F.col(text_col).cast("string").alias("text"), h.alias("h")).where("language is not null")
    found = marked.groupBy("language").count().collect()  # a row per language
    languages = sorted(r.language for r in found)
    if not found:
        return TextModel([], np.zeros((0, BUCKETS)))
    buckets = BUCKETS
    while buckets > 256 and buckets * len(languages) > MODEL_CELLS:
        buckets //= 2
    counts = np.zeros((len(languages), buckets))
    cut = F.create_map(*(F.lit(x) for r in found for x in (r.language, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * per_language // r["count"]))))
    sample = marked.where("text is not null").where(F.col("h") <= cut[F.col("language")])
    shift = (BUCKETS // buckets).bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for name, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                sums[name] = sums.get(name, 0) + np.bincount(trigrams(text) >> shift, minlength=buckets)
            for name, x in sums.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(x[at], pa.int64())], ["language", "bucket", "n"])

    row_of = {name: k for k, name in enumerate(languages)}
    for r in sample.select("language", "text").mapInArrow(lean(count), "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row_of[r.language], r.bucket] = r.n
    return TextModel(languages, counts)


def text_evidence(docs: DataFrame, model: TextModel, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of `keep` (name: column) with letters and loglik (array, per language, per trigram)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_CELLS floats
    plain = docs.select(F.col(text_col).cast("string").alias("_text"), *(c.alias(n) for n, c in keep.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("langid")
        m = shared.value
        for b in batches:
            got = [m.score(t.as_py()) for t in pc.fill_null(b.column(0).cast(pa.large_binary()), b"")]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([n for n, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.float64()))], [*b.schema.names[1:], "letters", "loglik"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[1:])
    return plain.mapInArrow(lean(run), f"{kinds}, letters long, loglik array<double>")


def _posterior(df: DataFrame, logs: list[Column], name: str) -> DataFrame:
    """df with an array of probabilities from log weights; in steps, so that each number is computed once a row."""
    n = range(len(logs))
    df = df.withColumns({f"_f{k}": logs[k] for k in n})
    df = df.withColumn("_top", F.greatest(*(f"_f{k}" for k in n)) if len(logs) > 1 else F.col("_f0"))
    df = df.withColumns({f"_e{k}": F.exp(F.col(f"_f{k}") - F.col("_top")) for k in n})
    df = df.withColumn("_sum", sum((F.col(f"_e{k}") for k in n), F.lit(0.0)))
    df = df.withColumn(name, F.array(*(F.col(f"_e{k}") / F.col("_sum") for k in n)))
    return df.drop("_top", "_sum", *(f"_{x}{k}" for k in n for x in "fe"))


def identify(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, min_posterior: float = MIN_POSTERIOR, teaches: Column | None = None) -> DataFrame:
    """A row per document: doc_id, language (null: rejected), posterior, letters, evidence (array, by language).

    teaches: which rows count for the priors of hosts, suffixes and declarations (all); those the text model was not fitted on.
    """
    none = F.lit(None).cast("string")
    keep = {"doc_id": F.col(id_col), "declared": none if declared is None else F.lower(declared.cast("string")), "host": none if host is None else host.cast("string"), "suffix": none if suffix is None else suffix.cast("string"), "teaches": F.lit(True) if teaches is None else teaches}
    rows = stored(text_evidence(docs, model, keep, text_col), narrow=True)
    names, n = model.languages, len(model.languages)
    if not n:
        return rows.select("doc_id", none.alias("language"), F.lit(0.0).alias("posterior"), "letters", F.array().cast("array<double>").alias("evidence"))
    weight = F.least(F.col("letters").cast("double"), F.lit(MAX_EVIDENCE))
    heard = [F.coalesce(F.get(F.col("loglik"), F.lit(k)), F.lit(0.0)) * weight for k in range(n)]
    rows = _posterior(rows, heard, "alone").withColumn("alone", F.when(F.col("letters") >= MIN_LETTERS, F.col("alone")))
    each = lambda c: [F.sum(F.get(F.col("alone"), F.lit(k))).alias(f"{c}{k}") for k in range(n)]

    # Priors from sums of text posteriors: over all (one row), by suffix smoothed towards that, by host towards its suffix.
    seen = rows.where("alone is not null and teaches")
    total = seen.agg(*each("g"), F.count("*").alias("n")).first()
    base = [((total[f"g{k}"] or 0.0) + 1) / (total["n"] + n) for k in range(n)]
    by_suffix = seen.where("suffix is not null").groupBy("suffix").agg(*each("s"), F.count("*").alias("n"))
    by_suffix = stored(by_suffix.select("suffix", *(((F.col(f"s{k}") + SUFFIX_WEIGHT * base[k]) / (F.col("n") + SUFFIX_WEIGHT)).alias(f"s{k}") for k in range(n))), few=True)
    by_host = seen.where("host is not null").groupBy("host").agg(F.max("suffix").alias("suffix"), *each("h"), F.count("*").alias("n")).join(by_suffix, "suffix", "left")
    by_host = stored(by_host.select("host", *(F.ln((F.col(f"h{k}") + HOST_WEIGHT * F.coalesce(f"s{k}", F.lit(base[k]))) / (F.col("n") + HOST_WEIGHT)).alias(f"h{k}") for k in range(n))), few=True)
    # P(declared | language) in proportion to P(language | declared) / P(language): how a declaration's texts read.
    by_declared = seen.where("declared is not null").groupBy("declared").agg(*each("d"), F.count("*").alias("n"))
    by_declared = stored(by_declared.select("declared", *(F.ln((F.col(f"d{k}") + HOST_WEIGHT * base[k]) / (F.col("n") + HOST_WEIGHT) / base[k]).alias(f"d{k}") for k in range(n))), few=True)
    # Rows without a host match none; dealt by a hash of theirs they do not meet in one task. A hot host Spark splits by size.
    salt = F.when(F.col("host").isNull(), 1 + F.pmod(F.xxhash64("doc_id", "loglik"), F.lit(1 << 20))).otherwise(0)
    salted = rows.withColumns({"salt": salt, "host": F.coalesce("host", F.lit(""))})
    wide = salted.join(by_host.withColumn("salt", F.lit(0).cast("long")), ["host", "salt"], "left").join(by_suffix, "suffix", "left").join(by_declared, "declared", "left")
    logs = [heard[k] + F.coalesce(F.col(f"h{k}"), F.ln(f"s{k}"), F.lit(math.log(base[k]))) + F.coalesce(f"d{k}", F.lit(0.0)) for k in range(n)]
    fused = _posterior(wide.select("doc_id", "letters", "loglik", *(x.alias(f"x{k}") for k, x in enumerate(logs))), [F.col(f"x{k}") for k in range(n)], "evidence")
    judged = fused.select("doc_id", "letters", "evidence", F.array_max("loglik").alias("fit"))
    best = F.array_max("evidence")
    name = F.element_at(F.array(*map(F.lit, names)), F.array_position("evidence", best).cast("int"))
    fine = (F.col("letters") >= MIN_LETTERS) & (best >= min_posterior) & (F.col("fit") > 0)
    return judged.select("doc_id", F.when(fine, name).alias("language"), best.alias("posterior"), "letters", "evidence")


def drop_rejected(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", **evidence) -> DataFrame:
    """docs with the same columns, without the documents that `identify` rejects."""
    keyed = docs.withColumn(ROW, row_key(docs, id_col))
    gone = identify(keyed, model, ROW, text_col, **evidence).where("language is null").select("doc_id.id", "doc_id.hash")
    return without(docs, gone, id_col)
