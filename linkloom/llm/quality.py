"""Quality rules with risk-controlled cutoffs. DataFrame operations only.

Every text is measured once (counts of words, characters, symbols, repeated lines and repeated
five-word windows). A fixed ladder of `LEVELS` ever stricter rule sets then has, at each level, one
cutoff per metric; a text fails a level if any metric is above its cutoff there. On labelled
holdouts, each level is tested in each stratum (language): the null hypothesis is that it rejects more
than `risk` of the good texts, and its p-value is the exact binomial probability of as few false
rejections as were seen. Levels count as proven at `error` divided by all tests (strata x levels,
Bonferroni), so with probability 1 - error no chosen level rejects more than `risk` of good texts
in any stratum. Of the proven levels the one that best parts bad from good is taken; a stratum
where none is proven (too few labels) rejects by the base rules alone. The ladder is fixed
beforehand, so no data are used twice.

Defined cases: a null or blank text has no words and fails the base rules; a null language is a stratum
of its own; a document with several labels counts with its lowest; null labels don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm._shared import stored

WHITE, RISK, ERROR, LEVELS = " \t\n\x0b\x0c\r", 0.02, 0.05, 16
#: Strata whose cutoffs are broadcast; with more of them both sides are dealt by stratum.
MAX_STRATA = 100_000
#: Metric: its cutoff at the mildest and at the strictest level, geometric in between.
LADDER = {"symbols": (2.0, 0.02), "capitals": (0.75, 0.08), "word_length": (20.0, 6.0), "repeated_lines": (0.95, 0.2), "repeated_words": (0.2, 0.08)}


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of `keep` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(WHITE))
    at = lambda a, i: F.get(a, i)
    full = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    d = docs.select(
        *keep,
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1)).alias("_words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        full.alias("_lines"),
    )
    mine = [*keep, "word_chars", "n_symbols", "n_capitals"]
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(at(F.col("_words"), i + k) for k in range(5))))
    d = d.select(*mine, n.cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.when(n > 5, windows).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    mine += ["n_words", "n_dup_lines"]
    # Only texts with an equal pair of windows pay for the sort that finds the places.
    laid = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(*mine, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), laid).alias("_laid"))
    twin = lambda x, k: (F.coalesce(at(F.col("_laid"), k - 1)["h"] == x["h"], F.lit(False)) & (k > 0)) | F.coalesce(at(F.col("_laid"), k + 1)["h"] == x["h"], F.lit(False))
    d = d.select(*mine, F.sort_array(F.transform(F.filter("_laid", twin), lambda x: x["i"])).alias("_starts"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-5).cast("int").alias("last"))
    covered = F.aggregate("_starts", zero, lambda a, p: F.struct((a["sum"] + F.least(F.lit(5), p - a["last"])).alias("sum"), p.alias("last")), lambda a: a["sum"])
    return d.select(*mine, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def failing_level() -> Column:
    """The mildest level that a measured text fails; LEVELS if it passes all."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    metric = {
        "symbols": F.col("n_symbols") / n,
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "word_length": F.col("word_chars") / n,
        "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / n,
    }
    passed = lambda x, hi, lo: sum(((x <= hi * (lo / hi) ** (k / (LEVELS - 1))).cast("int") for k in range(1, LEVELS)), (x <= hi).cast("int"))
    return F.least(*(passed(metric[m], *LADDER[m]) for m in LADDER))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exactly, summed in logarithms; 1 where k is above the mean."""
    import math

    first = n * F.lit(math.log1p(-p))
    odds = math.log(p / (1 - p))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.ln((n - i + 1) / i) + F.lit(odds)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda a: a["sum"])
    return F.when(k == 0, F.exp(first)).when(k <= n * p, summed).otherwise(F.lit(1.0))


def proven_levels(holdout: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, level): the chosen level of each stratum that has a proven one. holdout: stratum, level, quality."""
    counts = holdout.groupBy("stratum", "level").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    grid = counts.select("stratum").distinct().select("stratum", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    dense = grid.join(counts, (grid["stratum"] == counts["stratum"]) & (grid["level"] == counts["level"]), "left").select(grid["stratum"], grid["level"], F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    upto = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # LEVELS + 1 rows a stratum
    whole = Window.partitionBy("stratum")
    sums = dense.select("stratum", "level", F.sum("good").over(upto).alias("k"), F.sum("good").over(whole).alias("n"), F.sum("bad").over(upto).alias("caught"), F.sum("bad").over(whole).alias("bad")).where(F.col("level") < LEVELS)
    tests = counts.agg((F.count_distinct("stratum") * LEVELS).alias("tests"))
    proven = sums.crossJoin(F.broadcast(tests)).where((F.col("n") > 0) & (binomial_tail(F.col("k"), F.col("n"), risk) <= F.lit(error) / F.col("tests")))  # tests is one row
    gain = F.col("caught") / F.greatest(F.col("bad"), F.lit(1)) - 5 * F.col("k") / F.col("n")
    return proven.groupBy("stratum").agg(F.max_by("level", F.struct(gain, -F.col("level"))).alias("chosen"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """A row per document with its counts, base_failed, level, chosen (of its stratum, if any) and kept."""
    lines = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("\n")) + 1
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"), lines.cast("long").alias("n_lines"))
    counted = measure(plain, ["doc_id", "stratum", "n_lines"])
    counted = stored(counted.withColumns({"base_failed": base_failed(), "level": failing_level()}), narrow=True)
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = proven_levels(counted.where("not base_failed").join(marks, "doc_id").select("stratum", "level", "quality"), risk, error)
    chosen = stored(chosen, few=True)  # a row per stratum; to where the counts lie while these are few, as a stratum may hold most rows
    rows = counted.join(F.broadcast(chosen) if chosen.count() <= MAX_STRATA else chosen, "stratum", "left")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("chosen").isNull() | (F.col("level") > F.col("chosen"))))
