"""Thin queries over the operators of this subpackage: one per operator, with production parameters, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontaminate, langid, linededup, mixing, pii, piece_rounds, quality, sharding, simhash, token_frames, toxicity, turn_repair
from linkloom.llm._shared import documents, shared_dir


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    token_frames.write_token_frames(documents(spark, sf_dir), out, tokenizer_path(), end_id=2)
    return token_frames.read_token_frames(spark, out).drop("ids")


def op2_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), allowed=fold != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.find_contamination(documents(spark, sf_dir), benchmark))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(documents(spark, sf_dir)))


def op6_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.shard_by_bytes(documents(spark, sf_dir))
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text, language) of web pages: the text of their paragraphs, and the language that the markup declares."""
    html = F.col("html").cast("string")
    inner = F.array_join(F.regexp_extract_all(html, F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), F.lit(1)), " ")
    text = F.regexp_replace(inner, r"<[^>]*>|&#?\w+;", " ")
    language = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    return pages.select(F.col("page_id").cast("long").alias("doc_id"), text.alias("text"), F.when(language != "", language).alias("language"))


def language_evidence(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[langid.TextModel, dict]:
    """Model and evidence for documents: the language column is the declared one, the source the host.

    The text model learns from web pages, by their markup language, and from an eighth of the documents; the
    priors of sources and declared languages count the other seven, so no label is used twice.
    """
    eighth = F.coalesce(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(8)) == 0, F.lit(False))
    own = docs.where(eighth).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("language"))
    model = langid.fit_text_model(own.union(page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))), F.col("language"))
    host = F.col("source").cast("string")
    suffix = F.regexp_extract(host, r"\.([A-Za-z]{2,})$", 1)
    return model, {"declared": F.col("lang"), "host": host, "suffix": F.when(suffix != "", F.lower(suffix)), "teaches": ~eighth}


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, evidence = language_evidence(spark, docs, sf_dir)
    return langid.identify(docs, model, **evidence).select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "letters", F.col("language").isNotNull().alias("kept"))


def op11_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = piece_rounds.encode(documents(spark, sf_dir), path).select("doc_id", "ids")
    back = piece_rounds.decode(ids, path)
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = turn_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turn_repair.digest(rows, copies=copies).select(
        F.col("c").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


QUERIES = {f.__name__: f for f in (op1_token_frames, op2_boosted_toxicity, op3_benchmark_spans, op4_simhash_groups, op5_contextual_pii, op6_bloom_lines, op7_risk_controlled_rules, op8_flow_mix, op9_byte_shards, op10_language_id, op11_piece_rounds, op12_turn_repair)}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_table() -> list[int]:
    """The table of CRC-32 (reflected polynomial 0xEDB88320), by its rule."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ 0xEDB88320 * (k & 1)
        out.append(k)
    return out


def _levels_passed(metric: str, high: float, low: float) -> str:
    """SQL for how many levels of the ladder a metric passes."""
    cuts = [high if k == 0 else high * (low / high) ** (k / (quality.LEVELS - 1)) for k in range(quality.LEVELS)]
    return f"len(list_filter([{', '.join(f'{c!r}::DOUBLE' for c in cuts)}], lambda c: {metric} <= c))"


def _rules_sql() -> str:
    n = "greatest(n_words, 1)"
    metric = {"symbols": f"n_symbols / {n}", "capitals": "n_capitals / greatest(word_chars, 1)", "word_length": f"word_chars / {n}", "repeated_lines": "n_dup_lines / n_lines", "repeated_words": f"n_repeat_words / {n}"}
    level = ", ".join(_levels_passed(metric[m], *quality.LADDER[m]) for m in quality.LADDER)
    pmf = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}::DOUBLE) + (n - i) * ln(1 - {p}::DOUBLE))".format(p=quality.RISK)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || lang, '') AS stratum, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (
  SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, len(string_split(text, chr(10))) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, least({level}) AS level FROM c),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
cnt AS (SELECT stratum, level, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM j JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
grid AS (SELECT s.stratum, k AS level, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM (SELECT DISTINCT stratum FROM cnt) s CROSS JOIN range(0, {quality.LEVELS + 1}) r(k) LEFT JOIN cnt ON cnt.stratum = s.stratum AND cnt.level = k),
sums AS (SELECT stratum, level, sum(good) OVER w AS k, sum(good) OVER (PARTITION BY stratum) AS n, sum(bad) OVER w AS caught, sum(bad) OVER (PARTITION BY stratum) AS bad FROM grid WINDOW w AS (PARTITION BY stratum ORDER BY level ROWS UNBOUNDED PRECEDING)),
tail AS (SELECT *, CASE WHEN k <= n * {quality.RISK}::DOUBLE THEN (SELECT sum({pmf}) FROM range(0, CAST(k AS BIGINT) + 1) g(i)) ELSE 1 END AS p FROM sums WHERE level < {quality.LEVELS} AND n > 0),
chosen AS (SELECT stratum, level AS chosen FROM tail WHERE p <= {quality.ERROR}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM cnt) * {quality.LEVELS}) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught / greatest(bad, 1) - 5 * k / n DESC, level) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (chosen IS NULL OR level > chosen) AS kept
FROM j LEFT JOIN chosen USING (stratum)"""


#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_benchmark_spans": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_bloom_lines": r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM doc),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line),
gone AS (
  SELECT key, max(doc_id) AS keep_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE g.key IS NOT NULL AND g.keep_doc <> k.doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE g.key IS NULL OR g.keep_doc = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN gone g ON g.key = k.key GROUP BY k.doc_id""",
    "op7_risk_controlled_rules": _rules_sql(),
    "op9_byte_shards": f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, size, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, size - 1), lambda k: CAST(('0x' || substr(h, 2 * k + 1, 2)) AS BIGINT))) AS b FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(b, lambda a, x: xor(CAST({_crc_table()} AS BIGINT[])[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS text_crc32 FROM b),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(least(7, start * 8 // total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
}
