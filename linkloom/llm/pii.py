"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

The base finds e-mail addresses, IP addresses, card and phone numbers by their form. They are the seeds of a
bootstrap (in the manner of pattern-instance learning); a fifth kind, secrets, has no base form and is seeded by long
values that are assigned to a name such as `token`. The words and marks around seeds become lexical
patterns: a kind with the two words before, with the word before and the marks in between, or with the words
before and after. Any token of identifier form (digits or an @ in it, of sufficient length), or any
run of digit groups, in such a place is an instance. Spark scores the bipartite graph of patterns and instances
iteratively: a pattern's confidence is the lower bound (Wilson, one-sided 5 %) of the share of its distinct
instances believed to be of its kind. Seeds count 1, seeds of other kinds and what fails the check of its
form (a wrong card digit) 0, others a half at first, then as far as the patterns around
them vouch for them. Instances believed in one round induce patterns in the next as seeds do. Occurrences of
unseen identifiers under patterns of high confidence become spans.

All counts cover all documents. Texts are read once; what moves are seeds and candidates, summed
up by (pattern, instance) before any shuffle.

Defined cases: a null or empty text has no spans; spans are in code points, end exclusive; base
spans always stay; seeded secrets are told apart from added spans, which only trusted patterns find; an added span never
overlaps a base or seeded one, of those that overlap the longer stays; an empty table gives no rows; words of any length
count whole; more than MAX_MARKS different marks part a word from the identifier; repeated rows are each searched;
null ids stay null; without seeds nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm._shared import lean, small_batches, stored

KINDS = ("email", "ip", "card", "phone", "secret")
MIN_SEEDS, MIN_CONFIDENCE, ROUNDS, PRIOR, SURE, MAX_MARKS = 4, 0.8, 4, 0.5, 1.645, 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
# A run of digits that cannot start a match cannot start one further inside, so runs are tried at their start alone.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_LUHN = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]]
#: A candidate: a white-space-delimited token with an @ in it, or one of at least five digits.
_TOKEN = re.compile(r"[0-9@]\S*")
#: Another: groups of digits, at least five digits together, joined by single spaces, dots, hyphens and brackets.
_GROUPS = re.compile(r"(?<![^\s\"'\[{<])[(\[]?[0-9]++(?:(?:[ .-]|[)\]][ .-]?|[ .-]?[(\[])[0-9]++)+(?![^\s\"')\]}>.,;:!?])")
_EDGE = "\"'()[]{}<>.,;:!?*#$%&|="
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")
_AGAIN = re.compile(r"(.)\1+", re.S)
#: Names whose assigned values seed the secrets, if these have 16 characters or more.
_SECRET = re.compile(r"(?i)(?<![^\W_])(?:token|secret|passwd|password|pwd|api_?key|apikey|access_?key|private_?key|auth)\s*[:=]\s*[\"']?([A-Za-z0-9+/_=-]{16,})")

def luhn(digits: str) -> bool:
    return sum(_LUHN[k % 2][ord(c) - 48] for k, c in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, each @ tried with the longest local part before it."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _fold(word: str) -> str:
    return word.strip(_EDGE).lower()


def contexts(text: str, words: list[tuple[int, int]], start: int, end: int) -> list[str]:
    """Lexical patterns of a place: two words before; one before and the marks between; one before and one after.

    words: the places of the text's words. A very long word stands as its hash.
    """
    k = bisect_right(words, (start,)) - 1
    while k >= 0 and words[k][1] > start:
        k -= 1
    if k < 0:
        return []
    word = lambda j: w.lower() if len(w := text[words[j][0] : words[j][1]]) <= 64 else f"#{xxhash.xxh64_hexdigest(w.lower().encode('utf-8', 'replace'))}"
    own = word(k)
    out = [f"{word(k - 1)} {own} _"] if k else []
    marks = _AGAIN.sub(r"\1", _SPACE.sub(" ", text[words[k][1] : start]))
    if len(marks) <= MAX_MARKS:
        out.append(f"{own}{marks}_")
    after = bisect_left(words, (end,))
    if after < len(words):
        out.append(f"{own} _ {word(after)}")
    return out


def failing(token: str) -> bool:
    """Whether a token has a base form but fails its check."""
    digits = _DIGITS.sub("", token)
    if _CARD.fullmatch(token):
        return 12 <= len(digits) <= 19 and not luhn(digits)
    return bool(_IP.fullmatch(token) or _PHONE.fullmatch(token))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens, groups of digits and assigned secrets that no base span touches, the marks around tokens left off; a token may lie in a group."""
    digits = lambda x: sum(map(x.count, "0123456789"))
    found = {m.span() for m in _GROUPS.finditer(text) if digits(m.group()) >= 5}
    for m in _TOKEN.finditer(text):
        begin = m.start()
        while begin and not text[begin - 1].isspace():
            begin -= 1
        token = text[begin : m.end()]
        if "@" not in token and digits(token) < 5:
            continue
        start = begin + len(token) - len(token.lstrip(_EDGE))
        found.add((start, start + len(token.strip(_EDGE))))
    if "=" in text or ":" in text:
        found.update(m.span(1) for m in _SECRET.finditer(text))
    out, k = [], 0
    for start, end in sorted(found):
        while k < len(base) and base[k][2] <= start:
            k += 1
        if end > start and (k == len(base) or base[k][0] >= end):
            out.append((start, end))
    return out


def _instance(text: str) -> int:
    return xxhash.xxh64_intdigest(_fold(text).encode("utf-8", "replace")) - (1 << 63)


_FOUND = "row long, doc_id long, base array<struct<start:long,kind:int,end:long,instance:long,contexts:array<string>>>, other array<struct<start:long,end:long,instance:long,seed:int,failed:boolean,contexts:array<string>>>"
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("instance", pa.int64()), ("contexts", pa.list_(pa.string()))]))
_OTHER = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("seed", pa.int32()), ("failed", pa.bool_()), ("contexts", pa.list_(pa.string()))]))


def describe(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans and candidates of a text, with the patterns around them."""
    found = base_spans(text)
    others = candidates(text, found)
    if not found and not others:
        return [], []
    words = [m.span() for m in _WORD.finditer(text)]
    secrets = {m.span(1) for m in _SECRET.finditer(text)} if others else ()
    base = [{"start": s, "kind": k, "end": e, "instance": _instance(text[s:e]), "contexts": contexts(text, words, s, e)} for s, k, e in found]
    return base, [{"start": s, "end": e, "instance": _instance(text[s:e]), "seed": 4 if (s, e) in secrets else None, "failed": failing(text[s:e]), "contexts": contexts(text, words, s, e)} for s, e in others]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and candidates of each document, with the patterns around them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, other = zip(*(describe(x.as_py()) for x in pc.fill_null(b.column(2), ""))) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, _BASE), pa.array(other, _OTHER)], ["row", "doc_id", "base", "other"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), _FOUND)


def lower_bound(good: Column, n: Column, z: float = SURE) -> Column:
    """Wilson's lower bound of a share."""
    p = good / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def score_patterns(found: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(context, kind, confidence) of the patterns to trust, from the graph of patterns and instances."""
    sown = found.select(F.explode("base").alias("x")).select("x.instance", F.col("x.kind").alias("seed"), F.lit(False).alias("failed"), F.explode("x.contexts").alias("context"))
    others = found.select(F.explode("other").alias("x")).select("x.instance", "x.seed", "x.failed", F.explode("x.contexts").alias("context"))
    # The graph: one edge for each pattern and instance.
    graph = stored(sown.union(others).groupBy("context", "instance").agg(F.max("seed").alias("seed"), F.max("failed").alias("failed")), few=True)
    known = graph.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    belief, trusted = stored(known, few=True), None
    for _ in range(rounds):
        told = graph.join(belief.where(F.col("belief") >= min_confidence).select("instance", "kind"), "instance")
        support = stored(told.groupBy("context", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds).select("context", "kind"), few=True)
        edges = graph.join(support, "context").join(belief, ["instance", "kind"], "left")
        worth = F.coalesce("belief", F.when(F.col("failed") | F.col("seed").isNotNull(), 0.0).otherwise(PRIOR))
        trusted = stored(edges.groupBy("context", "kind").agg(F.sum(worth).alias("good"), F.count("*").alias("n")).select("context", "kind", lower_bound(F.col("good"), F.col("n")).alias("confidence")), few=True)
        # What several patterns say of an instance: one minus the chance that all of them err.
        open_ = graph.where("seed is null and not failed").select("context", "instance").join(trusted, "context")
        voices = open_.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.least(F.greatest("confidence", F.lit(0.0)), F.lit(0.99)))))).alias("belief"))
        belief = stored(known.union(voices.join(known, ["instance", "kind"], "left_anti").select("instance", "kind", "belief")), few=True)
    return stored(trusted.where(F.col("confidence") >= min_confidence), few=True) if trusted is not None else known.select(F.lit("").alias("context"), "kind", F.col("belief").alias("confidence")).limit(0)


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a document's found spans that overlap, the seeds, then the longer ones (the first of equal ones)."""
    for b in batches:
        out = []
        for spans in b.column(1).to_pylist():
            starts, kept = [], []
            for x in sorted(spans, key=lambda x: (not x["seeded"], x["start"] - x["end"], x["start"])):
                k = bisect_right(starts, x["start"])
                if (k == 0 or kept[k - 1]["end"] <= x["start"]) and (k == len(kept) or x["end"] <= kept[k]["start"]):
                    starts.insert(k, x["start"])
                    kept.insert(k, x)
            out.append(kept)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, b.column(1).type)], b.schema.names)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **scoring) -> DataFrame:
    """A row per document: doc_id, and arrays of (start, kind, end): base spans, seeded ones (secrets assigned to a name, by form
    alone), and added ones, which only trusted patterns found.
    """
    found = stored(scan(docs, id_col, text_col), narrow=True)
    trusted = score_patterns(found, **scoring)
    other = found.select("row", F.explode("other").alias("x")).select("row", "x.*")
    seeds = other.where("seed is not null").select("row", "start", "end", F.col("seed").alias("kind"), F.lit(True).alias("seeded"))
    hits = other.where("seed is null").select("row", "start", "end", F.explode("contexts").alias("context")).join(trusted, "context")
    best = hits.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind")).withColumn("seeded", F.lit(False))
    more = seeds.union(best).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "seeded")).alias("more"))  # of one document
    more = more.mapInArrow(lean(_longest), more.schema)
    spans = lambda a, keep=None: F.transform(F.filter(a, keep) if keep else a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    parts_of = [F.coalesce(spans("more", keep), none).alias(name) for name, keep in (("seeded", lambda x: x["seeded"]), ("added", lambda x: ~x["seeded"]))]
    return found.select("row", "doc_id", spans("base").alias("base")).join(more, "row", "left").select("doc_id", "base", *parts_of)


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans: base ones by kind and hash, and all of them; n_seeded, n_added of the method's spans; n_secret, n_spans of all."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(F.sort_array(a), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda spans, k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    counts = [of("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    every = F.concat("base", "seeded", "added")
    more = [F.size("seeded").alias("n_seeded"), F.size("added").alias("n_added"), of(every, 4).alias("n_secret"), F.size(every).alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined(every).alias("spans"), *(c.cast("long").alias(n) for c, n in zip(more, ("n_seeded", "n_added", "n_secret", "n_spans"))))
