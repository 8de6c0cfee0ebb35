"""Benchmark decontamination by an FM-index for every shard of training text.

Test items become windows of `window` words (an item of fewer words is one window). A task takes
its documents in shards of bounded size; for each it builds an FM-index over the shard's word ids
(suffix array by prefix doubling, Burrows-Wheeler transform, wavelet tree with rank counters,
sampled suffix positions), finds the interval of every window by backward search, all windows at
once, locates the occurrences by walking back to sampled positions, and merges them into spans.

Before a shard is indexed, each maximal run of words that no test item holds becomes one separator, as
do runs too short for the shortest window: no occurrence can touch those, so the index answers
exactly as one over the whole text would. Words of any spelling outside the test set count for
n_words alone. Test items are packed into blocks of bounded size, written to shared storage and
taken one after the other against each shard, so the test set may be of any size; nothing is
shuffled and no document leaves its task.

Defined cases: a null or empty text has no words; a null item text has no windows; a null item id
is listed as the empty string; items that share an id count once in a document's list; repeated
documents are each judged alone; an empty test set or table gives zero hits or no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._shared import lean, shared_dir, small_batches, worker_keeps

WINDOW, SAMPLE = 10, 16
#: Bytes of text in a shard (or one document, if longer) and of test items in a block.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
#: A-Z folded; every byte outside [0-9a-z] and non-ASCII becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WaveletTree:
    """Rank queries over integers below 2**bits, one bit vector a level, counters at each position block."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            bit = values >> b & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(values) - int(ones[-1])
            self.levels.append((ones, zeros))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            one = (symbol >> b & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            value = value * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return value


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; the text ends with a unique smallest symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1 if k < n else 0
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Over symbols 1..sigma-1; 0 is the end mark that the index adds."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))).astype(np.int64)
        self.tree = WaveletTree(bwt, max(1, int(sigma - 1).bit_length()))
        sampled = sa % sample == 0
        self.order = np.concatenate(([0], np.cumsum(sampled)))
        self.places = sa[sampled]
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [from, to) of the patterns, the rows of a matrix."""
        m, length = patterns.shape
        lo, hi, live = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.arange(m)
        for k in range(length - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.below[c] + self.tree.rank(c, lo[live])
            hi[live] = self.below[c] + self.tree.rank(c, hi[live])
            dead = live[lo[live] >= hi[live]]
            lo[dead] = hi[dead] = 0
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one are counted."""
        out, steps, live, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(live):
            hit = self.order[at + 1] > self.order[at]
            out[live[hit]] = self.places[self.order[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            c = self.tree.access(at)
            at = self.below[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Block:
    """Windows of some test items: a vocabulary, and by length the windows with the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for k, (_, text) in enumerate(items):
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 2) for x in words_of(text)]  # 0 ends the text, 1 parts runs
            size = min(window, len(w))
            for s in range(len(w) - size + 1 if w else 0):
                found.setdefault(size, {}).setdefault(tuple(w[s : s + size]), set()).add(k)
        self.windows = {size: (np.array(list(x), np.int64), [np.array(sorted(v)) for v in x.values()]) for size, x in sorted(found.items())}

    def spans(self, docs: list[bytes]) -> list[tuple[np.ndarray, set[str]]]:
        """For each document the merged spans [start, end) of hit words, and the items found."""
        none = [(np.zeros((0, 2), np.int64), set()) for _ in docs]
        if not self.windows:
            return none
        shortest = min(self.windows)
        own = [np.fromiter(map(self.vocabulary.get, words_of(d), repeat(1)), np.int32) for d in docs]
        counts = np.array([len(x) for x in own], np.int64)
        ids = np.concatenate(own or [np.zeros(0, np.int32)])
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), counts)
        n = len(ids)
        if not n:
            return none
        begin = np.flatnonzero((ids > 1) & (np.r_[True, ids[:-1] == 1] | np.r_[True, doc[1:] != doc[:-1]]))
        ends = np.flatnonzero((ids > 1) & (np.r_[ids[1:] == 1, True] | np.r_[doc[1:] != doc[:-1], True])) + 1
        long = ends - begin >= shortest
        begin, ends = begin[long], ends[long]
        if not len(begin):
            return none
        size = ends - begin
        total = int(size.sum()) + len(size)
        where = np.full(total, -1, np.int64)  # of each indexed symbol, its word in the shard; -1 is a separator
        first = np.cumsum(np.r_[0, size[:-1] + 1])
        offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(np.r_[0, size[:-1]]), size)
        where[np.repeat(first, size) + offset] = np.repeat(begin, size) + offset
        text = np.where(where >= 0, ids[where], 1)
        index = FMIndex(text, len(self.vocabulary) + 2)
        hits, items = [], [set() for _ in docs]
        for length, (patterns, owners) in self.windows.items():
            for part in range(0, len(patterns), 1 << 16):
                lo, hi = index.search(patterns[part : part + (1 << 16)])
                much = hi - lo
                for k in np.array_split(np.flatnonzero(much), max(1, int(much.sum()) >> 18)):
                    if not len(k):
                        continue
                    rows = np.repeat(lo[k] - np.cumsum(np.r_[0, much[k][:-1]]), much[k]) + np.arange(int(much[k].sum()))
                    at = where[index.locate(rows)]
                    hits.append(np.stack((at, at + length), 1))
                    pairs = np.unique(np.stack((doc[at], np.repeat(k + part, much[k])), 1), axis=0)
                    for d, p in pairs.tolist():
                        items[d].update(self.names[o] for o in owners[p])
        if not hits:
            return none
        cover = np.zeros(n + 1, np.int64)
        spans = np.concatenate(hits)
        np.add.at(cover, spans[:, 0], 1)
        np.add.at(cover, spans[:, 1], -1)
        inside = np.cumsum(cover[:-1]) > 0
        edge = np.r_[True, doc[1:] != doc[:-1]]
        a = np.flatnonzero(inside & (edge | ~np.r_[False, inside[:-1]]))
        b = np.flatnonzero(inside & (np.r_[edge[1:], True] | ~np.r_[inside[1:], False])) + 1
        base = np.cumsum(np.r_[0, counts[:-1]])
        out = none
        for d in np.unique(doc[a]).tolist():
            own = doc[a] == d
            out[d] = (np.stack((a[own], b[own]), 1) - base[d], items[d])
        return out


def write_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """The test items as block files in shared storage, built where the items are read; the driver gets their names."""
    out = shared_dir(benchmark.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        made = 0

        def flush(items: list[tuple[str, bytes]]) -> pa.RecordBatch:
            name = f"block-{task.partitionId():06d}-{made:06d}"
            draft = f"{root}/.{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(draft) as f:
                f.write(pickle.dumps(Block(items, window)))
            fs.move(draft, f"{root}/{name}")  # an attempt's file appears whole or not at all
            return pa.RecordBatch.from_pydict({"file": [f"{out}/{name}"]})

        held, size = [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                held.append((i, t))
                size += len(t) + 64
                if size >= block_bytes:
                    yield flush(held)
                    held, size, made = [], 0, made + 1
        if held:
            yield flush(held)

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return sorted(r.file for r in items.mapInArrow(lean(build), "file string").collect())  # a row per block


def _block(uri: str) -> Block:
    """A block from shared storage; the worker keeps the one it used last."""

    def load() -> Block:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_stream(path) as f:
            return pickle.loads(f.read())

    return worker_keeps("decontaminate", uri, load)


def _scan(files: list[str], finish: Callable, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches whose first column is the text: finish(rows of a shard, texts, spans, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def shard() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            texts = pc.fill_null(rows.column(0).cast(pa.large_binary()), b"").to_pylist()
            found = [[] for _ in texts]
            for uri in files:
                for k, x in enumerate(_block(uri).spans(texts)):
                    if len(x[0]):
                        found[k].append(x)
            spans, items = [], []
            for x in found:
                both = sorted(map(tuple, np.concatenate([s for s, _ in x]).tolist())) if x else []
                merged: list[list[int]] = []
                for s, e in both:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                spans.append(merged)
                items.append(sorted(set().union(*(i for _, i in x))))
            return finish(rows, texts, spans, items)

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                held.append(part)
                size += part.column(0).get_total_buffer_size() * part.num_rows // max(1, b.num_rows) if b.num_rows > 64 else part.nbytes
                if size >= shard_bytes:
                    yield shard()
                    held, size = [], 0
        if held:
            yield shard()

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, spans (of hit words), items (ids found, sorted as strings)."""
    small_batches(docs.sparkSession)
    files = write_blocks(benchmark, window=window, block_bytes=block_bytes)

    def finish(rows, texts, spans, items):
        pairs = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([rows.column(1), pa.array([len(words_of(t)) for t in texts], pa.int64()), pairs, pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

    return docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id")).mapInArrow(lean(_scan(files, finish, shard_bytes)), "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items and the hash of the item list, from find_contamination's rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_text(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of these spans and what lies between them."""
    if not spans:
        return text
    shown = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    begin = np.flatnonzero(shown & ~np.r_[False, shown[:-1]])
    end = np.flatnonzero(shown & ~np.r_[shown[1:], False]) + 1
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : begin[s]])
        at = end[e - 1]
    return b"".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the same columns, the hit words cut from their texts (a null text stays null).

    A document of which no word is left goes; one that had none from the start stays.
    """
    small_batches(docs.sparkSession)
    files = write_blocks(benchmark, window=window)

    def finish(rows, texts, spans, items):
        new = [None if null else cut_text(t, s) for t, s, null in zip(texts, spans, rows.column(0).is_null().to_pylist())]
        stay = pa.array([not s or bool(words_of(t)) for t, s in zip(new, spans)])
        text = pa.array([None if t is None else t.decode() for t in new], pa.string())
        return pa.RecordBatch.from_arrays([text, *rows.columns[1:]], rows.schema.names).filter(stay)

    at = [f"c{k}" for k in range(len(docs.columns))]
    first = docs.columns.index(text_col)
    order = [first, *(k for k in range(len(at)) if k != first)]
    plain = docs.toDF(*at).select(*(at[k] for k in order))
    return plain.mapInArrow(lean(_scan(files, finish, SHARD_BYTES)), plain.schema).select(*(F.col(c).alias(n) for c, n in zip(at, docs.columns)))
