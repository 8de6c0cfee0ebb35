"""Line de-duplication over all documents with two Bloom filters, once-seen and twice-seen.

Pass 1 reads every text where it lies and hashes its long lines (each key once per document) into two
partial Bloom filters: a key goes to `twice` if it was in `once` already. Partial filters are merged
segment by segment: the once-filters by OR, and the twice-filter also gets what two once-filters have
in common, so a key that two tasks saw once each is in it; merging can add suspects, never lose one.
Pass 2 looks the lines up in the merged twice-filter. Only suspected repeats move: their digests,
with the document, are counted exactly, and the copy to keep is chosen. Pass 3 rewrites the
texts of documents that hold a confirmed repeat.

The filters have `bits_per_line` bits for each line, up to `max_bits`; beyond that size they fill up and let
more suspects through to the exact count, which is then the larger shuffle, but results stay
the same. Confirmed digests go to the rewriting tasks as a broadcast only up to `max_broadcast` of
them (counted first), beyond that by a join on the documents that hold them.

Defined cases: a null or empty text is one empty line; of a key's copies within one document all go or
all stay; rows that share an id are one document for the count; rows with a null id never count and
lose the lines of confirmed repeats; lines below the length are never touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._shared import lean, small_batches, stored

MIN_CHARS, MIN_DOCS = 40, 5
BITS_PER_LINE, MAX_BITS, SEGMENT_BITS, PROBES, MAX_BROADCAST = 16, 1 << 30, 1 << 20, 3, 200_000
#: Keys of one task that are gathered for a partial filter at most.
BUFFER = 2_000_000
_STRIP = b" \t\n\x0b\x0c\r"


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its key, None for lines too short to matter."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP).lower() if len(line) >= min_chars else b""
        out.append(key if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars) else None)
    return out


def _hashes(keys: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _bits(h: np.ndarray, segments: int) -> np.ndarray:
    """PROBES bit places of each hash, all in one segment (by its upper half)."""
    segment = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    low, step = h & np.uint64(0xFFFFFFFF), (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) | np.uint64(1)
    return segment * np.uint64(SEGMENT_BITS) + ((low + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(SEGMENT_BITS - 1))


class TwiceFilter:
    def __init__(self, bits: np.ndarray, segments: int):
        self.bits, self.segments = bits, segments

    def has(self, h: np.ndarray) -> np.ndarray:
        at = _bits(h, self.segments)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def twice_filter(docs: DataFrame, min_chars: int, max_bits: int) -> TwiceFilter:
    """The merged twice-seen filter. docs: text."""
    lines = docs.select(F.sum(F.octet_length("text") / F.lit(min_chars)).cast("long").alias("n")).first().n or 1  # at most so many long lines
    segments = 1
    while segments * SEGMENT_BITS < min(max_bits, BITS_PER_LINE * lines // 4):
        segments *= 2
    size = SEGMENT_BITS // 8

    def filters(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Partial filters over these keys (each once per document), a row per segment that has any."""
        zip_ = zstandard.ZstdCompressor(level=1)
        values, count = np.unique(np.concatenate(hashes), return_counts=True)  # sorted, so segments lie together
        places = _bits(values, segments)
        seg = (places[0] // np.uint64(SEGMENT_BITS)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, np.int64)
        for s, e in zip(cut, np.r_[cut[1:], len(seg)]):
            at = (places[:, s:e] & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)
            both = []
            for x in (at, at[:, count[s:e] > 1]):
                bits = np.zeros(size, np.uint8)
                np.bitwise_or.at(bits, (x >> 3).ravel(), (1 << (x & 7)).astype(np.uint8).ravel())
                both.append(zip_.compress(bits.tobytes()))
            yield pa.RecordBatch.from_pydict({"segment": pa.array([seg[s]], pa.int32()), "once": pa.array(both[:1], pa.binary()), "twice": pa.array(both[1:], pa.binary())})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for b in batches:
            for t in _texts(b.column(0)):
                held.append(_hashes(set(keys_of(t, min_chars)) - {None}))
                many += len(held[-1])
                if many >= BUFFER:
                    yield from filters(held)
                    held, many = [], 0
        if many:
            yield from filters(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, now, once, twice = zstandard.ZstdDecompressor(), None, None, None
        for b in batches:  # sorted by segment
            for k, o, t in zip(*(c.to_pylist() for c in b.columns)):
                o, t = (np.frombuffer(unzip.decompress(x), np.uint8) for x in (o, t))
                if k == now:
                    twice |= t | (once & o)
                    once |= o
                else:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "twice": pa.array([zstandard.compress(twice.tobytes())], pa.binary())})
                    now, once, twice = k, o.copy(), t.copy()
        if now is not None:
            yield pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "twice": pa.array([zstandard.compress(twice.tobytes())], pa.binary())})

    bits = np.zeros(segments * size, np.uint8)
    some = docs.select("text").mapInArrow(lean(partial), "segment int, once binary, twice binary")
    for r in some.repartition(F.col("segment")).sortWithinPartitions("segment").mapInArrow(lean(merge), "segment int, twice binary").toLocalIterator():
        bits[r.segment * size : (r.segment + 1) * size] = np.frombuffer(zstandard.decompress(r.twice), np.uint8)
    return TwiceFilter(bits, segments)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, keep_doc) of every key in at least min_docs documents; docs: doc_id, text."""
    spark = docs.sparkSession
    found = spark.sparkContext.broadcast(twice_filter(docs, min_chars, max_bits))  # at most max_bits / 8 bytes

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = found.value
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                own = list(set(keys_of(t, min_chars)) - {None})
                if own and i is not None:
                    hit = [own[k] for k in np.flatnonzero(twice.has(_hashes(own)))]
                    keys += map(_digest, hit)
                    ids += [i] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    pairs = docs.select("doc_id", "text").mapInArrow(lean(suspects), "key binary, doc_id long").distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_doc")).where(F.col("n") >= min_docs).select("key", "keep_doc")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, text (of the lines that stay)."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone = stored(repeated_lines(plain, min_chars, min_docs, max_bits), few=True)
    known = gone.count() <= max_broadcast

    def rewrite(doc_id, text: bytes, keep: dict) -> tuple[int, int, bytes]:
        lines = text.split(b"\n")
        if not keep or len(text) < min_chars:
            return len(lines), 0, text
        stay = [line for line, key in zip(lines, keys_of(text, min_chars)) if key is None or keep.get(_digest(key), doc_id) == doc_id]
        return len(lines), len(lines) - len(stay), text if len(stay) == len(lines) else b"\n".join(stay)

    def batch(ids: pa.Array, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        n, d, t = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array([x.decode() for x in t], pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    schema = "doc_id long, n_lines long, n_dropped long, text string"
    if known:
        kept = spark.sparkContext.broadcast({bytes(r.key): r.keep_doc for r in gone.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield batch(b.column(0), [rewrite(i, t, kept.value) for i, t in zip(b.column(0).to_pylist(), _texts(b.column(1)))])

        return plain.mapInArrow(lean(run), schema)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, keys = [], [], []
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2))):
                own = list(map(_digest, set(keys_of(t, min_chars)) - {None}))
                ids += [i] * len(own)
                hashes += [h] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "h", "key"])

    # A document's own confirmed keys come to it, by id and text, so rows without an id share a list only if their texts are equal.
    hashed = plain.select("doc_id", F.xxhash64("text").alias("h"), "text")
    held = hashed.mapInArrow(lean(holders), "doc_id long, h long, key binary").distinct().join(gone, "key").groupBy("doc_id", "h").agg(F.collect_list("key").alias("keys"), F.collect_list("keep_doc").alias("keep"))
    both = hashed.join(held, hashed["doc_id"].eqNullSafe(held["doc_id"]) & (hashed["h"] == held["h"]), "left").select(hashed["doc_id"], "text", "keys", "keep")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, keep = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield batch(b.column(0), [rewrite(i, t, {k: (v if v is not None else -1) for k, v in zip(ks or (), vs or ())}) for i, t, ks, vs in zip(b.column(0).to_pylist(), _texts(b.column(1)), keys, keep)])

    return both.mapInArrow(lean(run_joined), schema)
