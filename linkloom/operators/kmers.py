"""K-mers of long texts as arrays: minimizer sketches, and whether a k-mer is of one class of texts only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from linkloom.functions.sequence import BASES, COMPLEMENTS

_PAIRED = str.maketrans(BASES, COMPLEMENTS)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = 42

#: Characters that `_shares` takes at a time, unless one text has more.
LOT = 1 << 21


def _rolled(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rolled(acc + word * _P2, 31) * _P1


def xxh64(raw: np.ndarray, words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """XXH64 (seed 42, as Spark's xxhash64) of `size` bytes of raw from each place; words: the little-endian words at all places of raw."""
    with np.errstate(over="ignore"):
        seed, pos = np.full(len(at), _SEED, np.uint64), 0
        if size >= 32:
            lanes = [seed + _P1 + _P2, seed + _P2, seed, seed - _P1]
            while pos + 32 <= size:
                lanes = [_lane(v, words[at + pos + 8 * k]) for k, v in enumerate(lanes)]
                pos += 32
            h = sum(_rolled(v, by) for v, by in zip(lanes, (1, 7, 12, 18)))
            for v in lanes:
                h = (h ^ _lane(np.zeros_like(v), v)) * _P1 + _P4
        else:
            h = seed + _P5
        h = h + np.uint64(size)
        while pos + 8 <= size:
            h = _rolled(h ^ _lane(np.zeros_like(h), words[at + pos]), 27) * _P1 + _P4
            pos += 8
        if pos + 4 <= size:
            h = _rolled(h ^ ((words[at + pos] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            pos += 4
        while pos < size:
            h = _rolled(h ^ (raw[at + pos].astype(np.uint64) * _P5), 11) * _P1
            pos += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def kmer_hashes(text: str, k: int) -> np.ndarray:
    """xxhash64 of the lesser of each k-mer and its reverse complement, in their order, as Spark compares and hashes them (by UTF-8)."""
    n = len(text) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    both = text + text.translate(_PAIRED)[::-1]
    raw = np.frombuffer(both.encode() + bytes(16), np.uint8)
    starts = np.flatnonzero((raw[:-16] & 0xC0) != 0x80)
    ends = np.append(starts, len(raw) - 16)
    ahead, back = starts[:n], starts[2 * len(text) - k - np.arange(n)]
    size = ends[k : k + n] - ahead
    words = np.zeros(len(raw) - 8, np.uint64)
    for j in range(8):
        words |= raw[j : j + len(words)].astype(np.uint64) << np.uint64(8 * j)
    order = words.byteswap()
    less, open_ = np.zeros(n, bool), np.ones(n, bool)
    for at in range(0, int(size.max()), 8):  # both have the same size; bytes past its end don't count
        keep = np.clip(size - at, 0, 8).astype(np.uint64)
        drop = (np.uint64(8) - np.maximum(keep, np.uint64(1))) * np.uint64(8)
        last = len(order) - 1
        x, y = order[np.minimum(ahead + at, last)] >> drop, order[np.minimum(back + at, last)] >> drop
        differ = open_ & (keep > 0) & (x != y)
        less |= differ & (y < x)
        open_ &= ~differ
    at = np.where(less, back, ahead)
    found = np.empty(n, np.int64)
    for s in np.unique(size):
        here = size == s
        found[here] = xxh64(raw, words, at[here], int(s))
    return found


def sketch(text: str, k: int, w: int) -> np.ndarray:
    """Sorted distinct least hashes of all windows of w k-mers; of a shorter text the least of all."""
    h = kmer_hashes(text, k)
    if not len(h):
        return h
    width, covered = min(w, len(h)), 1
    least = h
    while covered < width:  # minima of windows twice as wide each time
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    return np.unique(least)


def sketches(seqs: DataFrame, k: int, w: int) -> DataFrame:
    """(ctg, sketch) of texts (ctg, seq) that have k-mers, a text at a time."""
    schema = StructType([seqs.schema["ctg"], StructField("sketch", ArrayType(LongType()))])
    result = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t, k, w) if t else np.zeros(0, np.int64) for t in batch.column("seq").to_pylist()]
            has = np.array([len(x) > 0 for x in found], bool)
            ends = np.cumsum([0, *(len(x) for x in found if len(x))]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("ctg").filter(pa.array(has)).cast(result.field("ctg").type), values.cast(result.field("sketch").type)], schema=result)

    return seqs.select("ctg", "seq").mapInArrow(run, schema)


def _shares(ids: list, groups: list, texts: list[str], k: int, result: pa.Schema) -> pa.RecordBatch:
    """(kmer, lo, hi, rows) of some texts: rows (id, n) only where no two groups are known to have the k-mer."""
    sizes = np.array([len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    place = np.concatenate([np.arange(e - s, e - k + 1) for s, e in zip(sizes, ends)])
    owner = np.repeat(np.arange(len(texts)), sizes - k + 1)
    _, char = np.unique(chars, return_inverse=True)
    code, width, base = np.zeros(len(place), np.int64), 1, int(char.max()) + 1
    for j in range(k):
        if width * base >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            width = int(code.max()) + 1
        code, width = code * base + char[place + j], width * base
    order = np.argsort(code, kind="stable")  # texts stay in order, so equal pairs of k-mer and text lie side by side
    code, owner, place = code[order], owner[order], place[order]
    new = np.append(True, code[1:] != code[:-1])
    pair = np.flatnonzero(new | np.append(True, owner[1:] != owner[:-1]))
    times = np.diff(np.append(pair, len(code)))
    names = sorted({g for g in groups if g is not None})
    rank = {g: r for r, g in enumerate(names)}
    text_rank = np.array([rank.get(g, -1) for g in groups])
    who = owner[pair]
    first = np.flatnonzero(new[pair])
    at = text_rank[who]
    lo, hi = np.minimum.reduceat(np.where(at < 0, len(names), at), first), np.maximum.reduceat(at, first)
    window = chars[place[pair[first]][:, None] + np.arange(k)].tobytes().decode("utf-32-le")
    alone = hi <= lo  # of one group, or (hi -1, lo past the last) of none
    held = np.diff(np.append(first, len(pair)))
    moves = np.repeat(alone, held)
    kind = result.field("rows").type
    rows = pa.StructArray.from_arrays([pa.array(ids, kind.value_type.field(0).type).take(pa.array(who[moves])), pa.array(times[moves].astype(np.int64))], fields=list(kind.value_type))
    ends = pa.array(np.append(0, np.cumsum(held * alone)).astype(np.int32))
    known = pa.array([*names, None], result.field("lo").type)
    none = hi < 0
    side = lambda at: known.take(pa.array(np.where(none, len(names), at)))
    kmer = pa.array([window[i : i + k] for i in range(0, len(window), k)], result.field("kmer").type)
    return pa.RecordBatch.from_arrays([kmer, side(lo), side(hi), pa.ListArray.from_arrays(ends, rows, type=kind)], schema=result)


def kmer_shares(texts: DataFrame, name: str, group: str, text: str, k: int) -> DataFrame:
    """(name, only_here, shared): k-mers of each text that no other group has, and those that some other has; null groups are none.

    Texts are counted in lots. A k-mer that two groups of a lot have is shared, so only its groups move; of others the texts
    of the lot that have it move too, and are dealt by k-mer. Texts without k-mers are left out.
    """
    from linkloom.functions.storage import stored

    id_type, group_type = texts.schema[name].dataType.simpleString(), texts.schema[group].dataType.simpleString()
    schema = StructType.fromDDL(f"kmer string, lo {group_type}, hi {group_type}, rows array<struct<id: {id_type}, n: bigint>>")
    result, most = to_arrow_schema(schema), LOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "grp", "text"))):
                if row[2] is not None and len(row[2]) >= k:
                    lot.append(row)
                    size += len(row[2])
                if size >= most:
                    yield _shares(*zip(*lot), k, result)
                    lot, size = [], 0
        if lot:
            yield _shares(*zip(*lot), k, result)

    x = texts.select(F.col(name).alias("id"), F.col(group).alias("grp"), F.col(text).alias("text"))
    held = stored(x.mapInArrow(run, schema))
    own = stored(held.groupBy("kmer").agg(F.min("lo").alias("least"), F.max("hi").alias("most")))
    single = own.where("least is null or least = most")
    few = held.where(F.size("rows") > 0).join(single, "kmer").select(F.col("least").isNotNull().alias("one"), F.inline("rows"))
    marks = few.select("id", F.lit(0).cast("long").alias("total"), F.when(F.col("one"), F.col("n")).otherwise(0).alias("only"), F.when(F.col("one"), 0).otherwise(F.col("n")).alias("none"))
    sizes = x.where(F.length("text") >= k).select("id", (F.length("text") - k + 1).cast("long").alias("total"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    sums = marks.union(sizes).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("total", "only", "none")))
    return sums.select(F.col("id").alias(name), F.col("only").alias("only_here"), (F.col("total") - F.col("only") - F.col("none")).alias("shared"))
