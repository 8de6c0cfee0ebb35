"""SimHash near-duplicate groups through a Gray-ordered hierarchical index.

Fingerprints are made where the texts are read. Distinct fingerprints then go three times into an
index, with each third of their bits in front (two fingerprints that differ in at most 2 bits agree
on one of three thirds, so a link is looked for only between fingerprints that agree on the third in front,
and none is lost). They are dealt by just so many leading bits as give some groups to each task, of a sixteenth
of `group_limit` at most on average. All that is dealt to a task lies in Gray order under one tree, whose upper nodes hold the bits that
all members share. Pairs of nodes are followed down only while the differences accumulated in
their shared bits allow a link (none in the third in front), so whole groups fall away at once.
A dealt group of more than `group_limit` fingerprints is split by the whole third, then again by thirds of
its remaining bits, and so on; that ends, as distinct fingerprints fill at most 2^bits places, and no
task ever holds a larger group. A tree emits the edges of spanning stars, never pairs; `components` joins them.
Joins on a fingerprint or component that very many documents share are left to Spark's skew join, which splits them.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other;
a text of one or two words is one shingle; rows with a null id get a component as others do (null
if none of the component has an id); repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm._shared import keyed, lean, parts, row_key, small_batches, stored, without, worker_keeps
from linkloom.operators.components import components

WORDS, SEED, LINK_BITS, GROUP_LIMIT, FANOUT = 3, 42, 2, 100_000, 8
#: Fingerprints under one tree, more only if a single group has more.
TREE_ROWS = 1 << 18
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of the text's word shingles, repeats counted."""
    w = text.lower().split()  # bytes: folds A-Z and parts at ASCII white space only
    if not w:
        return 0
    n = len(w) - words + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    if n == 1:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[k:] for k in range(words)))), repeat(seed)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        votes += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of `keep` (name: column) with fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("simhash")
        for b in batches:
            texts = pc.fill_null(b.column(0).cast(pa.large_binary()), b"")
            fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], [*b.schema.names[1:], "fp"])

    plain = docs.select(F.col(text_col).cast("string").alias("_text"), *(c.alias(n) for n, c in keep.items()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[1:])
    return plain.mapInArrow(lean(run), f"{kinds}, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the Gray sequence (neighbours differ in one bit), as a signed long that sorts alike."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def thirds(mask: int, k: int = LINK_BITS) -> list[int]:
    """The mask with one of k + 1 equal runs of its free bits added, for each of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [len(free) * j // (k + 1) for j in range(k + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tree_links(fp: np.ndarray, k: int = LINK_BITS, must: int = 0, fanout: int = FANOUT, block: int = 1 << 18, tally: dict | None = None) -> np.ndarray:
    """For fingerprints in Gray order, the smallest position in each one's group under links of at most k bits, none in `must`.

    Level 0 of the tree are the fingerprints; a node above has the bits that are set in all its
    members (`ones`) and those that are clear in all (`zeros`). tally, if given, gets the counts of
    fingerprints, pairs of upper nodes that were met and that were pruned, and pairs of fingerprints compared.
    """
    n = len(fp)
    levels = [(fp, ~fp)]
    while len(levels[-1][0]) > 1:
        at = np.arange(0, len(levels[-1][0]), fanout)
        levels.append(tuple(np.bitwise_and.reduceat(x, at) for x in levels[-1]))
    label = np.arange(n)
    zero = np.zeros(1, np.int64)
    todo = [(len(levels) - 1, zero, zero)]
    steps = np.arange(fanout)
    fixed = np.uint64(must)
    met = pruned = compared = 0
    while todo:
        depth, i, j = todo.pop()
        ones, zeros = levels[depth]
        differ = (ones[i] & zeros[j]) | (zeros[i] & ones[j])  # differences so far; whole groups go here
        near = (np.bitwise_count(differ) <= k) & (differ & fixed == 0)
        if depth:
            met, pruned = met + len(i), pruned + len(i) - int(near.sum())
        else:
            compared += len(i)
        i, j = i[near], j[near]
        if depth:
            size = len(levels[depth - 1][0])
            x = (i[:, None, None] * fanout + steps[None, :, None]) + 0 * steps[None, None, :]
            y = (j[:, None, None] * fanout + steps[None, None, :]) + 0 * steps[None, :, None]
            x, y = x.ravel(), y.ravel()
            keep = (x < size) & (y < size) & (x <= y if depth > 1 else x < y)
            x, y = x[keep], y[keep]
            todo += [(depth - 1, x[s : s + block], y[s : s + block]) for s in range(0, len(x), block)] if depth == 1 else [(depth - 1, x[s : s + block // fanout**2], y[s : s + block // fanout**2]) for s in range(0, len(x), block // fanout**2)]
            continue
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    if tally is not None:
        for name, x in (("prints", n), ("met", met), ("pruned", pruned), ("compared", compared)):
            tally[name] = tally.get(name, 0) + x
    return label


def index_links(must: np.ndarray, fp: np.ndarray, k: int, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Star edges between fingerprints: a tree for each run of one `must`, whose members lie in Gray order by group."""
    n = len(fp)
    new = np.flatnonzero(np.r_[True, must[1:] != must[:-1]]) if n else np.zeros(0, np.int64)
    label = np.arange(n)
    for s, e in zip(new.tolist(), [*new[1:].tolist(), n]):
        label[s:e] = s + tree_links(fp[s:e].view(np.uint64), k, int(must[s]) & _ALL, tally=tally)
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def leading(third: int, bits: int) -> int:
    """The highest `bits` bits of a mask."""
    free = [b for b in range(63, -1, -1) if third >> b & 1]
    return sum(1 << b for b in free[:bits])


def in_front(fp: Column, must: Column, musts: list[int]) -> Column:
    """Fingerprints with the run of bits `must` moved to the top, if it is a run."""
    out = fp
    for m in musts:
        top = m.bit_length()
        if m and (m >> (m & -m).bit_length() - 1) + 1 & (m >> (m & -m).bit_length() - 1) == 0 and top < 64:
            out = F.when(must == F.lit(_signed(m)).cast("long"), F.shiftleft(fp, 64 - top).bitwiseOR(F.shiftrightunsigned(fp, top))).otherwise(out)
    return out


def links(distinct: DataFrame, k: int = LINK_BITS, group_limit: int = GROUP_LIMIT, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Edges (a, b) between the fingerprints of column `fp` that connect all within k bits, directly or over others."""
    spark = distinct.sparkSession
    n = distinct.count()
    bits = min(64 // (k + 1), max(16 * n // group_limit, parts(spark)).bit_length())
    level = distinct.select(F.col("fp"), F.lit(0).cast("long").alias("must"))
    # What a group must agree on, by how it is split: the bits to deal by, and those its members then must agree on.
    finer = {0: [(leading(third, bits), third) for third in thirds(0, k)]}
    found = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        many = 0

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = index_links(cols[0], cols[2], k)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns[:3]])
            many += batch.num_rows
            if many < tree_rows:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            end = len(same) - int(same.sum())  # the last group may go on in the next batch
            if end:
                yield out([c[:end] for c in cols])
            held, many = [[c[end:] for c in cols]], len(same) - end
        if many:
            yield out([np.concatenate(c) for c in zip(*held)])

    while True:
        pick = F.create_map(*(F.lit(x) for m, t in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*(F.struct(F.lit(_signed(d)).cast("long").alias("deal"), F.lit(_signed(v)).cast("long").alias("must")) for d, v in t)))))
        rows = level.select("fp", F.explode(pick[F.col("must")]).alias("x")).select("fp", F.col("x.must").alias("must"), F.col("fp").bitwiseAND(F.col("x.deal")).alias("key"))
        rows = rows if found is None else rows.distinct()
        hot = stored(rows.groupBy("must", "key").agg(F.count("*").alias("n")).where(F.col("n") > group_limit), few=True)
        some_hot = bool(hot.take(1))
        fine = rows.join(hot.select("must", "key"), ["must", "key"], "left_anti") if some_hot else rows
        rank = gray_rank(in_front(F.col("fp"), F.col("must"), [v for t in finer.values() for _, v in t]))
        laid = fine.select("must", "key", "fp", rank.alias("rank")).repartition(parts(spark), "must", "key").sortWithinPartitions("must", "key", "rank")
        edges = laid.mapInArrow(lean(run), "a long, b long")
        found = edges if found is None else found.union(edges)
        if not some_hot:
            return found
        level = stored(rows.join(hot.select("must", "key"), ["must", "key"], "left_semi").select("fp", "must"))
        whole = {v: d == v for t in finer.values() for d, v in t}
        finer = {v: [(x, x) for x in thirds(v & _ALL, k)] if all_of else [(v, v)] for v, all_of in whole.items()}


def classes(docs_fp: DataFrame, first: Column, k: int = LINK_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(fp, kept): for each fingerprint the least value of `first` that links of at most k bits reach."""
    distinct = stored(docs_fp.groupBy("fp").agg(F.min(first).alias("first")), few=True)
    label = components(links(distinct, k, group_limit))
    of = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("first").alias("kept"))
    return of.join(least, "component").select("fp", "kept")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = LINK_BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """A row per document: doc_id, fp, component_id (the smallest id that links of at most k bits reach)."""
    docs_fp = stored(fingerprints(docs, {"doc_id": F.col(id_col).cast("long")}, text_col), narrow=True)
    return docs_fp.join(classes(docs_fp, F.col("doc_id"), k, group_limit), "fp").select("doc_id", "fp", F.col("kept").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = LINK_BITS) -> DataFrame:
    """docs with the same columns, of each group only the row with the smallest id (ids before nulls).

    Rows equal in every column are one document: one of them stays, or none.
    """
    docs_fp = stored(fingerprints(docs, {"row": row_key(docs, id_col)}, text_col), narrow=True)
    order = F.struct(F.col("row.id").isNull().alias("none"), F.col("row.id").alias("id"), F.col("row.hash").alias("hash"))
    rows = docs_fp.withColumn("own", order)
    gone = rows.join(classes(rows, F.col("own"), k), "fp").where(~F.col("own").eqNullSafe(F.col("kept"))).select("row.id", "row.hash")
    single = without(docs, gone, id_col)
    again = stored(docs_fp.groupBy("row").count().where("count > 1").select("row.id", "row.hash"), few=True)
    if not again.take(1):
        return single
    copies = again.toDF("again_id", "again_hash")
    equal = keyed(single, id_col).join(copies, (F.col("k.hash") == F.col("again_hash")) & F.col("k.id").eqNullSafe(F.col("again_id")), "left_semi")
    return without(single, again, id_col).union(equal.dropDuplicates(["k"]).drop("k"))
