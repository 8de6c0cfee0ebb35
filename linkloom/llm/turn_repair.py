"""Repair of conversations whose rows are lost, blank, repeated, cut short or of the wrong role.

Each row gets a symbol: its role's initial (s, u, a, or o for any other), in capitals if its text is truncated, or x if it is
blank or a duplicate. The symbols of a conversation in order are its signature. Distinct signatures are laid out by ranges and
sorted, which is the order of a prefix trie; along it a stack keeps one dynamic-programming layer per shared prefix, so a layer
is computed once for all signatures below it, and each signature's cheapest edits are read off at its end. A layer holds, for
the four states of `(s?(ua)+)?`, the least cost and how the states' edit strings compare; layers that differ by a constant
cost are the same one, so a step is one look-up.

A conversation of any length takes a byte a row until its edits, which are one string, are known: its rows are ordered in
range partitions, parts of the signature are joined. Texts move once, to be written out in order, and stream through.

Defined cases: a null role or text counts as one space (so the text is blank), a null conversation is one of its own, null turns
come first; rows of one turn are ordered by role and text digest, so repeated rows lie together and all but one are duplicates;
ties of cost go to the edits least in ASCII; very long texts stream whole; other columns, of whatever name, are not read; an empty
table gives no rows. A row that stands for 0 copies makes its conversation known and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import islice
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm._shared import lean, parts, small_batches, stored

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits: rerole, delete, insert; a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the target: nothing yet, after system, after user, after assistant; the user or assistant row that may come next leads to NEXT.
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
LESS, PREFIX, MORE, PREFIXED = -1, -2, 1, 2


class Layers:
    """Dynamic-programming layers, each made once: `step(layer, symbol)` gives the next one.

    A layer is (costs above the least, or None; comparison of each two states' edits). Edits that are a proper prefix of other
    edits over the same rows lack inserts alone, so the others go on with I.
    """

    def __init__(self):
        self.steps: dict = {}
        self.first = self._layer({0: (0, (0, "", 0))}, None)

    def _compare(self, x: tuple, y: tuple, order) -> int:
        """Of edits given as (state before, letter, inserts after): LESS, MORE, PREFIX (x of y), PREFIXED or 0."""
        (p, c, m), (q, d, n) = x, y
        if p == q:
            if c != d:
                return LESS if c < d else MORE
            return 0 if m == n else PREFIX if m < n else PREFIXED
        r = order[p][q]
        if r == PREFIX:
            return LESS if c < "I" else MORE
        if r == PREFIXED:
            return LESS if "I" < d else MORE
        return r

    def _layer(self, best: dict, order) -> tuple:
        """(layer, its least cost, where each state's edits come from) once inserts are added to `best`."""
        changed = True
        while changed:
            changed = False
            for p, (cost, (q, c, m)) in list(best.items()):
                new = (cost + INSERT, (q, c, m + 1))
                old = best.get(NEXT[p])
                if old is None or new[0] < old[0] or new[0] == old[0] and self._compare(new[1], old[1], order) in (LESS, PREFIX):
                    best[NEXT[p]] = new
                    changed = True
        least = min(c for c, _ in best.values())
        costs = tuple(best[p][0] - least if p in best else None for p in range(4))
        between = tuple(tuple(self._compare(best[p][1], best[q][1], order) if p in best and q in best else 0 for q in range(4)) for p in range(4))
        return (costs, between), least, {p: (q, c + "I" * m) for p, (_, (q, c, m)) in best.items()}

    def step(self, layer: tuple, symbol: str) -> tuple:
        key = layer, symbol
        if key not in self.steps:
            costs, order = layer
            best: dict = {}
            role, more = symbol.lower(), TRUNCATED * symbol.isupper()
            for p, cost in enumerate(costs):
                if cost is None:
                    continue
                moves = [(p, cost + DELETE, "D")]
                if role != "x":
                    moves.append((NEXT[p], cost + REROLE + more, "R"))
                    if (p, role) in KEEPS:
                        moves.append((KEEPS[p, role], cost + more, "K"))
                for q, c, letter in moves:
                    new, old = (c, (p, letter, 0)), best.get(q)
                    if old is None or c < old[0] or c == old[0] and self._compare(new[1], old[1], order) in (LESS, PREFIX):
                        best[q] = new
            self.steps[key] = self._layer(best, order)
        return self.steps[key]

    def end(self, layer: tuple) -> int:
        """The state in which the cheapest edits end."""
        costs, order = layer
        return min((p for p in ENDS if costs[p] is not None), key=cmp_to_key(lambda p, q: costs[p] - costs[q] or order[p][q]))


def answers(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, edits) of each signature; they come sorted, and what neighbours share in front is computed once."""
    layers = Layers()
    path, sums, last = [layers.first], [layers.first[1]], ""
    for s in signatures:
        shared = len(commonprefix((last, s)))
        del path[shared + 1 :], sums[shared + 1 :]
        for symbol in s[shared:]:
            path.append(layers.step(path[-1][0], symbol))
            sums.append(sums[-1] + path[-1][1])
        state, edits = layers.end(path[-1][0]), []
        cost = sums[-1] + path[-1][0][0][state]
        for layer in reversed(path):
            state, letters = layer[2][state]
            edits.append(letters)
        yield s, cost, "".join(reversed(edits))
        last = s


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None) -> DataFrame:
    """c, t, r, x, n and h, the digest of the text."""
    n = F.lit(1) if copies is None else copies
    space = lambda k: F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(" "))
    rows = df.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"), space(role).alias("r"), space(text).alias("x"), n.cast("long").alias("n"))
    return rows.withColumn("h", F.unhex(F.sha2("x", 256)))


def _marks(rows: DataFrame) -> DataFrame:
    """Rows without texts, equal ones as one, with their symbols and faults."""
    bare = F.rtrim("x", F.lit(BLANKS))
    cut = rows.select("c", "t", "r", "h", "n", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("short"))
    cut = cut.groupBy("c", "t", "r", "h", "blank", "short").agg(F.sum("n").alias("n"))
    # Blank texts are no duplicates; their own key keeps them from being one group of a long conversation.
    seen = Window.partitionBy("c", "r", "h", F.when(F.col("blank"), F.col("t"))).orderBy(F.col("n") == 0, F.col("t").asc_nulls_first())
    initial = F.lower(F.when(F.substring("r", 1, 1).isin("s", "u", "a"), F.substring("r", 1, 1)).otherwise("o"))
    m = cut.withColumns({"new": ~F.col("blank") & (F.row_number().over(seen) == 1), "ini": initial})
    own = F.when(~F.col("new"), "x").otherwise(F.when(F.col("short"), F.upper("ini")).otherwise(F.col("ini")))
    some, n = F.col("n") > 0, F.col("n").cast("int")
    return m.select(
        "c", "t", "r", "h", "n",
        F.when(some, F.concat(own, F.repeat(F.lit("x"), n - 1))).otherwise("").alias("sym"), F.when(some, F.repeat("ini", n)).otherwise("").alias("inis"),
        F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("blank") | ~some, 0).otherwise(F.col("n") - F.col("new").cast("long")).alias("duplicate"),
        F.when(F.col("new") & F.col("short") & some, 1).otherwise(0).cast("long").alias("truncated"),
    )


def diagnose(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """(c, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation c.

    copies: how many equal rows a row stands for (0: none, but its conversation is known), 1 by default.
    """
    return _diagnosed(_rows(df, conv, turn, role, text, copies))


def _diagnosed(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    marks = stored(_marks(rows), narrow=True)
    laid = marks.repartitionByRange(parts(spark), "c", "t", "r", "h").withColumn("part", F.spark_partition_id())
    some = F.col("n") > 0
    sums = [F.sum(k).alias(k) for k in ("n", "blank", "duplicate", "truncated")]
    pieces = laid.groupBy("c", "part").agg(F.sort_array(F.collect_list(F.when(some, F.struct("t", "r", "h", "sym", "inis")))).alias("l"), F.min(F.when(some, F.col("t"))).alias("lo"), F.max(F.when(some, F.col("t"))).alias("hi"), *sums)
    turns = F.size(F.array_distinct(F.filter("l.t", lambda t: t.isNotNull()))).cast("long")
    pieces = pieces.select("c", F.struct("part", F.concat_ws("", "l.sym").alias("sym"), F.concat_ws("", "l.inis").alias("inis"), turns.alias("turns"), "lo", "hi").alias("p"), "n", "blank", "duplicate", "truncated")
    whole = pieces.groupBy("c").agg(F.sort_array(F.collect_list("p")).alias("p"), *sums)
    held = F.filter("p", lambda p: p.turns > 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    shared = total(F.transform(F.sequence(F.lit(1), F.size("held") - 1), lambda k: (F.col("held")[k].lo == F.col("held")[k - 1].hi).cast("long")))
    distinct = total(F.col("held.turns")) - F.when(F.size("held") > 1, shared).otherwise(0)
    span = F.array_max("held.hi") - F.array_min("held.lo") + 1
    convs = whole.withColumn("held", held).select(
        "c", F.col("n").alias("n_rows"), F.coalesce(span - distinct, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        F.concat_ws("", "p.sym").alias("signature"), F.concat_ws("", "p.inis").alias("inis"),
    )
    legal = F.regexp_count("inis", F.lit("(?=su|ua|au)"))
    convs = stored(convs.withColumn("illegal", (F.greatest(F.length("inis") - 1, F.lit(0)) - legal).cast("long")).drop("inis"), narrow=True)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _lots(answers(s for b in batches for s in b.column(0).to_pylist())):
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*some), (pa.string(), pa.int64(), pa.string()))], ["signature", "cost", "audit"])

    distinct_ones = convs.select("signature").distinct().repartitionByRange(parts(spark), "signature").sortWithinPartitions("signature")
    solved = distinct_ones.mapInArrow(lean(solve), "signature string, cost long, audit string")
    return convs.join(solved, "signature").drop("signature")


def _lots(items: Iterator[tuple], rows: int = 1024) -> Iterator[list[tuple]]:
    while some := list(islice(items, rows)):
        yield some


class _Writer:
    """Applies a conversation's edits to its rows as they come: gives (role, text) of the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _said(self, role: str | None, text: str) -> tuple[str, str]:
        """A row of this role, or of the one that is due."""
        if role is None:
            role = "assistant" if self.state == 2 else "user"
        self.state = KEEPS[self.state, role[0]]
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._said(None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._said(role if edit == "K" else None, text)


def _applied(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(c, pos, role, text): repaired rows in order of c and pos within partitions; before each conversation's rows one of pos 0."""
    spark = rows.sparkSession
    small_batches(spark)
    kind = dict(rows.dtypes)
    head = found.select("c", F.lit(0).alias("k"), F.lit(None).cast(kind["t"]).alias("t"), F.lit("").alias("r"), F.lit(None).cast("binary").alias("h"), F.lit(0).cast("long").alias("n"), F.col("audit").alias("x"))
    body = rows.where("n > 0").select("c", F.lit(1).alias("k"), "t", "r", "h", "n", "x")
    order = [F.col(x).asc_nulls_first() for x in ("c", "k", "t", "r", "h")]
    laid = head.union(body).repartition(parts(spark), "c").sortWithinPartitions(*order).select("c", "k", "r", "n", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, conv, pos = None, None, 0
        for b in batches:
            out: list[tuple] = []
            c, k, r, n, x = (col.to_pylist() for col in b.columns)

            def put(said: Iterator[tuple[str, str]]) -> None:
                nonlocal pos
                for role, text in said:
                    pos += 1
                    out.append((conv, pos, role, text))

            for j in range(len(c)):
                if k[j] == 0:
                    if writer is not None:
                        put(writer.inserted())
                    writer, conv, pos = _Writer(x[j]), c[j], 0
                    out.append((conv, 0, None, None))
                    continue
                for _ in range(n[j]):
                    put(writer.row(r[j], x[j]))
            yield _batch(out, b.schema.field(0).type)
        if writer is not None:
            out = []
            for role, text in writer.inserted():
                pos += 1
                out.append((conv, pos, role, text))
            yield _batch(out, None)

    def _batch(out: list[tuple], first) -> pa.RecordBatch:
        if first is None:
            first = kept[0]
        kept[:] = [first]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(cols, (first, pa.int64(), pa.string(), pa.string()))], ["c", "pos", "role", "text"])

    kept: list = [None]
    return laid.mapInArrow(lean(run), f"c {kind['c']}, pos long, role string, text string")


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """(c, pos, role, text): the rows of each repaired conversation c, numbered from 1."""
    rows = _rows(df, conv, turn, role, text, copies)
    return _applied(rows, _diagnosed(rows)).where("pos > 0")


def digest(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """`diagnose`, with repaired_sha256 of the repaired rows as `role:text`, joined by line breaks."""
    rows = _rows(df, conv, turn, role, text, copies)
    found = stored(_diagnosed(rows), narrow=True)
    kind = dict(rows.dtypes)["c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_, sha, type_ = None, None, None
        for b in batches:
            type_ = b.schema.field(0).type
            done: list[tuple] = []
            for c, pos, role_, text_ in zip(*(col.to_pylist() for col in b.columns)):
                if pos == 0:
                    if sha is not None:
                        done.append((conv_, sha.hexdigest()))
                    conv_, sha = c, hashlib.sha256()
                else:
                    sha.update(f"{'' if pos == 1 else chr(10)}{role_}:{text_}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], type_), pa.array([s for _, s in done], pa.string())], ["c", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv_], type_), pa.array([sha.hexdigest()])], ["c", "repaired_sha256"])

    hashed = _applied(rows, found).mapInArrow(lean(run), f"c {kind}, repaired_sha256 string").withColumnRenamed("c", "same")
    return found.join(hashed, F.col("c").eqNullSafe(F.col("same"))).drop("same")


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, Column]:
    """Test damage by crc32 of `conv:turn`, a null written as one space: (df with the damaged columns, copies of each row)."""
    space = lambda k: F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    said = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    out = df.select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), F.when(fault == 4, "user").otherwise(space(role)).alias(role), said.alias(text), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
    return out, F.col("copies")
