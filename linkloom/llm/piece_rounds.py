"""SentencePiece byte-pair encoding and decoding of whole texts by vectorised merge rounds.

A text is parted into words before each space and around each line break, where no piece can cross; a lot's distinct words
become one flat numpy array of symbols, parted further between characters that stand together in no piece.
In each round every part takes its least rank (the best score of a piece that two neighbours form) by a segmented minimum, and
all leftmost places of that rank merge at once, up to the first place whose new neighbours form a piece of a better or equal
rank, as that one comes first in the sequential order. Then the symbols are compacted, parts without a pair leave. Runs of
lone spaces are merged last, as pieces with inner spaces have the lowest score.

Defined cases: a null text counts as empty and has the end id alone; very long texts are encoded whole, one lot each; repeated
rows are each encoded; characters outside the vocabulary become byte pieces; an empty table gives no rows; other columns, of
whatever name, stay, and a column that already has the name of the result is replaced. Ties of score go to the left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm._shared import small_batches, worker_keeps
from linkloom.llm.token_frames import _bytes_of, _gathered, _strings

SPACE = "▁"
#: Bytes of texts that are encoded at once (or one text, if longer).
LOT_BYTES = 2 << 20
#: Rank of what is no pair.
NONE = np.iinfo(np.int32).max
PROBE = "It's  a   test,\n\tof 1234 pieces ▁ été 中文字 \U0001f600 \x00 zzzzzzzz       the<s> aaaaaaa antidisestablishmentarianism. "


class PairTable:
    """The piece that two neighbouring pieces form, by open addressing in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, piece: np.ndarray):
        self.bits = max(10, int(8 * len(piece)).bit_length())
        self.key, self.piece = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, todo = self._spot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.key[at[todo]] < 0]
            self.key[at[free]] = key[free]  # of several on one spot the last stays
            done = self.key[at[todo]] == key[todo]
            self.piece[at[todo[done]]] = piece[todo[done]]
            todo = todo[~done]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pieces formed by left and right in turn, -1 where there is none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._spot(key)
        found = self.key[at]
        out = np.where(found == key, self.piece[at], -1)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.piece[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class PieceCoder:
    """Encodes and decodes with a SentencePiece byte-pair model whose pieces hold spaces in front alone, or are runs of spaces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.end_id = model.eos_id()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte = np.array([model.is_byte(i) for i in range(size)])
        self.silent = np.array([model.is_control(i) for i in range(size)])
        special = self.byte | self.silent | np.array([model.is_unknown(i) for i in range(size)])
        own = {p: i for i, p in enumerate(names) if not special[i]}
        score = np.array([model.get_score(i) for i in range(size)])
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        runs = [i for p, i in own.items() if len(p) > 1 and not p.strip(SPACE)]
        inner = [i for p, i in own.items() if SPACE in p[1:]]
        if set(inner) - set(runs) or (runs and max(score[runs]) >= min((score[i] for p, i in own.items() if len(p) > 1 and p.strip(SPACE)), default=0)):
            raise ValueError("pieces with spaces inside must be runs of spaces of the lowest scores")
        pairs = [(own[p[:k]], own[p[k:]], i) for p, i in own.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own]
        self.rank = np.append(rank, np.int32(NONE))  # the last is the rank of piece -1
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        # Ids of characters; those without a piece get ids beyond all pieces, so that they form no pair.
        self.size = size
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in own.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        together = np.array(sorted({(self.of_char[ord(p[k])], self.of_char[ord(p[k + 1])]) for p in own for k in range(len(p) - 1)}), np.int64)
        self.together = PairTable(together[:, 0], together[:, 1], np.zeros(len(together), np.int64))
        self.space = self.of_char[ord(" ")] = own[SPACE]
        self.of_byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # What a piece says in a text, as bytes in one array.
        said = [bytes([int(p[3:5], 16)]) if self.byte[i] else b"" if self.silent[i] else " ⁇ ".encode() if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.said_size = np.fromiter(map(len, said), np.int64, size)
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.leads = np.array([not special[i] and p.startswith(SPACE) for i, p in enumerate(names)])
        longest = max([1, *(len(names[i]) for i in runs)])
        self.runs = {k: self._pieces(pa.array([" " * k], pa.large_string()))[0] for k in range(1, 4 * longest + 1)}
        self.longest = longest if all(np.array_equal(self.runs[k], np.concatenate((self.runs[longest], self.runs[k - longest]))) for k in range(longest + 1, 4 * longest + 1)) else 0
        if self.encode([PROBE]).to_pylist() != [model.encode(PROBE) + [self.end_id]]:
            raise ValueError(f"{path} is no model of the kind that merge rounds encode")

    def _rounds(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each part of `sym` until no pair remains: (symbols of all parts in turn, and how many each has)."""
        out, count = sym.copy(), np.zeros(len(start), np.int64)
        size = np.diff(np.append(start, len(sym)))
        part, home = np.arange(len(start)), start.copy()  # number and place in `out` of the parts that are still open
        last = np.zeros(len(sym), bool)
        last[start + size - 1] = True
        made = np.where(last, -1, self.pairs.find(sym, np.append(sym[1:], 0)))
        while len(part):
            rank = self.rank[made]
            least = np.minimum.reduceat(rank, start)
            open_ = least < NONE
            if not open_.all():  # parts without a pair leave
                keep = np.repeat(open_, size)
                done = ~open_
                count[part[done]] = size[done]
                flat = sym[~keep]
                out[np.repeat(home[done] - (np.cumsum(size[done]) - size[done]), size[done]) + np.arange(len(flat))] = flat
                sym, made, last, rank = sym[keep], made[keep], last[keep], rank[keep]
                part, home, size, least = part[open_], home[open_], size[open_], least[open_]
                start = np.cumsum(size) - size
                if not len(part):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            fresh = np.append(True, np.diff(at) > 1)  # runs of overlapping places: every second one merges
            begin = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            new = made[at]
            owner = np.searchsorted(start, at, "right") - 1
            many = np.append(owner[1:] == owner[:-1], False) | np.append(False, owner[1:] == owner[:-1])
            if many.any():  # places after the first whose new neighbours come sooner wait for the next round
                m = np.flatnonzero(many)
                p, n, r = at[m], new[m], self.rank[new[m]]
                touch = (m > 0) & (at[m - 1] == p - 2)
                no_left = (p == start[owner[m]])
                before = np.where(touch, new[m - 1], sym[p - 1])
                worse = (self.rank[np.where(no_left, -1, self.pairs.find(before, n))] <= r) | (self.rank[np.where(last[p + 1], -1, self.pairs.find(n, sym[np.minimum(p + 2, len(sym) - 1)]))] <= r)
                bad = np.zeros(len(at), np.int64)
                bad[m] = worse
                seen = np.cumsum(bad) - bad
                first = np.append(True, owner[1:] != owner[:-1])
                at_first = np.repeat(seen[first], np.diff(np.append(np.flatnonzero(first), len(at))))
                keep = seen == at_first
                at, new, owner = at[keep], new[keep], owner[keep]
            sym[at] = new
            last[at] = last[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, made, last = sym[stay], made[stay], last[stay]
            size = size - np.bincount(owner, minlength=len(part))
            start = np.cumsum(size) - size
            at = place[at]
            renew = np.concatenate((at, at[at > 0] - 1))
            made[renew] = np.where(last[renew], -1, self.pairs.find(sym[renew], sym[np.minimum(renew + 1, len(sym) - 1)]))
        return out, count

    def _pieces(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words (none empty) in turn, and how many each has."""
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        code = np.frombuffer(_bytes_of(words)[0].decode().encode("utf-32-le"), np.uint32)
        sym = self.of_char[code].astype(np.int64)
        unknown = np.flatnonzero(sym < 0)
        sym[unknown] = self.size + code[unknown]
        head = np.zeros(len(sym), bool)
        head[1:] = self.together.find(sym[:-1], sym[1:]) < 0
        head[np.cumsum(size) - size] = True
        start = np.flatnonzero(head)
        out, count = self._rounds(sym, start)
        flat = out[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        mine = np.repeat(np.searchsorted(np.cumsum(size), start, "right"), count)  # the word of each id
        lone = np.flatnonzero(flat >= self.size)  # characters as bytes
        if len(lone):
            raw, ends = _bytes_of(pa.array(map(chr, (flat[lone] - self.size).tolist()), pa.large_string()))
            n = np.ones(len(flat), np.int64)
            n[lone] = np.diff(ends)
            flat, mine, byte = np.repeat(flat, n), np.repeat(mine, n), np.repeat(flat >= self.size, n)
            flat[byte] = self.of_byte[np.frombuffer(raw, np.uint8)]
        return flat, np.bincount(mine, minlength=len(words))

    def _run(self, k: int) -> np.ndarray:
        """Ids of k lone spaces in a row."""
        if k in self.runs:
            return self.runs[k]
        if not self.longest:
            return self._pieces(pa.array([" " * k], pa.large_string()))[0]
        n = k // self.longest - 1
        return np.concatenate((np.tile(self.runs[self.longest], n), self.runs[k - n * self.longest]))

    def _lot(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these texts with the end id after each, and how many each has."""
        texts = pc.replace_substring(texts.cast(pa.large_string()), SPACE, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        data, starts = _bytes_of(texts)
        raw = np.frombuffer(data, np.uint8)
        cut = raw == 32
        line = raw == 10
        cut |= line
        cut[1:] |= line[:-1]
        cut[starts[:-1][starts[:-1] < len(raw)]] = True
        cuts = np.flatnonzero(cut)
        words = _strings(np.append(cuts, len(raw)), data).dictionary_encode()
        flat, size = _gathered(*self._pieces(words.dictionary), words.indices.to_numpy().astype(np.int64))
        upto = np.concatenate(([0], np.cumsum(size)))
        begin = upto[np.searchsorted(cuts, starts)]  # where each text's ids begin, and the end
        lone = flat == self.space
        if (lone[1:] & lone[:-1]).any():
            flat, begin = self._merge_runs(flat, begin, lone)
        much = np.diff(begin)
        return np.insert(flat, begin[1:], self.end_id).astype(np.int32), much + 1

    def _merge_runs(self, flat: np.ndarray, begin: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        head = np.ones(len(flat), bool)
        head[1:] = ~(lone[1:] & lone[:-1])
        head[begin[:-1][begin[:-1] < len(flat)]] = True
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(flat)))
        kinds, kind = np.unique(length, return_inverse=True)
        runs = [self._run(int(k)) for k in kinds]
        value, size = _gathered(np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs)), kind)
        upto = np.concatenate(([0], np.cumsum(size)))
        single = length == 1
        value[upto[:-1][single]] = flat[at[single]]
        return value, upto[np.searchsorted(at, begin)]

    def encode(self, texts: list[str] | pa.Array) -> pa.LargeListArray:
        """Ids of each text (none null), the end id last."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        lot = (np.cumsum(size) - size) // LOT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(texts)] if len(texts) else []
        lots = [self._lot(texts.slice(at, end - at)) for at, end in zip(cuts, cuts[1:])] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        ids, much = (np.concatenate(x) for x in zip(*lots))
        return pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(much))), ids)

    def decode(self, lists: pa.Array) -> pa.LargeStringArray:
        """The text of each list of ids: a first space that the encoder adds is left out, bytes that are no UTF-8 become U+FFFD."""
        offsets = np.asarray(lists.offsets).astype(np.int64)
        offsets, ids = offsets - offsets[0], np.asarray(lists.flatten()).astype(np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < self.size):
            raise ValueError("an id is outside the vocabulary")
        much = np.diff(offsets)
        heard = np.flatnonzero(~self.silent[ids])
        first = np.append(heard, len(ids))[np.searchsorted(heard, offsets[:-1])]  # the first id of each list that says something
        strip = first < offsets[1:]
        strip[strip] = self.leads[ids[first[strip]]]
        raw, size = _gathered(self.said, self.said_size, ids)
        upto = np.concatenate(([0], np.cumsum(size)))
        keep = np.ones(len(raw), bool)
        keep[upto[first[strip]]] = False
        ends = upto[offsets] - np.concatenate(([0], np.cumsum(strip)))
        data = raw[keep].tobytes()
        try:
            if self.byte[ids].any():
                data.decode()
            return _strings(ends, data)
        except UnicodeDecodeError:
            return pa.array([self._careful(ids[a:b], s) for a, b, s in zip(offsets, offsets[1:], strip)], pa.large_string())

    def _careful(self, ids: np.ndarray, strip: bool) -> str:
        out, run = [], b""
        begin = np.cumsum(self.said_size) - self.said_size
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.byte[i]:
                run += self.said[begin[i] : begin[i] + 1].tobytes()
                continue
            while run:
                for n in range(1, 5):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                run = run[n:]
            if i >= 0:
                out.append(self.said[begin[i] : begin[i] + self.said_size[i]].tobytes().decode())
        text = "".join(out)
        return text[1:] if strip else text


def coder(path: str) -> PieceCoder:
    """The worker's coder, kept from task to task until another operator needs the room."""
    return worker_keeps("piece_rounds", path, lambda: PieceCoder(path))


def encoded(text: Column, path: str) -> Column:
    """Ids of a text column by the model file at `path`, with the end id."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return coder(path).encode(texts).cast(pa.list_(pa.int32()))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def decoded(ids: Column, path: str) -> Column:
    """The text of a column of id lists; null stays null."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        got = coder(path).decode(pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists).cast(pa.string())
        return pc.if_else(pc.is_valid(lists), got, None) if lists.null_count else got

    return run(ids)


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of its whole texts as column `out`."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, encoded(F.col(f"`{text_col}`"), path))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the texts of its id lists as column `out`."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, decoded(F.col(f"`{ids_col}`"), path))
