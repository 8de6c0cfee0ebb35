"""Token ids in seekable binary files: one zstandard frame per document, checksums, trailing seek table.

A file is
    frame of document 0, frame of document 1, ...     (independent zstandard frames with content checksums)
    skippable frame 0x184D2A50: the directory         (id width, null flags and document ids, zstandard-compressed)
    skippable frame 0x184D2A5E: the seek table        (per frame: compressed size, raw size, low 32 bits of XXH64)
so any zstandard tool can decode the ids, and a reader that wants a few documents reads the tail and
then only their frames. Documents lie in ascending id over all files; a manifest gives each file's
first token position.

Defined cases: a null text counts as empty and yields the end id alone; rows with a null id come
first; rows that share an id are all kept, ordered by length, then bytes, in each file (an id, or null,
with more rows than a file's share has several files); an empty table gives no files.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import filterfalse
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._shared import lean, parts, small_batches, worker_keeps

DIRECTORY_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Distinct words whose ids a Python worker remembers at most (some 100 MB).
CACHE_WORDS = 400_000
#: Marks that are split from an alphanumeric word before it is looked up; the models below split there too.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of Latin letters (below U+0240) alone, upper case among the non-ASCII ones too: they are their own normal form.
LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u023f]+").fullmatch
#: UTF-8 of what isn't a letter there or folds to two; kinds of bytes: 2 marks, 4 digits, 8 Latin letters beyond ASCII, 0 other letters, 1 the rest.
NOT_PLAIN = re.compile(b"\xc3\x97|\xc3\xb7|\xc4\xb0").finditer
KINDS = bytes(0 if 97 <= b <= 122 else 4 if 48 <= b <= 57 else 2 if chr(b) in MARKS else 8 if 0x80 <= b < 0xC0 or 0xC3 <= b < 0xC9 else 1 for b in range(256))
#: A-Z folded, ASCII white space as spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Words that the model gets at once, and bytes of texts that are split at once (or one text, if longer).
LOT, LOT_BYTES = 4000, 2 << 20
PROBE = "It's a'b x1. Y,\t2\n<|end é́ ́c, d.E\rf THE!? (q) 1.5 ..a"


def _bytes_of(strings: pa.LargeStringArray) -> tuple[bytes, np.ndarray]:
    """The bytes of an array of strings, and where each begins, with the end of the last."""
    starts = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset :][: len(strings) + 1]
    first, last = int(starts[0]), int(starts[-1])
    return strings.buffers()[2].slice(first, last - first).to_pybytes() if last > first else b"", starts - first


def _strings(starts: np.ndarray, data: bytes) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64).tobytes()), pa.py_buffer(data))


def _gathered(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these sizes that lie in `flat`, those numbered `at` in turn, and their sizes."""
    begin, much = np.cumsum(size) - size, size[at]
    upto = np.cumsum(much)
    return flat[np.repeat(begin[at] - upto + much, much) + np.arange(upto[-1] if len(upto) else 0)], much


def stems(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded words parted from the marks at their ends: all places where pieces begin (and the end), and which words are parted.

    A word is parted where the model does so for sure: its stem is ASCII letters and digits, or Latin letters alone.
    """
    n = len(starts) - 1
    kind = bytearray(data.translate(KINDS))
    for m in NOT_PLAIN(data):
        kind[m.start()] = 1
    kind = np.frombuffer(kind, np.uint8)
    held = lambda bit: np.diff(np.concatenate(([0], np.cumsum(kind & bit, dtype=np.int32)))[starts]) // bit
    counts = {bit: held(bit) for bit in (1, 2, 4, 8)}  # of other bytes, marks, digits, bytes beyond ASCII
    last = np.maximum.accumulate(np.where(kind & 2, -1, np.arange(len(kind)))) if len(kind) else np.zeros(0, np.int64)
    ends = starts[1:]
    some = ends > starts[:-1]
    stem = np.where(some, last[np.maximum(ends, 1) - 1] + 1 if len(kind) else 0, 0)
    parted = some & (stem > starts[:-1]) & (ends - stem == counts[2]) & (counts[2] > 0) & (counts[1] == 0) & ((counts[4] == 0) | (counts[8] == 0))
    places = np.concatenate((starts, np.zeros(int(parted.sum()), np.int64)))
    places[n + 1 :] = stem[parted]
    return np.sort(places, kind="stable"), parted.astype(np.int64)


class WordEncoder:
    """Encodes whole texts with a `tokenizers` model through a bounded memo of white-space-delimited words.

    The models this serves drop ASCII white space, fold case and split marks from words before BPE,
    so the ids of a text are those of its lower-cased words in turn. Whether that holds is probed for
    a model; where it doesn't, and for texts that may hold a special token, whole texts are encoded.

    A lot of texts is split and dictionary-encoded by Arrow, its distinct words are looked up or learned,
    and the ids are gathered by offsets. The memo has two halves: words met since the last turn, and
    those met before; when the newer half is full, the older one is forgotten.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.model.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        self.end_id, self.width = end_id, np.dtype(self.dtype).itemsize
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A copy for words of letters: it parts at white space alone, which is all that splits those.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.ends = np.array([bool(suffix) and t.endswith(suffix) for _, t in sorted((i, t) for t, i in self.model.get_vocab().items())])
        special = sorted((i, t.content) for i, t in self.model.get_added_tokens_decoder().items() if t.special)
        self.cut_id, self.cut = special[0] if special else (0, "")
        one = lambda w: self.model.encode(w, add_special_tokens=False).ids
        words = PROBE.encode().lower().split()
        cuts, _ = stems(b"".join(words), np.cumsum([0, *map(len, words)]))
        self.exact = self.cut.startswith("<|") and one(PROBE) == [i for w in _strings(cuts, b"".join(words)).to_pylist() for i in one(w)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Put these pieces into the memo; the model gets them in lots."""
        memo, width = self.memo, self.width
        plain = list(filter(LETTERS, new))
        rest = list(filterfalse(LETTERS, new))
        for at in range(0, len(plain), LOT):
            some = plain[at : at + LOT]
            ids = np.array(self.letters.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            cuts = (width * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):  # not a model that marks the ends of words
                rest += some
                continue
            raw = ids.astype(self.dtype).tobytes()
            memo.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        for at in range(0, len(rest), LOT):
            some = rest[at : at + LOT]
            ids = np.array(self.model.encode_batch_fast([self.cut.join(some)], add_special_tokens=False)[0].ids, np.int64)
            cuts = width * np.flatnonzero(ids == self.cut_id)
            raw = ids.astype(self.dtype).tobytes()
            memo.update(zip(some, (raw[i:j] for i, j in zip([0, *(cuts + width).tolist()], [*cuts.tolist(), len(raw)])), strict=True))

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pieces of words, as bytes."""
        if len(self.memo) + len(words) > CACHE_WORDS // 2:
            self.older, self.memo = self.memo, {}
        memo = self.memo
        memo[""] = b""
        got = list(map(memo.get, words))
        if None in got:
            unknown = [w for w, x in zip(words, got) if x is None]
            before = list(map(self.older.get, unknown))
            memo.update(filter(itemgetter(1), zip(unknown, before)))
            self._learn([w for w, x in zip(unknown, before) if not x])
            got = list(map(memo.__getitem__, words))
        return got

    def encode_lot(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id appended; where each text's ids begin, and the end of the last)."""
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) if self.exact else np.ones(len(texts), bool)
        data, starts = _bytes_of(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        lists = pc.split_pattern(_strings(starts, data.translate(FOLD)), " ")
        codes = lists.flatten().dictionary_encode()
        data, starts = _bytes_of(codes.dictionary)
        cuts, parted = stems(data, starts)
        pieces = _strings(cuts, data).dictionary_encode()
        flat, size = self._gather(self._ids_of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pieces.indices.to_numpy())
        size = np.add.reduceat(size, np.cumsum(1 + parted) - 1 - parted) if len(parted) else size  # of words, from their pieces
        # More "words", which no text has: the end id, and the ids of each text that is encoded whole.
        more = [np.array([self.end_id], self.dtype).tobytes(), *(self._whole(texts[k].as_py()) for k in np.flatnonzero(whole).tolist())]
        size = np.concatenate((size, np.fromiter(map(len, more), np.int64, len(more)) // self.width))
        flat = np.concatenate((flat, np.frombuffer(b"".join(more), self.dtype)))
        offsets = np.asarray(lists.offsets).astype(np.int64)
        after = 1 + whole.astype(np.int64)  # what each text has after its words
        last = np.cumsum(after) - 1
        extra = np.full(int(after.sum()), len(codes.dictionary), np.int64)
        extra[last[whole] - 1] += 1 + np.arange(int(whole.sum()))
        at = np.insert(codes.indices.to_numpy().astype(np.int64), np.repeat(offsets[1:] - offsets[0], after), extra)
        ids, much = _gathered(flat, size, at)
        return ids, np.concatenate(([0], np.cumsum(much)[offsets[1:] - offsets[0] + last]))

    def _gather(self, lots: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, lots), np.int64, len(lots)) // self.width
        return _gathered(np.frombuffer(b"".join(lots), self.dtype), size, at)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (none null) with the end id appended, as little-endian bytes."""
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        lot = (np.cumsum(size) - size) // LOT_BYTES  # by where a text begins, so a lot has at most one text more than LOT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(texts)] if len(texts) else []
        out: list[bytes] = []
        for at, end in zip(cuts, cuts[1:]):
            ids, ends = self.encode_lot(texts.slice(at, end - at))
            raw, ends = ids.tobytes(), (ends * self.width).tolist()
            out += map(raw.__getitem__, map(slice, ends, ends[1:]))
        return out


def encoder(path: str, end_id: int) -> WordEncoder:
    """The worker's encoder, kept from task to task until another operator needs the room."""
    return worker_keeps("token_frames", (path, end_id), lambda: WordEncoder(path, end_id))


def seek_table(sizes: list[tuple[int, int, int]]) -> bytes:
    """The trailing skippable frame for (compressed size, raw size, checksum) of each frame."""
    body = np.array(sizes, "<u4").tobytes() + struct.pack("<IBI", len(sizes), 0x80, FOOTER_MAGIC)
    return struct.pack("<II", SEEK_MAGIC, len(body)) + body


def directory(ids: list[int | None], width: int) -> bytes:
    raw = struct.pack("<B", width) + np.array([i is None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()
    body = zstandard.ZstdCompressor(write_checksum=True).compress(raw)
    return struct.pack("<II", DIRECTORY_MAGIC, len(body)) + body


class FrameFile:
    """Reads one file: `ids`, and `frames()` for all documents or the positions asked for."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        at = size - 9 - 12 * n
        self.sizes = np.frombuffer(self.file.read_at(12 * n, at), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes[:, 0])))
        end = int(self.starts[-1])
        magic, length = struct.unpack("<II", self.file.read_at(8, end))
        if magic != DIRECTORY_MAGIC:
            raise ValueError(f"{uri} has no directory")
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, end + 8))
        self.dtype = f"<u{raw[0]}"
        ids = np.frombuffer(raw, "<i8", n, 1 + n)
        self.ids = [None if null else int(i) for null, i in zip(raw[1 : 1 + n], ids)]

    def frames(self, positions: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, ids) of the documents at these positions; nothing else is read or decompressed."""
        unzip = zstandard.ZstdDecompressor()
        for k in range(len(self.ids)) if positions is None else positions:
            packed, size, check = (int(x) for x in self.sizes[k])
            raw = unzip.decompress(self.file.read_at(packed, int(self.starts[k])), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            yield k, np.frombuffer(raw, self.dtype)

    def document(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each row of this document."""
        return [x for _, x in self.frames([k for k, i in enumerate(self.ids) if i == doc_id])]


def write_token_frames(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> list[dict]:
    """Encode every text and write the files under `out`; returns the manifest (a row per file).

    Texts are encoded and compressed where they are read; only finished frames move, once, to the
    file that holds their id range. The ranges come from quantiles of the id column alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = parts(spark)
    least = np.iinfo(np.int64).min  # stands for null
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(least))).alias("doc_id"))
    cuts, shares = np.unique(np.array(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [], np.float64).astype(np.int64), return_counts=True)
    # File 0 has the ids below all cuts. An id on m > 1 cuts has so many rows that it gets m files, by a hash of its frames.
    first = 1 + np.cumsum(np.where(shares > 1, shares + 1, 1)) - np.where(shares > 1, shares + 1, 1)
    files = int(first[-1] + (shares[-1] + 1 if shares[-1] > 1 else 1)) if len(cuts) else 1

    def placed_at(ids: np.ndarray, hashes: list[int]) -> np.ndarray:
        at = np.searchsorted(cuts, ids, side="right") - 1
        out = np.where(at < 0, 0, first[at]) if len(cuts) else np.zeros(len(ids), np.int64)
        for k in np.flatnonzero((at >= 0) & (shares[at] > 1)) if len(cuts) else ():
            out[k] += (hashes[k] * int(shares[at[k]])) >> 64 if ids[k] == cuts[at[k]] else shares[at[k]]
        return out

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, zip_ = encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=level, write_checksum=True)
        for b in batches:
            ids, width = b.column(0), coder.width
            raw = coder.encode(pc.fill_null(b.column(1), ""))
            hashes = list(map(xxhash.xxh64_intdigest, raw))
            place = placed_at(pc.fill_null(ids, int(least)).to_numpy(), hashes)
            yield pa.RecordBatch.from_arrays([ids, pa.array(place, pa.int32()), pa.array([len(x) // width for x in raw], pa.int64()), pa.array([width] * len(raw), pa.int32()), pa.array([h & 0xFFFFFFFF for h in hashes], pa.int64()), pa.array(map(zip_.compress, raw), pa.binary())], ["doc_id", "part", "n_tokens", "width", "checksum", "frame"])

    frames = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(encode), "doc_id long, part int, n_tokens long, width int, checksum long, frame binary")
    placed = frames.repartitionById(files, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, ids, sink, part, tokens, width = [], [], None, None, 0, 2
        fs, root = pafs.FileSystem.from_uri(out)
        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                part, width = b.column(1)[0].as_py(), b.column(3)[0].as_py()
                fs.create_dir(root, recursive=True)
                task = TaskContext.get()
                draft = f"{root}/.part-{part:06d}.{task.taskAttemptId() if task else 0}"
                sink = fs.open_output_stream(draft)
            tokens += pc.sum(b.column(2)).as_py()
            ids += b.column(0).to_pylist()
            for count, check, frame in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5)):
                frame = frame.as_buffer()
                sizes.append((frame.size, count * width, check))
                sink.write(frame)
        if sink is not None:
            sink.write(directory(ids, width))
            sink.write(seek_table(sizes))
            sink.close()
            fs.move(draft, f"{root}/part-{part:06d}.zst")  # an attempt's file appears whole or not at all
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    done = sorted(placed.mapInArrow(lean(write), "part int, n_docs long, n_tokens long").collect(), key=lambda r: r.part)  # a row per file
    manifest, start = [], 0
    for r in done:
        manifest.append({"file": f"part-{r.part:06d}.zst", "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": start})
        start += r.n_tokens
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_frames(spark: SparkSession, out: str, wanted: list[int] | None = None) -> DataFrame:
    """A row per stored document: doc_id, start, n_tokens, ids_crc32, ids; `wanted` reads those frames only."""
    fs, root = pafs.FileSystem.from_uri(out)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    keep = None if wanted is None else set(wanted)
    small_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = FrameFile(f"{out}/{name}")
                width = np.dtype(f.dtype).itemsize
                starts = base + np.concatenate(([0], np.cumsum(f.sizes[:, 1] // width)))
                at = [k for k in range(len(f.ids)) if keep is None or f.ids[k] in keep]
                for k in range(0, len(at), 64):
                    got = [(f.ids[p], int(starts[p]), len(x), zlib.crc32(x.astype("<u4")), x) for p, x in f.frames(at[k : k + 64])]
                    cols = list(zip(*got))
                    flat = np.concatenate(cols[4]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(cols[2]))), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), lists], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long")
    return files.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
