"""Binary alignments (BAM): a block-compressed stream of records, read without any native library.

Each file is one task that streams it block by block, so memory does not grow with the file; many
files are read side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: letters of CIGAR operations and of packed bases.
CIGAR, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SCHEMA = "read string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, nm int, de double"
_SIZE = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
_KIND = {b"c": "b", b"C": "B", b"s": "h", b"S": "H", b"i": "i", b"I": "I", b"f": "f"}


class Blocks:
    """The uncompressed bytes of a block-compressed file, in order."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file, self.held, self.at = fs.open_input_stream(path, compression=None), b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            head = self.file.read(18)
            if len(head) < 18:
                break
            if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
                raise ValueError("not a block-compressed file")
            extra, size = struct.unpack("<H", head[10:12])[0], struct.unpack("<H", head[16:18])[0] + 1
            body = self.file.read(size - 18)[extra - 6 :]
            self.held, self.at = self.held[self.at :] + zlib.decompress(body[:-8], -15), 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]]]:
    """(header text, name and length of each reference)."""
    if blocks.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = blocks.take(struct.unpack("<i", blocks.take(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", blocks.take(4))[0]):
        name = blocks.take(struct.unpack("<i", blocks.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", blocks.take(4))[0]))
    return text, refs


def _tags(raw: bytes) -> dict[str, float]:
    """The numeric tags of a record."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), raw[at + 2 : at + 3]
        at += 3
        if kind in b"ZH":
            at = raw.index(b"\0", at) + 1
        elif kind == b"B":
            at += 5 + _SIZE[raw[at : at + 1]] * struct.unpack("<i", raw[at + 1 : at + 5])[0]
        else:
            if kind in _KIND:
                out[name] = struct.unpack("<" + _KIND[kind], raw[at : at + _SIZE[kind]])[0]
            at += _SIZE[kind]
    return out


def records(blocks: Blocks, refs: list[tuple[str, int]]) -> Iterator[tuple]:
    name_of = lambda k: refs[k][0] if k >= 0 else "*"
    while len(size := blocks.take(4)) == 4:
        raw = blocks.take(struct.unpack("<i", size)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack("<iiBBHHHiiii", raw[:32])
        at = 32 + l_name
        ops = struct.unpack(f"<{n_cigar}I", raw[at : at + 4 * n_cigar])
        at += 4 * n_cigar
        packed = raw[at : at + (l_seq + 1) // 2]
        tags = _tags(raw[at + len(packed) + l_seq :])
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
        same = next_ref == ref and ref >= 0
        nm, de = tags.get("NM"), tags.get("de")
        yield raw[32 : 31 + l_name].decode(), flag, name_of(ref), pos + 1, mapq, "".join(f"{x >> 4}{CIGAR[x & 15]}" for x in ops) or "*", "=" if same else name_of(next_ref), next_pos + 1, tlen, seq or "*", None if nm is None else int(nm), None if de is None else float(de)


def bam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Alignments with the columns of `formats.sam` (the tags NM and de instead of all), one row each."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        for b in batches:
            for uri in b.column(0).to_pylist():
                blocks = Blocks(uri)
                _, refs = read_header(blocks)
                held = []
                for r in records(blocks, refs):
                    held.append(r)
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held))), schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held))), schema)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    rows = files.mapInArrow(read, SCHEMA)
    return rows.withColumns({"unmapped": bit(4), "reverse": bit(16), "mate_reverse": bit(32), "read1": bit(64), "secondary": bit(256), "supplementary": bit(2048), "proper": bit(2), "duplicate": bit(1024)})


def passing(alignments: DataFrame, min_mapq: int, identity: float, min_length: int) -> DataFrame:
    """Mapped alignments of sufficient quality, percent identity (by the divergence tag) and span on the reference."""
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return alignments.where(~F.col("unmapped") & (F.col("mapq") >= min_mapq) & (F.col("de") <= (100 - identity) / 100) & (span >= min_length))


def sort_order(path: str) -> str | None:
    """The sort order that a BAM header declares."""
    text, _ = read_header(Blocks(path))
    head = next((line for line in text.split("\n") if line.startswith("@HD")), "")
    return next((f[3:] for f in head.split("\t") if f.startswith("SO:")), None)


def require_unsorted(paths: list[str]) -> list[str]:
    """The paths, if all headers say that reads stand as they were sequenced; pairing neighbours needs that."""
    for p in paths:
        if (order := sort_order(p)) != "unsorted":
            raise ValueError(f"{p} should be unsorted, its header says {order}")
    return paths
