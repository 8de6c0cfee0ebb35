"""Column functions over sequences: motifs, windows, k-mers, complements."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complement pairs.
BASES, COMPLEMENTS = "ATCGNatcgn", "TAGCNtagcn"


def motif_count(seq: Column, motif: str) -> Column:
    """Non-overlapping, case-insensitive occurrences of a motif, counted from 1."""
    low = F.lower(seq)
    return ((F.length(low) - F.length(F.replace(low, F.lit(motif.lower()), F.lit("")))) / len(motif) + 1).cast("long")


def expand_motif(motif: str, bases: str = "ATCG") -> list[str]:
    """Each N of a motif replaced by every base; several motifs are split by commas."""
    return [m for one in motif.split(",") for m in ("".join(x) for x in product(*(bases if c == "N" else c for c in one)))]


def motifs_count(seq: Column, motif: str) -> Column:
    return sum((motif_count(seq, m) - 1 for m in expand_motif(motif)), F.lit(1).cast("long"))


def flank_motif_count(seq: Column, motif: str, flank: int) -> Column:
    """Motifs of the first and last `flank` characters; of the whole sequence if it is no longer than both."""
    ends = motif_count(F.left(seq, F.lit(flank)), motif) + motif_count(F.right(seq, F.lit(flank)), motif) - 1
    return F.when(F.length(seq) <= 2 * flank, motif_count(seq, motif)).otherwise(ends)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def windows(length: Column, width: int) -> Column:
    """Array of 1-based closed windows (s, e), the last one short."""
    starts = F.when(length > 0, F.sequence(F.lit(1).cast("long"), length.cast("long"), F.lit(width).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.least(s + width - 1, length.cast("long")).alias("e")))


def gc_percent(seq: Column) -> Column:
    """Whole percent of G and C, cut off."""
    return F.floor(F.regexp_count(seq, F.lit("[GCgc]")) * 100 / F.length(seq))


def kmers(seq: Column, k: int) -> Column:
    """Array of all k-mers of a sequence, by a look-ahead that goes over it once, one whole character a step."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def allele_type(a: Column, b: Column) -> Column:
    """Identical, InDel, SNP_transition (A-G, C-T) or SNP_transversion."""
    pair = F.concat(F.least(a, b), F.greatest(a, b))
    return F.when(a == b, "Identical").when(F.length(a) != F.length(b), "InDel").when(pair.isin("AG", "CT"), "SNP_transition").otherwise("SNP_transversion")


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS."""
    p = F.split(text, ":")
    return p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")
