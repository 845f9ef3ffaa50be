"""Column functions on nucleotide sequences; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, codons in the order of BASES.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
RESIDUES = "ACDEFGHIKLMNPQRSTVWY*"


def complement(seq: Column) -> Column:
    """Upper-case ACGT change; anything else stays."""
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def transcribe(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def back_transcribe(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def python_slice(seq: Column, start: int, stop: int) -> Column:
    """``seq[start:stop]``: negatives count from the end, bounds are clamped, a crossed range is empty."""
    n = F.length(seq)
    at = lambda k: F.least(n, F.lit(k)) if k >= 0 else F.greatest(F.lit(0), n + k)
    a, b = at(start), at(stop)
    return F.when(b > a, F.substring(seq, a + 1, b - a)).otherwise("")


def codons(seq: Column) -> Column:
    """Consecutive 3-mers, upper-cased; the tail is dropped. One match over the sequence: in a lambda over places, a derived
    sequence would be computed again for each codon."""
    return F.when(F.length(seq) > 2, F.regexp_extract_all(F.upper(seq), F.lit("(?s)..."), F.lit(0))).otherwise(F.array().cast("array<string>"))


def amino_acid(codon: Column) -> Column:
    """One letter, ``*`` for a stop, ``?`` for anything that is no codon."""
    place = [F.instr(F.lit(BASES), F.substring(codon, k, 1)) - 1 for k in (1, 2, 3)]
    bad = (F.length(codon) != 3) | (place[0] < 0) | (place[1] < 0) | (place[2] < 0)
    return F.when(bad, "?").otherwise(F.substring(F.lit(AMINO), place[0] * 16 + place[1] * 4 + place[2] + 1, F.lit(1)))


def translate(seq: Column) -> Column:
    return F.array_join(F.transform(codons(seq), amino_acid), "")


def gc_share(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(seq, "[^GC]", "")) / F.length(seq))


def window_count(length: Column, window: int, stride: int) -> Column:
    """1 below a window's length, else the windows that fit."""
    return F.when(length < window, 1).otherwise(1 + F.floor((length - window) / stride)).cast("int")


def sample_id(name: Column) -> Column:
    """``A__EXT-S1__C`` gives ``S1``."""
    return F.regexp_extract(name, r"__[^_]*-([^_]+)__", 1)


def coding_change(text: Column) -> Column:
    """Struct ``transcript, pos, ref, alt`` of ``T1:c.45A>G``, null for other texts."""
    shape = r"^(?:([^:]*):)?c\.(\d+)([ACGT])>([ACGT])"
    part = lambda k: F.regexp_extract(text, shape, k)
    return F.when(text.rlike(shape), F.struct(F.nullif(part(1), F.lit("")).alias("transcript"), part(2).try_cast("int").alias("pos"), part(3).alias("ref"), part(4).alias("alt")))


def gene_prefix(name: Column) -> Column:
    """What stands before the first digit."""
    return F.regexp_extract(name, r"^([^0-9]*)", 1)


def bin_of(value: Column, scale: float, missing: int = -1000) -> Column:
    """The value times ``scale``, truncated; ``missing`` for null and NaN."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), missing).otherwise((value * scale).cast("int"))


def strict_reverse_complement(seq: Column) -> Column:
    """Upper-cased first; a base that isn't one of ACGTN fails the job."""
    up = F.upper(seq)
    return F.when(up.rlike("[^ACGTN]"), F.raise_error(F.concat(F.lit("invalid base in "), F.substring(up, 1, 50))).cast("string")).otherwise(reverse_complement(up))


def amino_ids(seq: Column) -> Column:
    """The place of each codon's residue in RESIDUES, -1 where there is none."""
    return F.transform(codons(seq), lambda c: F.instr(F.lit(RESIDUES), amino_acid(c)) - 1)


def untranslated(seq: Column, five: Column, coding: Column) -> Column:
    """Struct ``five, coding, three`` of a transcript cut by the sizes of its first two parts."""
    return F.struct(F.substring(seq, F.lit(1), five).alias("five"), F.substring(seq, five + 1, coding).alias("coding"), F.substring(seq, five + coding + 1, F.length(seq)).alias("three"))


def term_id(text: Column) -> Column:
    """``GO:0001`` of ``a name [GO:0001]``, else null."""
    return F.nullif(F.regexp_extract(text, r"\[(GO:\d+)\]", 1), F.lit(""))


def term_name(text: Column) -> Column:
    """What stands before the bracket."""
    return F.trim(F.regexp_replace(text, r"\s*\[GO:\d+\].*$", ""))


def variant_id(*parts: Column) -> Column:
    return F.concat_ws("_", *(p.cast("string") for p in parts))


def unversioned(name: Column) -> Column:
    """What stands before the first point."""
    return F.split_part(name, F.lit("."), F.lit(1))
