"""Functions of nucleotide strings and CIGARs; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, T C A G order (fixed values).
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
#: IUPAC codes of pairs of bases (fixed values).
IUPAC = {"AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M"}


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgtN", "TGCAtgcaN"))


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def gc_content(s: Column) -> Column:
    """gc / (gc + at), case-insensitive; null if there is none of the four."""
    gc = F.length(F.regexp_replace(s, "[^GCgc]", ""))
    at = F.length(F.regexp_replace(s, "[^ATat]", ""))
    return F.try_divide(gc.cast("double"), (gc + at).cast("double"))


def iupac(a: Column, b: Column) -> Column:
    """Code of two bases: a base with itself is itself, an unknown pair N."""
    pair = F.concat(F.least(a, b), F.greatest(a, b))
    out = F.lit("N")
    for k, v in IUPAC.items():
        out = F.when(pair == k, v).otherwise(out)
    return F.when(a == b, a).otherwise(out)


def translate_codon(codon: Column) -> Column:
    """Amino acid letter, * for stop, X for anything else."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(codon)), F.lit("X"))


def translate_sequence(s: Column) -> Column:
    """All whole codons of a sequence."""
    codons = F.filter(F.regexp_extract_all(s, F.lit("(...)")), lambda c: F.length(c) == 3)
    return F.array_join(F.transform(codons, translate_codon), "")


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order."""
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>> of a CIGAR string; * and null give an empty array."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"))
    return F.transform(parts, lambda p: F.struct(F.substr(p, F.lit(1), F.length(p) - 1).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def reference_length(ops: Column) -> Column:
    """Bases of the reference that the operations consume."""
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin("M", "D", "N", "=", "X")), F.lit(0), lambda s, o: s + o["len"])


def query_length(ops: Column) -> Column:
    """Bases of the read that the operations consume."""
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin("M", "I", "S", "=", "X")), F.lit(0), lambda s, o: s + o["len"])


def leading_clip(ops: Column) -> Column:
    """Clipped bases in front of the first other operation."""
    walk = F.aggregate(ops, F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")),
                       lambda s, o: F.struct(F.when(~s["done"] & o["op"].isin("S", "H"), s["n"] + o["len"]).otherwise(s["n"]).alias("n"), (s["done"] | ~o["op"].isin("S", "H")).alias("done")))
    return walk["n"]


def unclipped_five_prime(pos: Column, ops: Column, reverse: Column) -> Column:
    """5' end as if nothing were clipped: start minus leading clips, or the last base plus trailing clips on the reverse strand."""
    forward = pos - leading_clip(ops)
    backward = pos + reference_length(ops) - 1 + leading_clip(F.reverse(ops))
    return F.when(reverse, backward).otherwise(forward)


def good_cigar(cigar: Column) -> Column:
    """No zero length, no N, no adjacent insertion and deletion, no deletion at an edge (clips aside)."""
    bad = cigar.rlike("(?:^|[A-Z=])0+[A-Z=]") | cigar.contains("N") | cigar.rlike("[0-9]+[ID][0-9]+[ID]") | cigar.rlike("^(?:[0-9]+[SH])*[0-9]+D") | cigar.rlike("D(?:[0-9]+[SH])*$")
    return ~bad


def context_covariate(bases: Column, quals: Column, offset: Column, size: int, low_tail: int, reverse: Column) -> Column:
    """The ``size`` bases that end at an offset in sequencing direction; null where the tail is low-quality or too short."""
    clean = F.array_join(F.zip_with(F.split(bases, ""), quals, lambda b, q: F.when(q <= low_tail, "N").otherwise(b)), "")
    s = F.when(reverse, reverse_complement(clean)).otherwise(clean)
    piece = F.substr(s, offset - size + 2, F.lit(size))
    return F.when((offset + 1 >= size) & ~piece.contains("N"), piece)


def cycle_covariate(offset: Column, length: Column, read2: Column, reverse: Column) -> Column:
    """Signed cycle: 1, 2, ... forward; from the read's length down on the reverse strand; negative for second reads."""
    f = F.when(read2, -1).otherwise(1)
    return F.when(reverse, length * f - offset * f).otherwise(f + offset * f)
