"""Named read filters and filter chains; each is a Boolean Column over the reads' columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import cigar_ops, good_cigar, query_length, reference_length

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800


def has(flag: int, column: str = "flag") -> Column:
    return F.col(column).bitwiseAND(flag) != 0


def unmapped() -> Column:
    return has(UNMAPPED) | F.col("contig").isNull() | (F.col("contig") < 0) | F.col("pos").isNull() | (F.col("pos") < 0)


def mate_unmapped() -> Column:
    return has(MATE_UNMAPPED) | F.col("mate_contig").isNull() | (F.col("mate_contig") < 0) | F.col("mate_pos").isNull() | (F.col("mate_pos") < 0)


#: name -> builder; parameters have the defaults of the tools that use them.
FILTERS: dict[str, Callable[..., Column]] = {
    "AllowAll": lambda: F.lit(True),
    "Mapped": lambda: ~unmapped(),
    "NotDuplicate": lambda: ~has(DUPLICATE),
    "NotSecondary": lambda: ~has(SECONDARY),
    "NotSupplementary": lambda: ~has(SUPPLEMENTARY),
    "PrimaryLine": lambda: ~has(SECONDARY) & ~has(SUPPLEMENTARY),
    "PassesVendorQuality": lambda: ~has(QC_FAIL),
    "MappingQuality": lambda low=10, high=None: (F.col("mapq") >= low) & (F.lit(True) if high is None else F.col("mapq") <= high),
    "MappingQualityAvailable": lambda: F.col("mapq") != 255,
    "MappingQualityNotZero": lambda: F.col("mapq") != 0,
    "Paired": lambda: has(PAIRED),
    "ProperlyPaired": lambda: has(PROPER),
    "FirstOfPair": lambda: has(READ1),
    "SecondOfPair": lambda: has(READ2),
    "ForwardStrand": lambda: ~has(REVERSE),
    "ReverseStrand": lambda: has(REVERSE),
    "MateOnSameContig": lambda: ~has(PAIRED) | mate_unmapped() | (F.col("contig") == F.col("mate_contig")),
    "MateDifferentStrand": lambda: has(PAIRED) & ~mate_unmapped() & (has(REVERSE) != has(MATE_REVERSE)),
    "MateUnmapped": lambda: mate_unmapped(),
    "NonZeroReferenceLength": lambda: reference_length(cigar_ops(F.col("cigar"))) > 0,
    "GoodCigar": lambda: good_cigar(F.col("cigar")),
    "HasReadGroup": lambda: F.col("read_group").isNotNull() & (F.col("read_group") != ""),
    "ReadGroup": lambda keep="": F.col("read_group") == keep,
    "ReadGroupBlackList": lambda drop=(): ~F.coalesce(F.col("read_group").isin(*drop), F.lit(False)) if drop else F.lit(True),
    "ReadName": lambda name="": F.col("qname") == name,
    "ReadLength": lambda low=1, high=2**31 - 1: F.length("seq").between(low, high),
    "ReadLengthEqualsCigarLength": lambda: (F.length("seq") == query_length(cigar_ops(F.col("cigar")))) | unmapped(),
    "SeqIsStored": lambda: F.col("seq").isNotNull() & (F.col("seq") != "*") & (F.length("seq") > 0),
    "MatchingBasesAndQuals": lambda: F.length("seq") == F.length("qual"),
    "ValidAlignmentStart": lambda: unmapped() | (F.col("pos") >= 0),
    "SoftClipped": lambda most=0.5: F.try_divide(_op_bases("S").cast("double"), query_length(cigar_ops(F.col("cigar"))).cast("double")) <= most,
}
FILTERS["Wellformed"] = lambda: FILTERS["SeqIsStored"]() & FILTERS["HasReadGroup"]() & FILTERS["ValidAlignmentStart"]() & FILTERS["MatchingBasesAndQuals"]() & FILTERS["ReadLengthEqualsCigarLength"]() & (unmapped() | FILTERS["GoodCigar"]())
#: Filters that ask for clear flag bits (of Mapped, a place besides).
CLEAR = {"Mapped": UNMAPPED, "NotDuplicate": DUPLICATE, "NotSecondary": SECONDARY, "NotSupplementary": SUPPLEMENTARY, "PrimaryLine": SECONDARY | SUPPLEMENTARY, "PassesVendorQuality": QC_FAIL, "ForwardStrand": REVERSE}
#: What interval counting keeps, and what calibration keeps.
COUNTING = ("Mapped", "PrimaryLine", "PassesVendorQuality", "NotDuplicate", "MappingQualityAvailable")
CALIBRATION = ("MappingQualityNotZero", "MappingQualityAvailable", "Mapped", "PrimaryLine", "NotDuplicate", "PassesVendorQuality")
#: What pile-up counting keeps.
PILEUP = (*COUNTING, "NonZeroReferenceLength", "GoodCigar")


def _op_bases(op: str) -> Column:
    return F.aggregate(F.filter(cigar_ops(F.col("cigar")), lambda o: o["op"] == op), F.lit(0), lambda s, o: s + o["len"])


def chain(filters: Iterable[str] = (), inverted: Iterable[str] = (), disabled: Iterable[str] = (), defaults: Iterable[str] = (), parameters: dict[str, dict] | None = None) -> Column:
    """Defaults but for disabled ones, and all named ones, and the opposite of inverted ones. Null counts as failing.

    Bits that have to be clear are tested at once: a flag that is itself computed would be so anew in each test.
    """
    parameters = parameters or {}
    off = set(disabled)
    names = [n for n in dict.fromkeys([*defaults, *filters]) if n not in off]
    unknown = [n for n in [*names, *inverted] if n not in FILTERS]
    if unknown:
        raise ValueError(f"no such read filter: {', '.join(unknown)}")
    clear = reduce(int.__or__, [CLEAR.get(n, 0) for n in names], 0)
    tests = [F.col("flag").bitwiseAND(clear) == 0] if clear else []
    tests += [(F.col("contig") >= 0) & (F.col("pos") >= 0)] if "Mapped" in names else []
    tests += [FILTERS[n](**parameters.get(n, {})) for n in names if n not in CLEAR]
    parts = [F.coalesce(t, F.lit(False)) for t in tests]
    parts += [~F.coalesce(FILTERS[n](**parameters.get(n, {})), F.lit(False)) for n in inverted]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def downsample_per_start(reads: DataFrame, most: int, seed: int = 47, id_col: str = "rid") -> DataFrame:
    """At most ``most`` reads per alignment start, picked by a seeded hash; reads keep their other order."""
    from pyspark.sql import Window

    w = Window.partitionBy("contig", "pos").orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col))
    return reads.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def flag_statistics(reads: DataFrame) -> DataFrame:
    """Twelve counters in one pass. Pair counters look at paired reads only; a read with both marks counts as second."""
    paired, mapped, mate_mapped = has(PAIRED), ~unmapped(), ~mate_unmapped()
    other = paired & mapped & mate_mapped & (F.col("contig") != F.col("mate_contig"))
    counters = {
        "total": F.lit(True), "qc_failure": has(QC_FAIL), "duplicates": has(DUPLICATE), "mapped": mapped, "paired": paired,
        "read1": paired & ~has(READ2) & has(READ1), "read2": paired & has(READ2), "properly_paired": paired & has(PROPER),
        "with_itself_and_mate_mapped": paired & mapped & mate_mapped, "singletons": paired & mapped & ~mate_mapped,
        "mate_on_other_contig": other, "mate_on_other_contig_mapq5": other & (F.col("mapq") >= 5),
    }
    return reads.agg(*[F.count_if(c).alias(n) for n, c in counters.items()])
