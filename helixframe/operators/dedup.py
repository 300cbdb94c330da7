"""Duplicate marking: fragments and pairs grouped by unclipped ends, representative by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(qual: Column, qc_fail: Column) -> Column:
    """Sum of base qualities of 15 or more (array of numbers), at most 16383; QC failures lose 16384."""
    s = F.least(F.aggregate(F.filter(qual, lambda q: q >= 15), F.lit(0), lambda a, q: a + q), F.lit(16383))
    return s - F.when(qc_fail, 16384).otherwise(0)


def pairs(ends: DataFrame, name: tuple[str, ...] = ("library", "qname")) -> DataFrame:
    """Mates brought together without a self-join: the smaller and the larger end of a name, as structs.

    ends: name columns and contig, pos5, reverse, score, ord. Names with one end have a null second end.
    """
    end = F.struct("contig", "pos5", "reverse", "ord", "score")
    g = ends.groupBy(*name).agg(F.min(end).alias("one"), F.max(end).alias("two"), F.count(F.lit(1)).alias("ends"), F.sum("score").alias("pair_score"), F.min("ord").alias("first_ord"))
    return g.withColumn("two", F.when(F.col("ends") > 1, F.col("two")))


def mate_five_prime(mate_contig: Column, mate_pos: Column, mate_reverse: Column, mate_ops: Column) -> Column:
    """The mate's 5' position from its start and its CIGAR's operations (of the MC tag): the last base if it is reversed, the
    start if it isn't or the operations are missing; -1 without a mate."""
    from ..functions.sequence import reference_length

    span = F.coalesce(reference_length(mate_ops), F.lit(0))
    there = (mate_contig >= 0) & (mate_pos >= 0)
    return F.when(F.coalesce(there, F.lit(False)), F.when(mate_reverse & (span > 0), mate_pos + span - 1).otherwise(mate_pos)).otherwise(-1)


def duplicate_order(library: str, contig: str, pos5: str, reverse: str, mate_contig: str, mate_pos5: str, mate_reverse: str, *ties: str) -> list[Column]:
    """Sort keys that bring the rows of one duplicate group together: library, own end, mate's end, then ties; nulls last."""
    return [F.col(c).asc_nulls_last() for c in (library, contig, pos5, reverse, mate_contig, mate_pos5, mate_reverse, *ties)]


def mark(groups: DataFrame, key: list[str], score_col: str = "score", ties: tuple[str, ...] = ("ord",)) -> DataFrame:
    """is_duplicate: not the highest score of its key (then the first by ``ties``)."""
    w = Window.partitionBy(*key).orderBy(F.col(score_col).desc(), *ties)
    return groups.withColumn("_rn", F.row_number().over(w)).withColumn("is_duplicate", F.col("_rn") > 1).drop("_rn")


def optical(groups: DataFrame, key: list[str], limit: int, score_col: str = "score", ties: tuple[str, ...] = ("ord",)) -> DataFrame:
    """is_optical: a duplicate on the representative's tile at most ``limit`` away (columns tile, x, y)."""
    w = Window.partitionBy(*key).orderBy(F.col(score_col).desc(), *ties)
    lead = F.first(F.struct("tile", "x", "y")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    far = F.pow(F.col("x") - lead["x"], 2) + F.pow(F.col("y") - lead["y"], 2)
    rank = F.row_number().over(w)
    return groups.withColumn("is_optical", (rank > 1) & (F.col("tile") == lead["tile"]) & (far <= limit * limit))


def library_metrics(marked: DataFrame) -> DataFrame:
    """Per library: fragments and pairs examined, duplicates of each, share of duplicates."""
    single = F.col("ends") == 1
    return marked.groupBy("library").agg(
        F.count_if(single).alias("unpaired_examined"), F.count_if(~single).alias("pairs_examined"),
        F.count_if(single & F.col("is_duplicate")).alias("unpaired_duplicates"), F.count_if(~single & F.col("is_duplicate")).alias("pair_duplicates"),
    ).withColumn("percent_duplication", F.try_divide(F.col("unpaired_duplicates") + 2.0 * F.col("pair_duplicates"), F.col("unpaired_examined") + 2.0 * F.col("pairs_examined")))


def estimate_library_size(pairs_seen: int, unique: int) -> int:
    """Distinct molecules behind ``unique`` of ``pairs_seen`` pairs under Poisson sampling; 0 without or with only duplicates."""
    import math

    if pairs_seen <= 0 or unique <= 0 or unique >= pairs_seen:
        return 0

    def excess(size: float) -> float:
        return size * -math.expm1(-pairs_seen / size) - unique

    low, high = float(unique), 2.0 * unique
    while excess(high) < 0:
        high *= 2
    for _ in range(120):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return int((low + high) / 2)
