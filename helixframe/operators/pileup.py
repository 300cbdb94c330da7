"""Counting at loci: read counts, depth, allele counts, orientation contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import quantile_floor
from .ranges import depth_segments, point_join


def aligned_blocks(reads: DataFrame) -> DataFrame:
    """One row per aligned stretch (M, = or X) of a read: block_start, block_end on the reference; columns contig, pos, ops."""
    walk = F.aggregate(
        "ops", F.struct(F.col("pos").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out")),
        lambda s, o: F.struct(
            F.when(o["op"].isin("M", "D", "N", "=", "X"), s["at"] + o["len"]).otherwise(s["at"]).alias("at"),
            F.when(o["op"].isin("M", "=", "X"), F.concat(s["out"], F.array(F.struct(s["at"].alias("s"), (s["at"] + o["len"]).alias("e"))))).otherwise(s["out"]).alias("out")))
    # The outer form, as a filter on the array's size would walk the read again (and once more for its nulls).
    return reads.withColumn("_b", F.explode_outer(walk["out"])).where("_b is not null").withColumn("block_start", F.col("_b.s")).withColumn("block_end", F.col("_b.e")).drop("_b")


def interval_read_counts(reads: DataFrame, intervals: DataFrame, width: int = 1000) -> DataFrame:
    """Reads that start in each interval (disjoint, or each counts); intervals without reads have 0."""
    hits = point_join(reads.select("contig", "pos"), intervals.select("contig", "start", "end"), width)
    counts = hits.groupBy(F.col("contig"), F.col("start_r").alias("start"), F.col("end_r").alias("end")).agg(F.count(F.lit(1)).alias("count"))
    return intervals.select("contig", "start", "end").join(counts, ["contig", "start", "end"], "left").select("contig", "start", "end", F.coalesce("count", F.lit(0)).alias("count"))


def first_interval(points: DataFrame, intervals: DataFrame, width: int = 1000) -> DataFrame:
    """Each point with the first interval that holds it (by start, end); points in none are left out."""
    hits = point_join(points, intervals.select("contig", "start", "end"), width)
    return hits.groupBy(*points.columns).agg(F.min(F.struct(F.col("start_r").alias("start"), F.col("end_r").alias("end"))).alias("i")).select(*points.columns, "i.start", "i.end")


def depth_histogram(blocks: DataFrame, stop: int, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Bases at each depth from 1 to stop (deeper ones count as stop), over (keys, start, end) intervals."""
    seg = depth_segments(blocks, keys)
    return seg.groupBy(F.least("depth", F.lit(stop)).cast("int").alias("depth")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def cumulative(histogram: DataFrame, key: str = "depth", value: str = "bases") -> DataFrame:
    """Bases at each depth or more, and their share. The histogram has a bounded number of rows."""
    w = Window.orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("at_least", F.sum(value).over(w)).withColumn("share", F.try_divide(F.col("at_least").cast("double"), F.sum(value).over(Window.partitionBy()).cast("double")))


def discrete_quartiles(df: DataFrame, group: str, value: str, cap: int) -> DataFrame:
    """Q1, median and Q3 by element floor(f (n - 1)), plus 1, at most ``cap``. Counts per value stand for the values."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(value)
    c = counts.withColumn("up", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(group)))
    pick = lambda f: F.min(F.when(F.col("up") > F.floor(f * (F.col("total") - 1)), F.col(value)))
    return c.groupBy(group).agg(*[F.least(pick(f) + 1, F.lit(cap)).alias(n) for f, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])


def quartiles_of_arrays(values: Column, f: float) -> Column:
    return quantile_floor(F.sort_array(values), f)


def allele_counts(bases: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site (contig, pos, ref, alt): ref, alt and other counts of the bases (contig, pos, base) there."""
    hit = bases.join(sites, ["contig", "pos"])
    return hit.groupBy("contig", "pos", "ref", "alt").agg(*_allele_tallies(F.col("ref"), F.col("alt")))


def _allele_tallies(ref: Column, alt: Column) -> list[Column]:
    base = F.col("base")
    return [F.count_if(base == ref).alias("ref_count"), F.count_if((base == alt) & (base != ref)).alias("alt_count"), F.count_if((base != ref) & (base != alt)).alias("other_alt_count")]


def allele_counts_at(bases: DataFrame, ref: Column, alt: Column) -> DataFrame:
    """As ``allele_counts``, where each place of a base is a site and its alleles are Columns of contig and pos: one aggregate
    over the places instead of a table of sites and a join with it. Bases without a place are at no site."""
    placed = bases.where(F.col("contig").isNotNull() & F.col("pos").isNotNull())
    counts = placed.groupBy("contig", "pos").agg(*_allele_tallies(ref, alt))
    return counts.select("contig", "pos", ref.alias("ref"), alt.alias("alt"), "ref_count", "alt_count", "other_alt_count")


def nucleotide_counts(bases: DataFrame, keys: list[str], ref: str | Column = "ref") -> DataFrame:
    """A, C, G, T counts, alt_count = total - ref, and the most frequent base that isn't ref (first in ACGT order; N if none).

    ref: a column that is grouped by too, or a Column of the keys (then the groups stay as small as the keys).
    """
    by_name = isinstance(ref, str)
    sums = bases.groupBy(*keys, *([ref] if by_name else [])).agg(*[F.count_if(F.col("base") == b).alias(b) for b in "ACGT"])
    if not by_name:
        sums, ref = sums.select(*keys, ref.alias("ref"), *"ACGT"), "ref"
    total = sum((F.col(b) for b in "ACGT"), F.lit(0))
    is_ref = F.lit(0)
    for b in "ACGT":
        is_ref = F.when(F.col(ref) == b, F.col(b)).otherwise(is_ref)
    best = F.array_max(F.array(*[F.struct(F.when(F.col(ref) != b, F.col(b)).otherwise(-1).alias("n"), F.lit(-k).alias("k"), F.lit(b).alias("b")) for k, b in enumerate("ACGT")]))
    return sums.withColumn("ref_count", is_ref).withColumn("alt_count", total - is_ref).withColumn("alt_base", F.when(best["n"] > 0, best["b"]).otherwise("N"))


def coverage_filter(sites: DataFrame, least: int = 10, low: float = 0.5, high: float = 3.0, total: str = "total") -> DataFrame:
    """Sites with total > least and median * low < total < mean * high. One row of statistics joins all sites."""
    stats = sites.agg(F.median(total).alias("_median"), F.avg(total).alias("_mean"))
    return sites.crossJoin(F.broadcast(stats)).where((F.col(total) > least) & (F.col(total) > F.col("_median") * low) & (F.col(total) < F.col("_mean") * high)).drop("_median", "_mean")


def distinct_fragments(bases: DataFrame, keys: list[str], fragment: str = "name", low: int = 0, high: int = 255, qual: str | None = None) -> DataFrame:
    """Fragments per locus: mates that overlap count once. Bases outside [low, high] of ``qual`` don't count.

    Pairs of locus and fragment are made distinct first, so that each task combines its own before the shuffle.
    """
    some = bases if qual is None else bases.where(F.col(qual).between(low, high))
    return some.select(*keys, fragment).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("fragments"))


def in_intervals_with_tail(reads: DataFrame, intervals: DataFrame, unmapped: bool = True, width: int = 1000) -> DataFrame:
    """Reads (contig, start, end) that overlap an interval, and those without a place (contig null or negative) if asked."""
    from .ranges import overlap_join

    placed = F.coalesce(F.col("contig") >= 0, F.lit(False))
    kept = overlap_join(reads.where(placed), intervals.select("contig", "start", "end"), width, how="left_semi")
    return kept.unionByName(reads.where(~placed)) if unmapped else kept
