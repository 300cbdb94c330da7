"""Interval algebra and overlap joins on (contig, start, end), half-open.

A condition on ranges alone has no hash or merge join, so both sides are dealt into bins and joined on (contig, bin); a
pair counts in the bin of the greater start only, which gives each pair once. Bins spread a long contig over tasks, and
the join on them can be split where a bin is crowded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scanned


def binned(df: DataFrame, width: int, start: str = "start", end: str = "end", bin_col: str = "_bin") -> DataFrame:
    """One row for each bin that an interval touches; empty intervals touch the bin of their start."""
    last = F.greatest(F.col(start), F.col(end) - 1)
    return df.withColumn(bin_col, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def overlap_join(left: DataFrame, right: DataFrame, width: int = 1000, how: str = "inner", suffix: str = "_r") -> DataFrame:
    """Pairs of overlapping intervals; right columns get the suffix. how: inner, left_semi or left_anti."""
    r = right.select(*[F.col(c).alias(c + suffix) for c in right.columns])
    a = binned(left, width).withColumn("_first", F.floor(F.col("start") / width))
    b = binned(r, width, "start" + suffix, "end" + suffix, "_bin_r").withColumn("_first_r", F.floor(F.col("start" + suffix) / width))
    on = (F.col("contig") == F.col("contig" + suffix)) & (F.col("_bin") == F.col("_bin_r")) & (F.col("start") < F.col("end" + suffix)) & (F.col("start" + suffix) < F.col("end"))
    if how == "inner":
        on = on & (F.col("_bin") == F.greatest("_first", "_first_r"))
        return a.join(b, on).drop("_bin", "_first", "_bin_r", "_first_r")
    span = ["contig", "start", "end"]  # whether a row overlaps depends on it only; row numbers may differ from one reading to the next
    hit = binned(left.select(*span), width).join(b.drop("_first_r"), on, "left_semi").select(*span).distinct()
    return left.join(hit, span, how).select(*left.columns)


def point_join(points: DataFrame, intervals: DataFrame, width: int = 1000, suffix: str = "_r", how: str = "inner") -> DataFrame:
    """Points (contig, pos) with the intervals that hold them; only the intervals are exploded."""
    r = binned(intervals.select(*[F.col(c).alias(c + suffix) for c in intervals.columns]), width, "start" + suffix, "end" + suffix, "_bin_r")
    on = (F.col("contig") == F.col("contig" + suffix)) & (F.floor(F.col("pos") / width) == F.col("_bin_r")) & (F.col("pos") >= F.col("start" + suffix)) & (F.col("pos") < F.col("end" + suffix))
    out = points.join(r, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_bin_r")


def islands(df: DataFrame, abutting: bool = True, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Intervals with _island: the number of the merged interval they belong to, within the keys."""
    reached = scanned(df, keys, ["start", "end"], maxima=["end"])
    reach = F.col("max_end")
    new = reach.isNull() | ((F.col("start") > reach) if abutting else (F.col("start") >= reach))
    numbered = scanned(reached.withColumn("_new", new.cast("int")), keys, ["start", "end"], sums=["_new"])
    return numbered.select(*df.columns, F.col("sum__new").alias("_island"))


def merge(df: DataFrame, abutting: bool = True, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Union of intervals: overlapping ones become one, abutting ones too if asked."""
    return islands(df, abutting, keys).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def intersect(a: DataFrame, b: DataFrame, width: int = 1000) -> DataFrame:
    """Common parts of two interval sets (each merged first)."""
    both = overlap_join(merge(a).select("contig", "start", "end"), merge(b).select("contig", "start", "end"), width)
    return both.select("contig", F.greatest("start", "start_r").alias("start"), F.least("end", "end_r").alias("end"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parts of the union of ``a`` that no interval of ``b`` covers: one sweep over the ends of both, which counts how many of
    each are open; what is left is joined where it touches."""
    ends = None
    for df, name in ((a.where("start < end"), "in_a"), (b.where("start < end"), "in_b")):
        for col, step in (("start", 1), ("end", -1)):
            part = df.select("contig", F.col(col).alias("at"), F.lit(step if name == "in_a" else 0).alias("a"), F.lit(step if name == "in_b" else 0).alias("b"))
            ends = part if ends is None else ends.union(part)
    ends = ends.groupBy("contig", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    swept = scanned(ends, ["contig"], ["at"], sums=["a", "b"], leads=["at"])
    swept = swept.select("contig", F.col("at").alias("start"), F.col("lead_at").alias("end"), F.col("sum_a").alias("a"), F.col("sum_b").alias("b"))
    return merge(swept.where("a > 0 and b = 0 and end is not null").select("contig", "start", "end"))


def pad(df: DataFrame, padding: int, limit: Column | None = None) -> DataFrame:
    """Widened by ``padding`` to both sides within [0, limit]; neighbours that would overlap meet in the middle of their gap."""
    columns = df.columns
    df = scanned(df, ["contig"], ["start", "end"], lags=["end"], leads=["start"])
    before, after = F.col("lag_end"), F.col("lead_start")
    low = F.greatest(F.col("start") - padding, F.lit(0))
    high = F.col("end") + padding if limit is None else F.least(F.col("end") + padding, limit)
    low = F.when(before.isNotNull() & (before <= F.col("start")) & (F.col("start") - before < 2 * padding), before + F.floor((F.col("start") - before) / 2)).otherwise(low)
    high = F.when(after.isNotNull() & (after >= F.col("end")) & (after - F.col("end") < 2 * padding), F.col("end") + F.floor((after - F.col("end")) / 2)).otherwise(high)
    return df.select(*[c for c in columns if c not in ("start", "end")], low.cast("long").alias("start"), high.cast("long").alias("end"))


def fixed_bins(df: DataFrame, width: int) -> DataFrame:
    """Intervals cut into pieces of ``width`` from their start on; the last may be shorter."""
    cut = df.where("end > start").withColumn("_s", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(width).cast("long"))))
    return cut.withColumn("_e", F.least(F.col("_s") + width, F.col("end"))).drop("start", "end").withColumnRenamed("_s", "start").withColumnRenamed("_e", "end")


def territory(df: DataFrame, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Covered bases per contig."""
    return merge(df, keys=keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def scatter(df: DataFrame, shards: int) -> DataFrame:
    """Shard number of each interval, in order, so that shards have about equal bases: by the middle of its cumulative weight.

    Totals per contig come first, so that the running sum needs no single-task window over all rows.
    """
    size = F.col("end") - F.col("start")
    sums = df.groupBy("contig").agg(F.sum(size).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = before.withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    out = scanned(df.withColumn("_size", size), ["contig"], ["start", "end"], sums=["_size"]).join(total, "contig")
    middle = F.col("_before") + F.col("sum__size") - size / 2.0
    return out.select(*df.columns, F.least(F.floor(middle * shards / F.col("_total")), F.lit(shards - 1)).cast("int").alias("shard"))


def depth_segments(df: DataFrame, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Maximal stretches of constant depth > 0: (keys, start, end, depth). Row counts follow interval ends, not bases."""
    each = F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").cast("long").alias("at"), F.lit(-1).alias("d"))))
    ends = df.select(*keys, each.alias("_e")).select(*keys, "_e.at", "_e.d")  # one reading of the intervals for both of their ends
    ends = ends.groupBy(*keys, "at").agg(F.sum("d").alias("d")).where("d != 0")
    swept = scanned(ends, keys, ["at"], sums=["d"], leads=["at"])
    swept = swept.select(*keys, F.col("at").alias("start"), F.col("lead_at").alias("end"), F.col("sum_d").cast("long").alias("depth"))
    return swept.where("depth > 0 and end is not null")


def annotate_weighted(intervals: DataFrame, track: DataFrame, value: str, width: int = 1000) -> DataFrame:
    """Per interval the mean of a track's value over its bases; uncovered bases count 0."""
    parts = overlap_join(intervals, track, width)
    overlap = F.least("end", "end_r") - F.greatest("start", "start_r")
    sums = parts.groupBy("contig", "start", "end").agg(F.sum(overlap * F.col(value + "_r")).alias("_s"))
    return intervals.join(sums, ["contig", "start", "end"], "left").withColumn("mean_" + value, F.coalesce(F.try_divide(F.col("_s"), F.col("end") - F.col("start")), F.lit(0.0))).drop("_s")


#: Which records count for an interval (records and intervals as in overlap_join's output).
OUTPUT_MODES = {
    "overlaps": lambda: F.lit(True),
    "starts_in": lambda: (F.col("start") >= F.col("start_r")) & (F.col("start") < F.col("end_r")),
    "ends_in": lambda: (F.col("end") > F.col("start_r")) & (F.col("end") <= F.col("end_r")),
    "contained": lambda: (F.col("start") >= F.col("start_r")) & (F.col("end") <= F.col("end_r")),
}


def merge_index_bins(counts: list[int], width: int, most_average: float = 100.0, least_width: int = 1_024_000) -> tuple[list[int], int]:
    """Feature counts of neighbouring bins added up in pairs while bins are narrower than ``least_width``, or while the fullest
    merged bin stays at most ``most_average`` features; one bin is left at least."""
    while len(counts) > 1:
        merged = [sum(counts[k : k + 2]) for k in range(0, len(counts), 2)]
        if width >= least_width or max(merged) > most_average:
            break
        counts, width = merged, width * 2
    return counts, width


def drop_unknown_bins(bins: DataFrame, reference: DataFrame) -> DataFrame:
    """Bins that hold a base other than N of the reference (contig, start, seq chunks)."""
    chunks = reference.select("contig", "start", (F.col("start") + F.length("seq")).alias("end"), "seq")
    width = 10_000
    hit = overlap_join(bins.select("contig", "start", "end"), chunks, width)
    low, high = F.greatest("start", "start_r"), F.least("end", "end_r")
    piece = F.substr(F.col("seq_r"), (low - F.col("start_r") + 1).cast("int"), (high - low).cast("int"))
    good = hit.where(piece.rlike("[ACGTacgt]")).select("contig", "start", "end").distinct()
    return bins.join(good, ["contig", "start", "end"], "left_semi")


def exact_join(left: DataFrame, right: DataFrame, what: str = "interval") -> DataFrame:
    """``left`` with the columns of ``right`` at the same (contig, start, end); an interval that ``right`` lacks is an error."""
    key = ["contig", "start", "end"]
    found = right.withColumn("_found", F.lit(True))
    joined = left.join(found, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {what} at "), F.concat_ws(":", *[F.col(c).cast("string") for c in key])))
    return joined.withColumn("_found", F.when(F.col("_found"), True).otherwise(missing)).where("_found").drop("_found")


def separate_contigs(df: DataFrame, shards: int) -> DataFrame:
    """``df`` with shard, where no shard holds parts of two contigs: each contig has shards by its share of the bases (one at
    least), cut at intervals by the middle of their cumulative size. Shards are numbered in order."""
    size = F.col("end") - F.col("start")
    sums = df.groupBy("contig").agg(F.sum(size).alias("_n"))
    w = Window.orderBy("contig")  # a row for each contig
    share = sums.withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * shards / F.sum("_n").over(Window.partitionBy()))))
    share = share.withColumn("_first", F.sum("_k").over(w) - F.col("_k"))
    out = scanned(df.withColumn("_size", size), ["contig"], ["start", "end"], sums=["_size"]).join(share, "contig")
    at = F.col("sum__size") - size / 2.0
    return out.select(*df.columns, (F.col("_first") + F.least(F.floor(at * F.col("_k") / F.col("_n")), F.col("_k") - 1)).cast("int").alias("shard"))
