"""Reference-confidence blocks: banding, merging, splitting at variants, combining samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import overlap_join
from .scan import scanned

#: Upper bounds (exclusive) of the default GQ bands: singles to 60, then 70, 80, 90, 99 (fixed values).
BANDS = (*range(1, 61), 70, 80, 90, 99)


def band(gq: Column, bounds: tuple[int, ...] = BANDS) -> Column:
    """Number of the band of a GQ: how many bounds it has reached."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= gq))


def merge_blocks(blocks: DataFrame, keys: tuple[str, ...] = ("sample", "contig"), bounds: tuple[int, ...] = BANDS) -> DataFrame:
    """Touching blocks of one band become one: least GQ, the least of each PL (if there is an array pl of three), rounded median
    depth. The blocks may come from any tiles: pieces that were cut at a tile's edge are stitched alike."""
    b = scanned(blocks.withColumn("_band", band(F.col("gq"), bounds)), keys, ["start", "end"], lags=["end", "_band"])
    new = F.col("lag_end").isNull() | (F.col("lag_end") != F.col("start")) | (F.col("lag__band") != F.col("_band"))
    b = scanned(b.withColumn("_new", new.cast("int")), keys, ["start", "end"], sums=["_new"]).withColumnRenamed("sum__new", "_run")
    pls = [F.array(*[F.min(F.get("pl", F.lit(k))) for k in range(3)]).alias("pl")] if "pl" in blocks.columns else []
    out = b.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("_band").alias("band"), F.min("gq").alias("min_gq"), F.floor(F.median("dp") + 0.5).cast("int").alias("dp"), F.count(F.lit(1)).alias("n_blocks"), *pls)
    return out.drop("_run")


def split_at_variants(blocks: DataFrame, variants: DataFrame, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """What variants' spans leave of each block: dropped, shortened or cut in two. Spans come as (contig, start, end)."""
    span = ["contig", "start", "end"]
    full = blocks.where("start < end")
    # What is left depends on a block's span only, so that a block needs no number (which a second reading could deal otherwise).
    of = full.where("contig is not null").select(*span).distinct()
    hits = overlap_join(of, variants.select(*span).distinct())
    cuts = of.select(*span, F.col("start").alias("_s"), F.col("start").alias("_e")).union(hits.select(*span, F.greatest("start_r", "start"), "end_r"))
    swept = scanned(cuts, span, ["_s", "_e"], maxima=["_e"], leads=["_s"])
    left = swept.select(*span, F.greatest("_e", "max__e").alias("_from"), F.coalesce("lead__s", "end").alias("_to")).where("_from < _to")
    rest = [c for c in blocks.columns if c not in ("start", "end")]
    pieces = full.join(left, span).select(*rest, F.col("_from").alias("start"), F.col("_to").alias("end"))
    return pieces.unionByName(full.where("contig is null").select(*rest, "start", "end"))


def combine(samples: DataFrame) -> DataFrame:
    """Rows of several samples at one (contig, pos, ref): union of their alternates, sample count, summed depth."""
    return samples.groupBy("contig", "pos", "ref").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("alts")))).alias("alts"), F.countDistinct("sample").alias("n_samples"), F.sum("dp").alias("dp"))


def spanning_deletion(df: DataFrame, tie: str = "id") -> DataFrame:
    """``df`` (contig, pos, ref) with spanned: an earlier row's reference allele reaches over this position."""
    out = scanned(df.withColumn("_stop", F.col("pos") + F.length("ref")), ["contig"], ["pos", tie], maxima=["_stop"])
    return out.select(*df.columns, F.coalesce(F.col("max__stop") > F.col("pos"), F.lit(False)).alias("spanned"))
