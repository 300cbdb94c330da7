"""Contamination of a sample: an estimate from homozygous sites by a cascade of site choices, and the tables that use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import point_join

#: Least minor-allele fractions of segments, tried in this order, and which sites each takes (fixed values).
CASCADE = tuple((round(0.40 - 0.04 * k, 2), "hom_alt" if 0.40 - 0.04 * k > 0.25 else "hom_ref" if 0.40 - 0.04 * k > 0.20 else "low_alt") for k in range(11))


def _error(c: Column, one: Column, two: Column, weight: Column) -> Column:
    """How far from the estimate c the truth x lies where it is one standard error s(x) away: the farther of both sides.

    s(x)**2 = (one x (1 - x) + two x**2) / weight**2, so x solves a quadratic equation.
    """
    w2 = weight * weight
    a, b, k = w2 - two + one, -(2 * c * w2 + one), c * c * w2
    root = F.sqrt(F.greatest(b * b - 4 * a * k, F.lit(0.0)))
    at = F.sqrt(F.greatest(one * c * (1 - c) + two * c * c, F.lit(0.0))) / weight
    low, high = (-b - root) / (2 * a), (-b + root) / (2 * a)
    up = F.when((a > 0) & high.between(c, F.lit(1.0)), high - c).otherwise(at)
    down = F.when((a > 0) & low.between(F.lit(0.0), c), c - low).otherwise(at)
    return F.greatest(up, down)


def estimate(sites: DataFrame, error_rate: float = 0.001, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Per sample: contamination, its standard error, and the choice of sites that gave them.

    sites: keys, ref_count, alt_count, depth, af (population frequency), maf (of the site's segment) and genotype (hom_alt,
    hom_ref or other). Homozygous alternate sites of balanced segments come first, then homozygous reference ones, then all
    sites with a low alternate share; the first estimate whose error is under a fifth of it (and 0.001) counts, or else the
    last. All choices are summed up in one pass, each task combining its own sites first.
    """
    share = F.try_divide(F.col("alt_count").cast("double"), F.col("depth").cast("double"))
    low = sites.where(share < 0.15).groupBy(*keys).agg(F.greatest(F.lit(0.1), F.percentile_approx(share, 0.9, 10_000)).alias("_most"))
    tries = F.explode(F.array(*[F.struct(F.lit(m).alias("maf"), F.lit(s).alias("kind"), F.lit(k).alias("k")) for k, (m, s) in enumerate(CASCADE)]))
    rows = sites.join(low, list(keys), "left").withColumn("_share", share).select("*", tries.alias("_try"))
    homs = (F.col("genotype") == F.col("_try.kind")) & (F.col("maf") > F.col("_try.maf"))
    rows = rows.where(F.when(F.col("_try.kind") == "low_alt", (F.col("_share") < 0.15) & (F.col("_share") <= F.col("_most"))).otherwise(homs))
    alt = F.col("_try.kind") == "hom_alt"
    f = F.when(alt, 1.0 - F.col("af")).otherwise(F.col("af"))
    d = F.col("depth").cast("double")
    sums = rows.groupBy(*keys, F.col("_try.k").alias("k"), F.col("_try.kind").alias("kind")).agg(
        F.sum(d).alias("depth"), F.sum(F.when(alt, F.col("ref_count")).otherwise(F.col("alt_count"))).alias("opposite"), F.sum(d * f).alias("w"), F.sum(f * (1 - f) * d * d).alias("two"), F.count(F.lit(1)).alias("n_sites"))
    c = F.greatest(F.lit(0.0), F.col("opposite") - F.floor(F.col("depth") * (error_rate / 3) + 0.5)) / F.col("w")
    # A choice without weight has no estimate.
    made = sums.where("w > 0").withColumn("c", c).withColumn("error", _error(F.col("c"), F.col("w"), F.col("two"), F.col("w")))
    made = made.withColumn("good", F.col("error") < F.col("c") * 0.2 + 0.001)
    pick = F.struct("c", "error", "kind", "n_sites")
    best = made.groupBy(*keys).agg(F.min_by(F.when(F.col("good"), pick), F.when(F.col("good"), F.col("k"))).alias("first"), F.max_by(pick, "k").alias("last"), F.max("k").alias("_k"))
    # The last of the cascade counts only if it has an estimate.
    chosen = F.coalesce(F.col("first"), F.when(F.col("_k") == len(CASCADE) - 1, F.col("last")))
    out = sites.select(*keys).distinct().join(best.select(*keys, chosen.alias("b")), list(keys), "left")
    return out.select(*keys, F.coalesce(F.least(F.col("b.c"), F.lit(1.0)), F.lit(0.0)).alias("contamination"), F.coalesce("b.error", F.lit(1.0)).alias("error"), F.coalesce("b.kind", F.lit("none")).alias("by"), F.coalesce("b.n_sites", F.lit(0)).alias("n_sites"))


def look_up(variants: DataFrame, segments: DataFrame, samples: DataFrame, default_maf: float = 0.5, default: float = 0.0) -> DataFrame:
    """``variants`` (sample, contig, pos) with maf of the segment (sample, contig, start, end, maf) they lie in, the first of
    several, and the contamination of their sample."""
    hit = point_join(variants.select("sample", "contig", "pos").distinct(), segments.select("sample", "contig", "start", "end", "maf"))
    hit = hit.where(F.col("sample") == F.col("sample_r")).groupBy("sample", "contig", "pos").agg(F.min_by("maf_r", "start_r").alias("maf"))
    out = variants.join(hit, ["sample", "contig", "pos"], "left").join(samples.select("sample", F.col("contamination").alias("_c")), "sample", "left")
    return out.withColumn("maf", F.coalesce("maf", F.lit(default_maf))).withColumn("contamination", F.coalesce("_c", F.lit(default))).drop("_c")


def orientation_prior(sites: DataFrame, priors: DataFrame, floor: float = 1e-8) -> DataFrame:
    """``sites`` (context, alt) with the log10 prior of an orientation artifact there: contexts are 64, so the table is small;
    contexts without one have the floor."""
    table = priors.groupBy("context", "alt").agg(F.max("prior").alias("_p"))
    return sites.join(table, ["context", "alt"], "left").withColumn("log10_prior", F.log10(F.greatest(F.coalesce("_p", F.lit(floor)), F.lit(floor)))).drop("_p")


def balanced_segments(sites: DataFrame, jump: float, keys: tuple[str, ...] = ("sample", "contig")) -> DataFrame:
    """Segments of sites (keys, pos, share) that break where the folded alternate share jumps by more than ``jump`` from one site
    to the next: (keys, start, end, maf, n_sites), maf the mean of the folded shares."""
    from .scan import scanned

    folded = sites.withColumn("_f", F.least("share", 1 - F.col("share")))
    b = scanned(folded, keys, ["pos"], lags=["_f"])
    b = scanned(b.withColumn("_n", (F.col("lag__f").isNull() | (F.abs(F.col("_f") - F.col("lag__f")) > jump)).cast("int")), keys, ["pos"], sums=["_n"])
    return b.groupBy(*keys, "sum__n").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.avg("_f").alias("maf"), F.count(F.lit(1)).alias("n_sites")).drop("sum__n")
