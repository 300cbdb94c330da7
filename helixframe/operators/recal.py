"""Base-quality recalibration: covariate tables, empirical quality, quantising, application."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_Q, PRIOR_SD, MAX_DIFF = 60, 0.5, 40


def covariate_table(bases: DataFrame, keys: list[str], mismatch: str = "mismatch") -> DataFrame:
    """Observations and mismatches per key; partial sums on the map side."""
    return bases.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.sum(F.col(mismatch).cast("long")).alias("mismatches"))


def covariate_sets(bases: DataFrame, base_keys: list[str], covariates: list[str], mismatch: str = "mismatch") -> DataFrame:
    """One table per covariate crossed with the base keys, in one pass: (base keys, covariate, value, counts)."""
    long = bases.select(*base_keys, mismatch, F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in covariates]))).alias("covariate", "value"))
    return covariate_table(long.where("value is not null"), [*base_keys, "covariate", "value"], mismatch)


def gather(*tables: DataFrame) -> DataFrame:
    """Tables of shards, counts added up."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    keys = [c for c in out.columns if c not in ("observations", "mismatches")]
    return out.groupBy(*keys).agg(F.sum("observations").alias("observations"), F.sum("mismatches").alias("mismatches"))


def empirical_quality(observations: Column, mismatches: Column, prior: Column) -> Column:
    """The q of 0..60 with the highest posterior, the first of equals: normal prior around ``prior`` (whole steps, at most 40
    apart), binomial likelihood of mismatches + 1 in observations + 2."""
    n, k = (observations + 2).cast("double"), (F.floor(mismatches + 0.5) + 1).cast("double")

    def log_posterior(q: Column) -> Column:
        away = F.least(F.abs((q - prior).cast("int")), F.lit(MAX_DIFF)).cast("double")
        p = F.pow(F.lit(10.0), -q.cast("double") / 10.0)
        # q = 0 means certain error: only possible if all observations are mismatches.
        fine = F.when(q > 0, F.log(F.greatest(1.0 - p, F.lit(1e-300)))).otherwise(F.when(n > k, F.lit(-1e300)).otherwise(0.0))
        return -0.5 * F.pow(away / PRIOR_SD, 2) + k * F.log(p) + (n - k) * fine

    grid = F.transform(F.sequence(F.lit(0), F.lit(MAX_Q)), lambda q: F.struct(log_posterior(q).alias("z"), (-q).alias("m")))
    return -F.array_max(grid)["m"]


def hierarchical_delta(global_q: Column, group_q: Column, quality_q: Column, covariate_qs: list[Column], reported: Column) -> Column:
    """Recalibrated quality: the quality bin's empirical value plus each covariate's distance from it, within 20 of the reported."""
    base = F.coalesce(quality_q, group_q, global_q)
    extra = sum((F.coalesce(c - base, F.lit(0)) for c in covariate_qs), F.lit(0))
    delta = F.least(F.greatest(base + extra - reported, F.lit(-20)), F.lit(20))
    return reported + F.round(delta).cast("int")


def delta_rows(before: DataFrame, after: DataFrame, keys: list[str], prior: str = "reported") -> DataFrame:
    """Rows of two covariate tables side by side, with their empirical qualities and accuracy (empirical less ``prior``); a row that
    one table lacks has nulls there."""
    def named(df: DataFrame, suffix: str) -> DataFrame:
        q = empirical_quality(F.col("observations"), F.col("mismatches").cast("double"), F.col(prior))
        return df.select(*keys, F.col("observations").alias(f"observations_{suffix}"), q.alias(f"empirical_{suffix}"), (q - F.col(prior)).alias(f"accuracy_{suffix}"))

    return named(before, "before").join(named(after, "after"), keys, "full_outer")


def apply_deltas(quals: Column, deltas: Column) -> Column:
    """Arrays of qualities plus deltas, each within 1..93."""
    return F.zip_with(quals, deltas, lambda q, d: F.greatest(F.lit(1), F.least(F.lit(93), q + d)))


def quantize(counts: list[int], levels: int = 16, least: int = 6) -> list[int]:
    """Map of qualities 0..n-1 to ``levels`` representatives: neighbouring bins with the smallest penalty are merged."""
    bins = [(q, q, float(c), c * 10 ** (-q / 10), 0.0) for q, c in enumerate(counts)]  # first, last, n, errors, penalty

    def merged(a, b):
        n, e = a[2] + b[2], a[3] + b[3]
        rate = e / n if n else 10 ** (-a[1] / 10)
        q = -10 * math.log10(max(rate, 1e-10))
        cost = sum(counts[k] * abs(math.log10(10 ** (-k / 10)) - math.log10(10 ** (-q / 10))) for k in range(a[0], b[1] + 1) if k >= least)
        return a[0], b[1], n, e, cost

    while len(bins) > levels:
        options = [merged(a, b) for a, b in zip(bins, bins[1:], strict=False)]
        k = min(range(len(options)), key=lambda i: (options[i][4] - bins[i][4] - bins[i + 1][4], i))
        bins[k : k + 2] = [options[k]]
    out = [0] * len(counts)
    for first, last, n, e, _ in bins:
        q = first if first == last else round(-10 * math.log10(max(e / n, 1e-10))) if n else first
        out[first : last + 1] = [q] * (last + 1 - first)
    return out
