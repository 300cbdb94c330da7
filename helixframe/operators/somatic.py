"""Somatic evidence: likelihoods over allele fractions, posteriors, artifact models, error combination, phased filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import combined_error


def _ln_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def tumor_lod(alt: int, depth: int, error: float = 0.001, prior: tuple[float, float] = (1.0, 1.0)) -> float:
    """log10 of the likelihood with an unknown allele fraction (beta prior) over that of errors alone."""
    with_variant = _ln_beta(alt + prior[0], depth - alt + prior[1]) - _ln_beta(*prior)
    without = alt * math.log(error) + (depth - alt) * math.log1p(-error)
    return (with_variant - without) / math.log(10)


def allele_lods(counts: list[int], errors: list[float], rounds: int = 50) -> list[float]:
    """log10 evidence of each allele of a site: variational Dirichlet mixture over alleles, with and without it."""
    c = np.asarray(counts, float)
    n = int(c.sum())
    if n == 0:
        return [0.0] * len(counts)

    def evidence(keep: np.ndarray) -> float:
        e = float(np.mean(errors)) if errors else 0.001
        like = np.where(np.eye(len(c), dtype=bool), 1 - e, e / max(1, len(c) - 1))[:, keep]  # read of row, true allele of column
        alpha = np.ones(int(keep.sum()))
        r = np.full((len(c), len(alpha)), 1 / len(alpha))
        from_prior = alpha.copy()
        for _ in range(rounds):
            mean_log = np.array([_digamma(a) for a in alpha]) - _digamma(alpha.sum())
            r = like * np.exp(mean_log)
            r /= r.sum(1, keepdims=True)
            new = from_prior + c @ r
            if np.abs(new - alpha).max() < 1e-6:
                break
            alpha = new
        bound = sum(math.lgamma(a) for a in alpha) - math.lgamma(alpha.sum()) + math.lgamma(from_prior.sum())
        return bound + float((c[:, None] * r * (np.log(like) - np.log(np.maximum(r, 1e-300)))).sum())

    every = evidence(np.ones(len(c), bool))
    out = []
    for k in range(len(c)):
        keep = np.ones(len(c), bool)
        keep[k] = False
        out.append((every - evidence(keep)) / math.log(10) if keep.any() else 0.0)
    return out


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def lods(df: DataFrame, alt: str = "alt_count", depth: str = "depth") -> DataFrame:
    """``df`` with tumor_lod."""
    def run(a: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([tumor_lod(int(x), int(y)) for x, y in zip(a, d, strict=True)])

    return df.withColumn("tumor_lod", F.pandas_udf(run, "double")(alt, depth))


def posterior_error(log10_odds: Column, log10_prior: Column) -> Column:
    """P(no variant) from log10 likelihood odds for the variant and its log10 prior."""
    odds = F.pow(F.lit(10.0), F.least(F.greatest(log10_odds + log10_prior, F.lit(-300.0)), F.lit(300.0)))
    return 1.0 / (1.0 + odds)


def germline_posterior(log10_odds_somatic: Column, population_af: Column, normal_lod: Column | None = None, prior: float = 1e-6) -> Column:
    """P(germline): Hardy-Weinberg prior of the population frequency against a somatic prior."""
    af = F.greatest(population_af, F.lit(1e-6))
    germline = 2 * af * (1 - af) + af * af
    weight = germline / (1 - germline) / prior
    if normal_lod is not None:
        weight = weight * F.pow(F.lit(10.0), normal_lod)
    z = weight * F.pow(F.lit(10.0), F.least(F.greatest(-log10_odds_somatic, F.lit(-300.0)), F.lit(280.0)))
    return z / (1.0 + z)


def phased_filter(df: DataFrame, phase: str = "phase", pos: str = "pos", p: str = "p", distance: int = 100) -> DataFrame:
    """haplotype_p: the highest artifact probability of the same phase set within the distance, itself included."""
    w = Window.partitionBy(phase).orderBy(pos).rangeBetween(-distance, distance)
    return df.withColumn("haplotype_p", F.when(F.col(phase).isNotNull(), F.max(p).over(w)).otherwise(F.col(p)))


def strand_artifact(forward_alt: np.ndarray, reverse_alt: np.ndarray, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """P(artifact) of each site by EM: real variants share strands evenly, artifacts sit on one strand. A site counts as often as
    its weight says."""
    weight = np.ones(len(forward_alt)) if weight is None else weight
    n = forward_alt + reverse_alt
    prior = 0.05
    log_real = n * math.log(0.5)
    one = np.logaddexp(forward_alt * math.log(0.99) + reverse_alt * math.log(0.01), forward_alt * math.log(0.01) + reverse_alt * math.log(0.99)) - math.log(2)
    post = np.zeros(len(n))
    for _ in range(rounds):
        z = one + math.log(prior) - log_real - math.log1p(-prior)
        post = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        new = (weight @ post + 0.5) / (weight.sum() + 10)
        if abs(new - prior) < 1e-9:
            break
        prior = new
    return post


def strand_artifacts(counts: DataFrame, group: str) -> DataFrame:
    """Posteriors per group of (group, forward_alt, reverse_alt, n): equal rows come counted."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.copy()
        pdf["p_artifact"] = strand_artifact(*(pdf[c].to_numpy(float) for c in ("forward_alt", "reverse_alt")), weight=pdf["n"].to_numpy(float))
        return pdf[[group, "forward_alt", "reverse_alt", "n", "p_artifact"]]

    kind = dict(counts.dtypes)[group]
    return counts.select(group, F.col("forward_alt").cast("long"), F.col("reverse_alt").cast("long"), F.col("n").cast("long")).groupBy(group).applyInPandas(run, f"{group} {kind}, forward_alt long, reverse_alt long, n long, p_artifact double")


#: Labels of hard filters over a site's summary columns (fixed values: names and default thresholds).
HARD_FILTERS = {
    "base_qual": lambda: F.col("median_base_quality") < 20, "map_qual": lambda: F.col("median_mapping_quality") < 30, "fragment": lambda: F.abs(F.col("ref_fragment_length") - F.col("alt_fragment_length")) > 10000,
    "position": lambda: F.col("median_read_position") < 1, "clustered_events": lambda: F.col("events_in_region") > 2, "multiallelic": lambda: F.col("n_alts_passing") > 1, "n_ratio": lambda: F.col("n_count") > F.col("alt_count") * F.lit(1e6),
    "strict_strand": lambda: (F.col("forward_alt") < 1) | (F.col("reverse_alt") < 1), "panel_of_normals": lambda: F.col("in_panel"), "low_allele_frac": lambda: F.col("af") < 0.0, "duplicate": lambda: F.col("unique_alt_count") < 1,
}


def error_probability(types: dict[str, list[Column]]) -> Column:
    """The highest probability inside each error type, the types taken as independent; -1 where nothing was observed."""
    tops = [c[0] if len(c) == 1 else F.greatest(*c) for c in types.values()]
    return combined_error(tops)


def het_sites(sites: DataFrame, error: float = 0.05, least: float = -10.0, ref: str = "ref_count", alt: str = "alt_count") -> DataFrame:
    """Sites whose log10 odds against both homozygous states are above ``least``: regularised beta tails by a sum."""
    def odds(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            n, k = int(x + y), int(y)
            if n == 0:
                out.append(float("-inf"))
                continue
            # P(alternate share within error of 0 or 1) under a flat prior: Beta(k + 1, n - k + 1) tails.
            tail = _beta_cdf(error, k + 1, n - k + 1) + _beta_cdf(error, n - k + 1, k + 1)
            out.append(-math.log10(max(tail, 1e-300)) if tail < 1 else 0.0)
        return pd.Series(out)

    return sites.withColumn("het_odds", F.pandas_udf(odds, "double")(ref, alt)).where(F.col("het_odds") >= -least / 10)


def _beta_cdf(x: float, a: int, b: int) -> float:
    """Regularised incomplete beta of whole parameters: a binomial tail."""
    n = a + b - 1
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log1p(-x)) for j in range(a, n + 1)))
