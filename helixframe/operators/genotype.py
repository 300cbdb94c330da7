"""Genotype arithmetic on likelihood arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def best_genotype(pl: Column) -> Column:
    """struct(genotype, gq): the first smallest non-negative PL; GQ is the runner-up's distance, at most 99, 0 without one."""
    valid = F.filter(pl, lambda x: x >= 0)
    low = F.array_min(valid)
    rest = F.element_at(F.sort_array(valid), 2)
    gq = F.when(F.size(valid) >= 2, F.least(rest - low, F.lit(99))).otherwise(0)
    return F.struct((F.array_position(pl, low) - 1).cast("int").alias("genotype"), gq.cast("int").alias("gq"))


def posterior_genotype(pl: Column, log10_priors: Column) -> Column:
    """struct(genotype, gq, posteriors): likelihoods times priors, normalised."""
    z = F.zip_with(pl, log10_priors, lambda x, p: -x / 10.0 + p)
    top = F.array_max(z)
    total = top + F.log10(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - top)))
    post = F.transform(z, lambda x: x - total)
    best = F.array_max(post)
    second = F.element_at(F.reverse(F.array_sort(post)), 2)
    gq = F.when(F.size(post) > 1, F.least(F.floor(10.0 * (best - second) + 0.5), F.lit(99))).otherwise(0)
    return F.struct((F.array_position(post, best) - 1).cast("int").alias("genotype"), gq.cast("int").alias("gq"), F.transform(post, lambda x: F.pow(F.lit(10.0), x)).alias("posteriors"))


def site_quality(log10_no_variant: Column) -> Column:
    """Aggregate: -10 times the sum over samples of log10 P(no variant), at least 0."""
    return F.greatest(F.lit(0.0), -10.0 * F.sum(log10_no_variant))


def log10_hom_ref(pl: Column) -> Column:
    """log10 P(genotype 0) of one sample under flat priors."""
    z = F.transform(pl, lambda x: -x / 10.0)
    top = F.array_max(z)
    return z[0] - (top + F.log10(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - top))))


def inbreeding_coefficient(refs: Column, hets: Column, homs: Column, least: int = 10) -> Column:
    """1 - observed / expected heterozygotes, null below ``least`` samples or without variation."""
    n = refs + hets + homs
    p = F.try_divide(2.0 * refs + hets, 2.0 * n)
    return F.when(n >= least, 1.0 - F.try_divide(hets.cast("double"), 2.0 * p * (1.0 - p) * n))


def _excess_het(hom_ref: int, het: int, hom_var: int) -> float:
    """Phred-scaled exact test for more heterozygotes than Hardy-Weinberg expects (mid-p of the observed count)."""
    n = hom_ref + het + hom_var
    if n == 0:
        return 0.0
    rare = 2 * min(hom_ref, hom_var) + het
    start = rare * (2 * n - rare) // (2 * n)
    start += (start ^ rare) & 1
    p = np.zeros(rare + 1)
    p[start] = 1.0
    h, r = start, (rare - start) // 2
    c = n - h - r
    while h > 1:
        p[h - 2] = p[h] * h * (h - 1) / (4.0 * (r + 1) * (c + 1))
        h, r, c = h - 2, r + 1, c + 1
    h, r = start, (rare - start) // 2
    c = n - h - r
    while h <= rare - 2:
        p[h + 2] = p[h] * 4.0 * r * c / ((h + 2.0) * (h + 1.0))
        h, r, c = h + 2, r - 1, c - 1
    p /= p.sum()
    tail = p[het] / 2 + p[het + 1 :].sum()
    return 999.0 if tail < 10**-99.9 else max(0.0, -10 * math.log10(tail))


def _rowwise(f, *columns: Column | str) -> Column:
    """A Column of f over the rows' values, in Arrow batches; made when used, as workers import this module without a session."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*x) for x in zip(*series, strict=True)])

    return F.pandas_udf(run, "double")(*columns)


def excess_heterozygosity(hom_ref: Column | str, het: Column | str, hom_var: Column | str) -> Column:
    return _rowwise(_excess_het, hom_ref, het, hom_var)


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the sum of the probabilities of all tables with these margins that are no likelier than this one."""
    lf = math.lgamma
    row, col, n = a + b, a + c, a + b + c + d

    def log_p(x: int) -> float:
        return lf(row + 1) + lf(n - row + 1) + lf(col + 1) + lf(n - col + 1) - lf(n + 1) - lf(x + 1) - lf(row - x + 1) - lf(col - x + 1) - lf(n - row - col + x + 1)

    seen = log_p(a)
    total = sum(math.exp(p) for x in range(max(0, row + col - n), min(row, col) + 1) if (p := log_p(x)) <= seen + 1e-12)
    return min(1.0, total)


def fisher_exact(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    return _rowwise(_fisher, a, b, c, d)


def _allele_frequency_em(likelihoods: np.ndarray, rounds: int = 50, tolerance: float = 1e-9) -> float:
    """Alternate frequency that maximises the likelihood of diploid biallelic samples (rows: hom-ref, het, hom-var)."""
    f = 0.5
    for _ in range(rounds):
        w = likelihoods * np.array([(1 - f) ** 2, 2 * f * (1 - f), f * f])
        total = w.sum(1, keepdims=True)
        new = float(((w / np.where(total > 0, total, 1)) @ np.array([0.0, 1.0, 2.0])).mean() / 2)
        if abs(new - f) < tolerance:
            return new
        f = new
    return f


def _site_frequency(pls) -> float:
    return _allele_frequency_em(np.power(10.0, -np.array([list(x) for x in pls], float) / 10)) if len(pls) else float("nan")


def allele_frequency_em(pls: Column | str) -> Column:
    """Per site: array of samples' PL triples -> alternate frequency by EM."""
    return _rowwise(_site_frequency, pls)


def reference_confidence(ref_quals: Column, alt_quals: Column) -> Column:
    """PLs of hom-ref, het and hom-var from the base qualities of reference and other bases (arrays), least 0."""
    def part(quals: Column, state: int, alt: bool) -> Column:
        e = lambda q: F.pow(F.lit(10.0), -q.cast("double") / 10.0)
        p = {0: lambda q: 1 - e(q), 1: lambda q: F.lit(0.5) * (1 - e(q)) + F.lit(0.5) * e(q) / 3, 2: lambda q: e(q) / 3}[2 - state if alt else state]
        return F.aggregate(quals, F.lit(0.0), lambda s, q: s + F.log10(F.greatest(p(q), F.lit(1e-30))))

    raw = F.array(*[-10.0 * (part(ref_quals, k, False) + part(alt_quals, k, True)) for k in range(3)])
    return F.transform(raw, lambda x: F.floor(x - F.array_min(raw) + 0.5).cast("int"))
