"""Numeric functions: phred scale, rounding rules, quantile rules, combinatorics, and Welford-free summaries."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def phred(p: Column, floor: float = 1e-300) -> Column:
    """-10 log10 p; probabilities below ``floor`` count as it."""
    return -10.0 * F.log10(F.greatest(p, F.lit(floor)))


def unphred(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q.cast("double") / 10.0)


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), also for negative numbers."""
    return F.floor(x + 0.5).cast("long")


def genotype_index(i: Column, j: Column) -> Column:
    """Place of the diploid genotype i/j in VCF order."""
    low, high = F.least(i, j), F.greatest(i, j)
    return (high * (high + 1) / 2).cast("int") + low


def genotypes_of(alleles: int, ploidy: int = 2) -> list[tuple[int, ...]]:
    """Genotypes in VCF order."""
    def walk(n: int, top: int):
        if n == 0:
            yield ()
            return
        for a in range(top + 1):
            for rest in walk(n - 1, a):
                yield (*rest, a)
    return list(walk(ploidy, alleles - 1))


def quantile_floor(sorted_values: Column, f: float) -> Column:
    """Discrete: element floor(f (n - 1)) of a sorted array; null if it is empty."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.element_at(sorted_values, F.floor(f * (n - 1)).cast("int") + 1))


def quantile_n_plus_one(sorted_values: Column, percent: float) -> Column:
    """p (n + 1) / 100 with interpolation, clamped to the ends; null if the array is empty."""
    n = F.size(sorted_values)
    at = F.lit(percent) * (n + 1) / 100.0
    k = F.floor(at).cast("int")
    low = F.element_at(sorted_values, F.least(F.greatest(k, F.lit(1)), n))
    high = F.element_at(sorted_values, F.least(F.greatest(k + 1, F.lit(1)), n))
    value = F.when(at < 1, F.element_at(sorted_values, 1)).when(at >= n, F.element_at(sorted_values, -1)).otherwise(low + (at - k) * (high - low))
    return F.when(n > 0, value)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where ``value`` is computed once a row however often f names it: what a lambda's body repeats is computed as often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def log10_sum(logs: Column) -> Column:
    """log10 of the sum of powers of ten, for an array of logs."""
    total = lambda x, top: top + F.log10(F.aggregate(x, F.lit(0.0), lambda s, y: s + F.pow(F.lit(10.0), y - top)))
    return let(logs, lambda x: let(F.array_max(x), lambda top: total(x, top)))


#: Log factorials for small counts; larger ones by Stirling's series.
_LN = [0.0]
for _k in range(1, 171):
    _LN.append(_LN[-1] + math.log(_k))


def ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series; exact to 1e-10 from n = 8 on, table below."""
    x = n.cast("double")
    series = x * F.log(F.greatest(x, F.lit(1.0))) - x + 0.5 * F.log(2 * math.pi * F.greatest(x, F.lit(1.0))) + 1 / (12 * F.greatest(x, F.lit(1.0))) - 1 / (360 * F.pow(F.greatest(x, F.lit(1.0)), 3)) + 1 / (1260 * F.pow(F.greatest(x, F.lit(1.0)), 5))
    small = F.element_at(F.array(*[F.lit(v) for v in _LN[:16]]), F.least(n.cast("int"), F.lit(15)) + 1)
    return F.when(n < 16, small).otherwise(series)


def fixed_text(x: Column, decimals: int) -> Column:
    """A number with a fixed count of decimals, rounded half up away from zero; null and NaN give NaN."""
    text = F.format_string(f"%.{decimals}f", F.round(x.cast("double"), decimals))
    return F.when(x.isNull() | F.isnan(x.cast("double")), "NaN").otherwise(text)


def short_text(x: Column) -> Column:
    """The shortest text that reads back as the same double, whole numbers without decimals."""
    v = x.cast("double")
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(v.cast("string"))
