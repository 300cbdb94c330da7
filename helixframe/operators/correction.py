"""Base correction: by solid k-mers of a region's reads, and by pile-up columns; and overlapping-mate masks."""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations, product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correct_by_kmers(reads: list[str], k: int = 10, solid: int = 3, most: int = 2) -> list[str]:
    """Reads in which every k-mer seen fewer than ``solid`` times becomes its nearest solid k-mer (at most ``most`` bases away,
    the only one at that distance); positions whose votes disagree stay as they are."""
    counts = Counter(r[i : i + k] for r in reads for i in range(len(r) - k + 1))
    good = {x for x, n in counts.items() if n >= solid}
    fixes: dict[str, str | None] = {}

    def near(x: str, distance: int) -> set[str]:
        """Solid k-mers at just this distance: by the letters put at every choice of places, not by looking at all of them."""
        found = set()
        for places in combinations(range(k), distance):
            for letters in product(*("ACGT".replace(x[p], "") for p in places)):
                y = list(x)
                for p, b in zip(places, letters, strict=True):
                    y[p] = b
                found.add("".join(y))
        return found & good

    def nearest(x: str) -> str | None:
        for distance in range(1, most + 1):
            if found := near(x, distance):
                return found.pop() if len(found) == 1 else None
        return None

    out = []
    for r in reads:
        votes: list[Counter] = [Counter() for _ in r]
        for i in range(len(r) - k + 1):
            x = r[i : i + k]
            if counts[x] < solid:
                if x not in fixes:
                    fixes[x] = nearest(x)
                x = fixes[x] or x
            for j, b in enumerate(x):
                votes[i + j][b] += 1
        out.append("".join(v.most_common(1)[0][0] if len(v) == 1 or v and v.most_common(2)[0][1] > v.most_common(2)[1][1] else b for v, b in zip(votes, r, strict=True)))
    return out


def correct_regions(reads: DataFrame, k: int = 10, solid: int = 3) -> DataFrame:
    """(region, read_id, seq) with corrected; a region's reads are bounded by its depth limit."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("read_id").copy()
        pdf["corrected"] = correct_by_kmers(pdf["seq"].tolist(), k, solid)
        return pdf[["region", "read_id", "seq", "corrected"]]

    kinds = dict(reads.dtypes)
    return reads.select("region", "read_id", "seq").groupBy("region").applyInPandas(run, f"region {kinds['region']}, read_id {kinds['read_id']}, seq string, corrected string")


def correct_by_pileup(bases: DataFrame, least_lod: float = 3.0, error: float = 0.01, keys: tuple[str, ...] = ("contig", "pos")) -> DataFrame:
    """``bases`` (keys, base) with corrected: a base that is too rare at its place to be real becomes the commonest one.

    The odds compare an allele of its own frequency with errors alone. Counts are pre-aggregated, then joined back.
    """
    n = bases.groupBy(*keys, "base").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    top = F.max_by("base", F.struct("_n", "base")).over(w)
    total = F.sum("_n").over(w)
    f = F.col("_n") / total
    lod = F.col("_n") * F.log10(f / error) + (total - F.col("_n")) * (F.log10(F.greatest(1 - f, F.lit(1e-12))) - math.log10(1 - error))
    verdict = n.select(*keys, "base", F.when((lod < least_lod) & (f < 0.5), top).otherwise(F.col("base")).alias("corrected"))
    return bases.join(verdict, [*keys, "base"])


def known_site_mask(bases: DataFrame, sites: DataFrame) -> DataFrame:
    """Bases (contig, pos) that are at no known site."""
    return bases.join(sites.select("contig", "pos").distinct(), ["contig", "pos"], "left_anti")
