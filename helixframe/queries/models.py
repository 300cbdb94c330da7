"""Numeric kernels and models; without SQL, tested against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import genotype, kernels
from ..plans import encodings as E


def _pairs(spark, d):
    v = E.variants(spark, d).select("id", "contig", "size")
    s = F.substr(F.repeat(F.lit("ACGTTGCAAC"), 8), F.col("size") % 9 + 1, F.lit(40))
    return v.select("id", "contig", F.concat(F.substr(s, F.lit(1), F.lit(12)), F.lit("G"), F.substr(s, F.lit(14), F.lit(12))).alias("read"), s.alias("hap"), F.array_repeat(F.lit(30) - F.col("size") % 10, 25).alias("quals"))


def pairhmm_scores(spark, d):
    return kernels.score_pairs(_pairs(spark, d)).select("id", F.round("log10_likelihood", 6).alias("log10_likelihood"))


def sw_scores(spark, d):
    return kernels.align_pairs(_pairs(spark, d).select("id", F.col("hap").alias("ref"), F.col("read").alias("alt"))).select("id", "score", "cigar", "offset")


def best_alleles(spark, d):
    p = kernels.score_pairs(_pairs(spark, d)).select(F.col("contig").alias("read_id"), F.concat(F.lit("h"), F.col("id") % 4).alias("allele"), (F.col("id") % 4).alias("allele_order"), "log10_likelihood")
    m = kernels.normalise_likelihoods(kernels.marginalise(p)).withColumn("allele_order", F.substring("allele", 2, 1).cast("int"))
    return kernels.best_allele(m)


def assembled_haplotypes(spark, d):
    p = _pairs(spark, d).select(F.col("contig").alias("region"), F.col("hap").alias("seq"), F.lit(False).alias("is_ref"))
    ref = p.groupBy("region").agg(F.min("seq").alias("seq")).withColumn("is_ref", F.lit(True))
    return kernels.assemble_regions(p.unionByName(ref), k=11)


def _weighted_points(v):
    """The distinct (x, y) of all rows, by x and y, and how often each occurs."""
    p = v.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("x", "ascending"), ("y", "ascending")])
    return np.c_[p.column("x").to_numpy(), p.column("y").to_numpy()], p.column("n").to_numpy().astype(float)


def gmm_scores(spark, d):
    v = E.variants(spark, d).select("id", (F.col("size") / 10.0).alias("x"), (F.col("qual") / 500.0).alias("y"))
    x, n = _weighted_points(v)
    end, fifth = np.cumsum(n), n.sum() // 5
    good, bad = np.clip(end - fifth, 0, n), np.clip(fifth + 2 - (end - n), 0, n)
    models = [kernels.fit_mixture(x[w > 0], k, weight=w[w > 0]) for w, k in ((good, 3), (bad, 2))]
    return kernels.mixture_scores(v, ["x", "y"], *models).select("id", F.round("lod", 6).alias("lod"))


def orientation_em(spark, d):
    r = E.reads(spark, d)
    rows = r.groupBy(F.substr(F.lit("ACGTACGTA"), (F.col("tile") + 1), F.lit(3)).alias("context"), F.col("len").alias("depth"), (F.col("len") % 5).alias("alt"), F.least(F.col("len") % 5, F.col("x") % 3).cast("int").alias("alt_f1r2")).agg(F.count(F.lit(1)).alias("n"))
    return kernels.orientation_priors(rows)


def active_regions(spark, d):
    r = E.reads(spark, d).groupBy("contig", (F.col("pos") / 50).cast("long").alias("pos")).agg((F.count_if(F.col("score") % 10 == 0) / F.count(F.lit(1))).alias("activity"))
    return kernels.active_regions(r, 0.15)


def contamination(spark, d):
    r = E.reads(spark, d).groupBy(F.col("library").alias("sample"), (F.col("len") % 4 == 0).cast("int").alias("alt"), F.col("len").alias("depth"), (F.col("tile") / 10.0 + 0.05).alias("frequency")).agg(F.count(F.lit(1)).alias("n"))
    return kernels.contamination_by_sample(r)


def exact_tests(spark, d):
    v = E.variants(spark, d).select("id", *[(F.col("size") % k).alias(n) for k, n in ((7, "a"), (11, "b"), (5, "c"), (13, "e"))])
    return v.select("id", F.round(genotype.fisher_exact("a", "b", "c", "e"), 9).alias("fisher"), F.round(genotype.excess_heterozygosity("b", "a", "c"), 6).alias("excess_het"))


def allele_frequency_em(spark, d):
    v = E.variants(spark, d).select("contig", F.array(*[F.col("size") % k * 10 for k in (7, 5, 3)]).alias("pl"))
    return v.groupBy("contig").agg(F.collect_list("pl").alias("pls")).select("contig", F.round(genotype.allele_frequency_em("pls"), 6).alias("af"))


QUERIES = {f.__name__: (f, None) for f in (pairhmm_scores, sw_scores, best_alleles, assembled_haplotypes, gmm_scores, orientation_em, active_regions, contamination, exact_tests, allele_frequency_em)}
