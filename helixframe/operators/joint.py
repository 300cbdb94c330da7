"""Joint genotyping: priors, likelihoods and confidence of sites, and reference blocks carried to other samples' variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let, log10_sum
from .ranges import point_join


def _diploid(n: Column, f) -> Column:
    """f(i, j) for all diploid genotypes i <= j of n alleles, in VCF order."""
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.transform(F.sequence(F.lit(0), j), lambda i: f(i, j))))


def genotype_priors(het: Column, hom: Column) -> Column:
    """log10 priors of diploid genotypes from log10 priors of one and of two copies of each allele (arrays; the reference's are
    not used)."""
    one = lambda a: F.when(a > 0, F.get(het, a)).otherwise(0.0)
    return _diploid(F.size(het), lambda i, j: F.when(i == j, F.when(i > 0, F.get(hom, i)).otherwise(0.0)).otherwise(one(i) + one(j)))


def joint_pl(likelihoods: Column, most: int = 0) -> Column:
    """PLs of diploid genotypes from log10 likelihoods of reads (array of reads, each an array with a value per allele).

    Reads without a finite value for every allele are left out; most > 0 bounds the PLs.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    pair = lambda x, y: F.greatest(x, y) + F.log10(1.0 + F.pow(F.lit(10.0), -F.abs(x - y))) - F.log10(F.lit(2.0))

    def scores(given: Column, reads: Column) -> Column:
        score = lambda i, j: F.aggregate(reads, F.lit(0.0), lambda s, r: s + F.when(i == j, F.get(r, i)).otherwise(pair(F.get(r, i), F.get(r, j))))
        return _diploid(F.size(F.get(given, F.lit(0))), score)

    def phred(scores: Column, top: Column) -> Column:
        x = F.transform(scores, lambda x: F.floor(-10.0 * (x - top) + 0.5).cast("int"))
        return F.transform(x, lambda x: F.least(x, F.lit(most))) if most > 0 else x

    scored = let(likelihoods, lambda given: let(F.filter(given, lambda r: F.forall(r, finite)), lambda reads: scores(given, reads)))
    return let(scored, lambda s: let(F.array_max(s), lambda top: phred(s, top)))


def log10_reference(pl: Column, log10_priors: Column) -> Column:
    """log10 P(genotype 0) of a sample; negative PLs are missing, null without any or without the first."""
    terms = F.zip_with(pl, log10_priors, lambda x, p: F.when(x >= 0, -0.1 * x + p))
    known = F.array_compact(terms)
    return F.when(F.size(known) > 0, F.least(F.get(terms, F.lit(0)) - log10_sum(known), F.lit(0.0)))


def reference_confidence(samples: DataFrame, log10_priors: Column, site: list[str], pl: str = "pl") -> DataFrame:
    """Per site: joint log10 probability that no sample varies, its QUAL, and how many samples have likelihoods."""
    return samples.withColumn("_p", log10_reference(F.col(pl), log10_priors)).groupBy(*site).agg(
        F.coalesce(F.sum("_p"), F.lit(0.0)).alias("log10_p_reference"), F.greatest(F.coalesce(-10.0 * F.sum("_p"), F.lit(0.0)), F.lit(0.0)).alias("qual"), F.count("_p").alias("n_samples"))


def call_confidence(pl: Column, ref_pseudocount: Column, alt_pseudocount: Column, most: int = 100) -> Column:
    """struct(qual, log10_p_absent) of a diploid biallelic call (three PLs): allele frequencies from pseudocounts and effective
    allele counts, until these change by at most 0.1. 0 and null for negative PLs."""
    half = F.log10(F.lit(0.5))

    def posteriors(pl: Column, ref: Column, alt: Column) -> Column:
        z = F.array(F.get(pl, F.lit(0)) * -0.1 + 2.0 * ref, F.log10(F.lit(2.0)) + F.get(pl, F.lit(1)) * -0.1 + ref + alt, F.get(pl, F.lit(2)) * -0.1 + 2.0 * alt)
        return let(z, lambda z: let(log10_sum(z), lambda total: F.transform(z, lambda x: x - total)))

    def counts(p: Column) -> Column:
        return F.struct((2.0 * F.get(p, F.lit(0)) + F.get(p, F.lit(1))).alias("refs"), (F.get(p, F.lit(1)) + 2.0 * F.get(p, F.lit(2))).alias("alts"))

    def moved(s: Column, n: Column) -> Column:
        total = ref_pseudocount + alt_pseudocount + n["refs"] + n["alts"]
        return F.struct(
            F.log10((ref_pseudocount + n["refs"]) / total).alias("ref"), F.log10((alt_pseudocount + n["alts"]) / total).alias("alt"), n["refs"].alias("refs"), n["alts"].alias("alts"),
            (F.greatest(F.abs(n["refs"] - s["refs"]), F.abs(n["alts"] - s["alts"])) > 0.1).alias("on"))

    def step(pl: Column, s: Column) -> Column:
        p = F.transform(posteriors(pl, s["ref"], s["alt"]), lambda x: F.pow(F.lit(10.0), x))
        return F.when(s["on"], let(let(p, counts), lambda n: moved(s, n))).otherwise(s)

    start = F.struct(half.alias("ref"), half.alias("alt"), F.lit(0.0).alias("refs"), F.lit(0.0).alias("alts"), F.lit(True).alias("on"))

    def absent(pl: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda s, _: step(pl, s), lambda s: F.get(posteriors(pl, s["ref"], s["alt"]), F.lit(0)))

    def call(pl: Column) -> Column:
        ok = F.forall(pl, lambda x: x >= 0)
        return let(F.when(ok, absent(pl)), lambda x: F.struct(F.when(ok, F.greatest(F.lit(0.0), -10.0 * x)).otherwise(0.0).alias("qual"), F.when(ok, F.least(x, F.lit(0.0))).alias("log10_p_absent")))

    return let(pl, call)


def carry_blocks(variants: DataFrame, blocks: DataFrame, fields: list[str]) -> DataFrame:
    """Every sample's evidence at every variant site: its own row (contig, pos, sample, fields), or else that of its reference
    block (contig, start, end, sample, fields) that spans the site; from_block tells which. Of several blocks the latest start
    counts. Samples with neither have no row."""
    sites = variants.select("contig", "pos").distinct()
    spanning = point_join(sites, blocks.select("contig", "start", "end", "sample", *fields))
    carried = spanning.groupBy("contig", "pos", F.col("sample_r").alias("sample")).agg(F.max_by(F.struct(*[F.col(f"{x}_r").alias(x) for x in fields]), "start_r").alias("_f"))
    carried = carried.join(variants.select("contig", "pos", "sample"), ["contig", "pos", "sample"], "left_anti").select("contig", "pos", "sample", *[F.col("_f")[x].alias(x) for x in fields], F.lit(True).alias("from_block"))
    return variants.select("contig", "pos", "sample", *fields, F.lit(False).alias("from_block")).unionByName(carried)


def remap_values(values: Column, source: Column, number: str = "R") -> Column:
    """A per-allele field for other alleles: ``source`` holds, for each target alternate, the number of the old alternate (from 1)
    or null; A fields have a value per alternate, R fields one for the reference first. Null where there is no old value."""
    at = lambda k: F.when(k > 0, F.get(values, k - 1 if number == "A" else k))
    taken = F.transform(source, at)
    return taken if number == "A" else F.concat(F.array(F.get(values, F.lit(0))), taken)


def apply_scores(variants: DataFrame, scores: DataFrame, by_allele: bool = False) -> DataFrame:
    """``variants`` (contig, pos, ref, alts) with score, culprit, positive and negative of a score table: by (contig, pos, ref, alt)
    for the best-scored of their alternates, or by site. Rows without a score have nulls."""
    given = ["score", "culprit", "positive", "negative"]
    if not by_allele:
        site = scores.groupBy("contig", "pos").agg(F.max_by(F.struct(*given), F.struct("score", "ref", "alt")).alias("_s"))
        return variants.join(site, ["contig", "pos"], "left").select(*variants.columns, *[F.col("_s")[x].alias(x) for x in given])
    site = ["contig", "pos", "ref", "alts"]
    each = variants.select(*site).distinct().select(*site, F.explode("alts").alias("alt")).join(scores, ["contig", "pos", "ref", "alt"])
    best = each.groupBy(*site).agg(F.max_by(F.struct(*given), F.struct("score", "alt")).alias("_s"))
    return variants.join(best, site, "left").select(*variants.columns, *[F.col("_s")[x].alias(x) for x in given])


def best_and_second(likelihoods: DataFrame, read: str = "read_id", value: str = "log10_likelihood") -> DataFrame:
    """Per read: its best and second-best likelihood over alleles (null if there is one only), and their distance."""
    top = F.slice(F.sort_array(F.collect_list(value), asc=False), 1, 2)  # a site's alleles: a bounded list
    g = likelihoods.groupBy(read).agg(top.alias("_t"))
    return g.select(read, F.get("_t", F.lit(0)).alias("best"), F.get("_t", F.lit(1)).alias("second"), (F.get("_t", F.lit(0)) - F.get("_t", F.lit(1))).alias("uncertainty"))
