"""Stratified evaluation of call sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .variants import is_transition


def af_bin(af: Column) -> Column:
    return F.when(af <= 0, "0").when(af < 0.01, "0-.01").when(af < 0.05, ".01-.05").when(af < 0.1, ".05-.1").when(af < 0.5, ".1-.5").when(af < 1, ".5-1").otherwise("1")


def counters() -> list[Column]:
    """Counts of one row per alternate: columns ref, alt, kind (of variants.allele_type)."""
    ts = is_transition(F.col("ref"), F.col("alt"))
    snp = F.col("kind") == "SNP"
    return [
        F.count(F.lit(1)).alias("n_alleles"), F.count_if(snp).alias("n_snps"), F.count_if(F.col("kind") == "MNP").alias("n_mnps"),
        F.count_if((F.col("kind") == "INDEL") & (F.length("alt") > F.length("ref"))).alias("n_insertions"), F.count_if((F.col("kind") == "INDEL") & (F.length("alt") < F.length("ref"))).alias("n_deletions"),
        F.count_if(snp & ts).alias("n_transitions"), F.count_if(snp & ~ts).alias("n_transversions"),
    ]


def stratified(alleles: DataFrame, strata: list[str]) -> DataFrame:
    """Counters per value of each stratum on its own (not crossed), and over all: one pass with grouping sets."""
    names = [F.col(s) for s in strata]
    sets = [[s] for s in names] + [[]]
    out = alleles.groupingSets(sets, *names).agg(*counters(), F.grouping_id().alias("_g"))
    kind, level = F.lit("all"), F.lit("all")
    for k, s in enumerate(strata):
        mask = ((1 << len(strata)) - 1) & ~(1 << (len(strata) - 1 - k))
        kind = F.when(F.col("_g") == mask, s).otherwise(kind)
        level = F.when(F.col("_g") == mask, F.col(s).cast("string")).otherwise(level)
    return out.select(kind.alias("stratification"), level.alias("level"), *[c for c in out.columns if c.startswith("n_")])


def ratio(df: DataFrame, top: str, bottom: str, name: str) -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")))


def contingency(a: DataFrame, b: DataFrame, key: list[str], status: str) -> DataFrame:
    """Counts of status in a against status in b at the same key; ``missing`` where b has none."""
    other = b.select(*key, F.col(status).alias("_other")).dropDuplicates(key)
    return a.join(other, key, "left").groupBy(F.col(status).alias("eval_status"), F.coalesce("_other", F.lit("missing")).alias("comp_status")).agg(F.count(F.lit(1)).alias("n"))


def mendelian_violations(trios: DataFrame) -> DataFrame:
    """Counts per (mother, father, child) alternate-allele counts, with whether the child is possible."""
    m, f, c = F.col("mother"), F.col("father"), F.col("child")
    gives = lambda x, allele: (x > 0) if allele else (x < 2)
    possible = F.when(c == 0, gives(m, 0) & gives(f, 0)).when(c == 2, gives(m, 1) & gives(f, 1)).otherwise((gives(m, 0) & gives(f, 1)) | (gives(m, 1) & gives(f, 0)))
    return trios.groupBy("mother", "father", "child").agg(F.count(F.lit(1)).alias("n"), F.max(~possible).alias("violation"))


def indel_histogram(alleles: DataFrame, most: int = 10) -> DataFrame:
    """Alleles per indel length from -most to most; longer ones are left out."""
    size = F.length("alt") - F.length("ref")
    return alleles.where((F.col("kind") == "INDEL") & (F.abs(size) <= most)).groupBy(size.alias("length")).agg(F.count(F.lit(1)).alias("n"))


def pairwise_diversity(df: DataFrame, ac: str = "ac", an: str = "an") -> DataFrame:
    """Sum over sites of the chance that two chromosomes differ, and the number of sites."""
    hets = F.try_divide(2.0 * F.col(ac) * (F.col(an) - F.col(ac)), F.col(an) * (F.col(an) - 1.0))
    return df.agg(F.sum(hets).alias("theta_pi"), F.count(F.lit(1)).alias("n_sites"))


def compare(eval_set: DataFrame, comp: DataFrame, strict: bool = True, flag: str = "in_comp") -> DataFrame:
    """``eval_set`` with whether ``comp`` has a row at its site, with the same alleles if ``strict``. Rows of comp that repeat a
    site do no harm: it joins as its distinct keys."""
    key = ["contig", "pos", *(["ref", "alts"] if strict else [])]
    known = comp.select(*key).distinct().withColumn(flag, F.lit(True))
    return eval_set.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def novelty(eval_set: DataFrame, known: DataFrame) -> DataFrame:
    """``eval_set`` with novelty: known or novel, by site."""
    return compare(eval_set, known, strict=False, flag="_known").withColumn("novelty", F.when(F.col("_known"), "known").otherwise("novel")).drop("_known")


def frequency_summary(genotypes: DataFrame, keys: list[str], dosage: str = "dosage") -> DataFrame:
    """Per key: called genotypes, and the mean allele frequency with a heterozygote as a half and a homozygote as one."""
    share = F.when(F.col(dosage) == 1, 0.5).when(F.col(dosage) >= 2, 1.0).otherwise(0.0)
    return genotypes.where(F.col(dosage) >= 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_called"), F.avg(share).alias("mean_af"))


def watterson(df: DataFrame, chromosomes: int) -> DataFrame:
    """Segregating sites over the harmonic number of ``chromosomes`` - 1."""
    harmonic = sum(1.0 / k for k in range(1, chromosomes))
    return df.agg(F.count(F.lit(1)).alias("n_sites"), (F.count(F.lit(1)) / F.lit(harmonic)).alias("theta_w"))
