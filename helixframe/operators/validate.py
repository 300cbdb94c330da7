"""Validation issues of variant rows, one row per broken rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .variants import unused_alternates


def issues(variants: DataFrame, reference: DataFrame | None = None, known_ids: DataFrame | None = None, contigs: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(rule, contig, pos, id) for: ref_mismatch, unknown_id, unknown_contig, duplicate_allele, unused_alternate, unsorted."""
    out = []

    def add(rule: str, df: DataFrame) -> None:
        out.append(df.select(F.lit(rule).alias("rule"), "contig", "pos", F.col(id_col).alias("id")))

    if reference is not None:  # (contig, pos, base)
        add("ref_mismatch", variants.join(reference, ["contig", "pos"]).where(F.substring("ref", 1, 1) != F.col("base")))
    if known_ids is not None:
        add("unknown_id", variants.where(F.col(id_col).isNotNull()).join(known_ids.select(F.col("id").alias(id_col)), id_col, "left_anti"))
    if contigs is not None:
        add("unknown_contig", variants.join(contigs.select("contig"), "contig", "left_anti"))
    add("duplicate_allele", variants.where(F.size(F.array_distinct("alts")) < F.size("alts")))
    if "gts" in variants.columns:
        add("unused_alternate", variants.where(F.size(unused_alternates(F.col("alts"), F.col("gts"))) > 0))
    if "ord" in variants.columns:
        w = Window.partitionBy("contig").orderBy("ord", "pos")  # rows of one ord are in no order, so none of them breaks it
        add("unsorted", variants.withColumn("_p", F.lag("pos").over(w)).where("_p > pos").drop("_p"))
    return reduce(DataFrame.unionByName, out)


def dictionary_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, length, md5) of two sequence dictionaries side by side, with a status."""
    x = a.select("name", F.col("length").alias("length_a"), F.col("md5").alias("md5_a"))
    y = b.select("name", F.col("length").alias("length_b"), F.col("md5").alias("md5_b"))
    status = F.when(F.col("length_a").isNull(), "only_b").when(F.col("length_b").isNull(), "only_a").when(F.col("length_a") != F.col("length_b"), "length_differs").when(F.col("md5_a") != F.col("md5_b"), "md5_differs").otherwise("same")
    return x.join(y, "name", "full_outer").withColumn("status", status)


def dictionary_relation(comparison: DataFrame) -> DataFrame:
    """One row: equal, subset, superset, overlapping, disjoint or conflicting."""
    n = lambda s: F.count_if(F.col("status") == s)
    return comparison.agg(F.when(n("length_differs") + n("md5_differs") > 0, "conflicting").when(n("same") == 0, "disjoint").when((n("only_a") == 0) & (n("only_b") == 0), "equal").when(n("only_a") == 0, "subset").when(n("only_b") == 0, "superset").otherwise("overlapping").alias("relation"))


def reference_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions at which two references' chunks (contig, start, seq) differ."""
    def bases(df: DataFrame, name: str) -> DataFrame:
        return df.select("contig", "start", F.col("seq").alias(name))
    both = bases(a, "x").join(bases(b, "y"), ["contig", "start"])
    per = both.select("contig", "start", F.posexplode(F.arrays_zip(F.split("x", "").alias("x"), F.split("y", "").alias("y"))).alias("k", "p"))
    return per.where("p.x != p.y").select("contig", (F.col("start") + F.col("k")).alias("pos"), F.col("p.x").alias("base_a"), F.col("p.y").alias("base_b"))
