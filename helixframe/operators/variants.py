"""Variant rows: types, selection, labels, splitting, tables, alleles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symbolic(alt: Column) -> Column:
    return alt.startswith("<") | alt.contains("[") | alt.contains("]") | (alt == "*")


def allele_type(ref: Column, alt: Column) -> Column:
    """SNP, MNP, INDEL or SYMBOLIC of one alternate."""
    return F.when(symbolic(alt), "SYMBOLIC").when(F.length(ref) != F.length(alt), "INDEL").when(F.length(ref) == 1, "SNP").otherwise("MNP")


def variant_type(ref: Column, alts: Column) -> Column:
    """NO_VARIATION without alternates, the alternates' common type, MIXED otherwise."""
    kinds = F.array_distinct(F.transform(F.filter(alts, lambda a: a != "."), lambda a: allele_type(ref, a)))
    return F.when(F.size(kinds) <= 0, "NO_VARIATION").when(F.size(kinds) == 1, kinds[0]).otherwise("MIXED")


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def indel_sizes(ref: Column, alts: Column) -> Column:
    return F.transform(alts, lambda a: F.abs(F.length(a) - F.length(ref)))


def select_types(df: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), alleles: str = "ALL", min_indel: int = 0, max_indel: int = 2**31 - 1) -> DataFrame:
    """Rows by type, by number of alternates (ALL, BIALLELIC, MULTIALLELIC) and by indel size."""
    kind, n, sizes = variant_type(F.col("ref"), F.col("alts")), F.size("alts"), indel_sizes(F.col("ref"), F.col("alts"))
    tests = [kind.isin(*include)] if include else []
    tests += [~kind.isin(*exclude)] if exclude else []
    tests += [n == 1] if alleles == "BIALLELIC" else [n > 1] if alleles == "MULTIALLELIC" else []
    tests += [(kind != "INDEL") | (F.array_min(sizes) >= min_indel) & (F.array_max(sizes) <= max_indel)]
    return df.where(reduce(lambda a, b: a & b, tests))


def labels(existing: Column, rules: dict[str, Column]) -> Column:
    """FILTER after rules: failing rules' labels are added, PASS goes, labels are sorted; without any it is PASS."""
    new = [F.when(c, F.lit(n)) for n, c in rules.items()]
    kept = F.filter(F.coalesce(existing, F.array().cast("array<string>")), lambda x: ~x.isin("PASS", "."))
    out = F.array_sort(F.array_distinct(F.concat(kept, F.array_compact(F.array(*new)))))
    return F.when(F.size(out) == 0, F.array(F.lit("PASS"))).otherwise(out)


def allele_specific_labels(alts: Column, rule: dict[str, object]) -> Column:
    """Labels that every alternate fails: rule maps a label to a function (alternate's index, 0-based) -> Column."""
    per = F.transform(F.sequence(F.lit(0), F.size(alts) - 1), lambda i: F.array_compact(F.array(*[F.when(f(i), F.lit(n)) for n, f in rule.items()])))
    return F.array_sort(F.reduce(per, F.array(*[F.lit(n) for n in rule]), lambda s, x: F.array_intersect(s, x)))


def cluster_flag(df: DataFrame, size: int, window: int, pos: str = "pos", tie: str = "id") -> Column:
    """Whether a row belongs to ``size`` rows of its contig that lie within ``window`` bases."""
    w = Window.partitionBy("contig").orderBy(pos, tie)
    starts = F.coalesce(F.lead(pos, size - 1).over(w) - F.col(pos) <= window, F.lit(False))
    return starts.cast("int")


def clustered(df: DataFrame, size: int, window: int, pos: str = "pos", tie: str = "id") -> DataFrame:
    """``df`` with in_cluster."""
    w = Window.partitionBy("contig").orderBy(pos, tie)
    flagged = df.withColumn("_c", cluster_flag(df, size, window, pos, tie))
    return flagged.withColumn("in_cluster", F.max("_c").over(w.rowsBetween(-(size - 1), 0)) == 1).drop("_c")


def split_multiallelic(df: DataFrame, per_alt: tuple[str, ...] = (), per_allele: tuple[str, ...] = (), per_genotype: tuple[str, ...] = ()) -> DataFrame:
    """One row per alternate, with the values of array columns that belong to it: its own of those with one per alternate, the
    reference's and its own of those with one per allele, and those of 0/0, 0/k and k/k of those with one per diploid genotype."""
    out = df.drop("alt_index", "alt").select("*", F.posexplode("alts").alias("alt_index", "alt"))
    k = F.col("alt_index") + 1
    made = {c: F.get(F.col(c), F.col("alt_index")) for c in per_alt}
    made |= {c: F.array(F.get(F.col(c), F.lit(0)), F.get(F.col(c), k)) for c in per_allele}
    het = (k * (k + 1) / 2).cast("int")
    made |= {c: F.array(F.get(F.col(c), F.lit(0)), F.get(F.col(c), het), F.get(F.col(c), het + k)) for c in per_genotype}
    return out.withColumns(made) if made else out


def minimal_alleles(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt) after dropping the common suffix, then the common prefix, one base always kept."""
    n = F.least(F.length(ref), F.length(alt)) - 1
    steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda s, i: F.struct(
        F.when(s["on"] & (F.substr(ref, F.length(ref) - i + 1, F.lit(1)) == F.substr(alt, F.length(alt) - i + 1, F.lit(1))), i).otherwise(s["k"]).alias("k"),
        (s["on"] & (F.substr(ref, F.length(ref) - i + 1, F.lit(1)) == F.substr(alt, F.length(alt) - i + 1, F.lit(1)))).alias("on")))["k"]
    r, a = F.substr(ref, F.lit(1), F.length(ref) - tail), F.substr(alt, F.lit(1), F.length(alt) - tail)
    m = F.least(F.length(r), F.length(a)) - 1
    heads = F.when(m > 0, F.sequence(F.lit(1), F.greatest(m, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    head = F.size(F.filter(heads, lambda i: F.substr(r, F.lit(1), i) == F.substr(a, F.lit(1), i)))
    return F.struct((pos + head).alias("pos"), F.substr(r, head + 1, F.length(r)).alias("ref"), F.substr(a, head + 1, F.length(a)).alias("alt"))


def left_align(variants: DataFrame, reference: DataFrame, most: int = 200) -> DataFrame:
    """Indels moved left while their last base equals the base before them, at most ``most`` bases.

    reference: (contig, start, seq), chunks of sequence. A variant meets the bases in front of it in a join on the chunk; where
    there are none it is trimmed only. Every row of ``variants`` comes out once.
    """
    width = reference.agg(F.max(F.length("seq")).alias("n")).first()["n"] or 1
    columns = variants.columns
    rows = variants.withColumn("_row", F.monotonically_increasing_id())
    near = rows.select("_row", "contig", F.explode(F.sequence(F.floor(F.greatest(F.col("pos") - most, F.lit(0)) / width), F.floor(F.col("pos") / width))).alias("_chunk"))
    parts = near.join(reference.select("contig", F.floor(F.col("start") / width).alias("_chunk"), F.col("start").alias("_s"), "seq"), ["contig", "_chunk"])
    lead = parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_s", "seq"))).alias("_p"))
    lead = lead.select("_row", F.col("_p")[0]["_s"].alias("_from"), F.array_join(F.transform("_p", lambda x: x["seq"]), "").alias("_seq"))

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [_shift(p, r, a, s or "", p if f is None or f != f else int(f), most) for p, r, a, s, f in zip(b["pos"], b["ref"], b["alt"], b["_seq"], b["_from"], strict=True)]
            b = b[columns].copy()
            b["pos"], b["ref"], b["alt"] = ([x[k] for x in done] for k in range(3))
            yield b

    return rows.join(lead, "_row", "left").drop("_row").mapInPandas(move, variants.schema)


def _shift(pos: int, ref: str, alt: str, seq: str, start: int, most: int) -> tuple[int, str, str]:
    moved = 0
    while len(ref) != len(alt) and ref and alt and ref[-1] == alt[-1] and moved < most and pos - 1 >= start:
        ref, alt = ref[:-1], alt[:-1]
        if not ref or not alt:
            pos -= 1
            moved += 1
            base = seq[pos - start]
            ref, alt = base + ref, base + alt
    while len(ref) > 1 and len(alt) > 1 and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    return pos, ref, alt


def allele_numbers(gt: Column, n_alts: Column) -> Column:
    """struct(an, ac, af) of an array of genotypes' allele arrays; -1 and null are no-calls."""
    called = F.filter(F.flatten(gt), lambda a: a.isNotNull() & (a >= 0))
    ac = F.transform(F.sequence(F.lit(1), F.greatest(n_alts, F.lit(1))), lambda k: F.size(F.filter(called, lambda a: a == k)))
    return F.struct(F.size(called).alias("an"), ac.alias("ac"), F.transform(ac, lambda c: F.try_divide(c.cast("double"), F.size(called).cast("double"))).alias("af"))


def subset_samples(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return df.withColumn("genotypes", F.filter("genotypes", lambda g: g["sample"].isin(*keep)))


def filtered_to_no_call(genotypes: Column) -> Column:
    """Genotypes with a failing FT lose their alleles."""
    return F.transform(genotypes, lambda g: g.withField("gt", F.when(F.coalesce(~g["ft"].isin("PASS", "."), F.lit(False)), F.transform(g["gt"], lambda a: F.lit(-1))).otherwise(g["gt"])))


def unused_alternates(alts: Column, gt: Column) -> Column:
    """Numbers (1-based) of alternates that no genotype calls."""
    return F.when(F.size(alts) > 0, F.array_except(F.sequence(F.lit(1), F.size(alts)), F.flatten(gt))).otherwise(F.array().cast("array<int>"))


def remap_pl(pl: Column, kept: list[int]) -> Column:
    """PL of diploid genotypes of the kept alleles (0 is the reference)."""
    index = [max(kept[i], kept[j]) * (max(kept[i], kept[j]) + 1) // 2 + min(kept[i], kept[j]) for j in range(len(kept)) for i in range(j + 1)]
    return F.array(*[F.get(pl, F.lit(k)) for k in index])


def concordant(a: DataFrame, b: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of ``a`` whose (contig, pos, ref, alts) ``b`` has, or hasn't."""
    return a.join(b.select("contig", "pos", "ref", "alts"), ["contig", "pos", "ref", "alts"], "left_semi" if keep else "left_anti")


def apply_to_reference(reference: DataFrame, variants: DataFrame) -> DataFrame:
    """Reference chunks (contig, start, seq) with the SNPs of ``variants`` put in; the first of a position counts."""
    width = reference.agg(F.max(F.length("seq")).alias("n")).first()["n"] or 1
    snps = variants.where((F.length("ref") == 1) & (F.length("alt") == 1)).groupBy("contig", "pos").agg(F.min("alt").alias("alt"))
    per = snps.withColumn("start", F.floor(F.col("pos") / width) * width).groupBy("contig", "start").agg(F.map_from_entries(F.collect_list(F.struct((F.col("pos") - F.col("start")).cast("int").alias("k"), "alt"))).alias("_m"))
    put = F.array_join(F.transform(F.split("seq", ""), lambda c, i: F.coalesce(F.try_element_at(F.col("_m"), i), c)), "")
    return reference.join(per, ["contig", "start"], "left").withColumn("seq", F.when(F.col("_m").isNull(), F.col("seq")).otherwise(put)).drop("_m")


def info_wildcard(info: Column, prefix: str) -> Column:
    """All INFO fields whose key starts with a prefix, as ``key=value,value`` joined with ``;`` in key order; NA without any."""
    keys = F.array_sort(F.filter(F.map_keys(info), lambda k: k.startswith(prefix)))
    text = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.array_join(info[k], ","))), ";")
    return F.when(F.size(keys) > 0, text).otherwise("NA")


def genotype_fields(df: DataFrame, fields: list[str], samples: list[str]) -> DataFrame:
    """One column ``sample.field`` per sample and field, NA where missing."""
    out = df
    for s in samples:
        g = F.get(F.filter("genotypes", lambda x: x["sample"] == s), F.lit(0))
        for f in fields:
            value = F.array_join(F.transform(g[f], lambda a: F.when(a < 0, ".").otherwise(a.cast("string"))), "/") if f == "gt" else F.array_join(g[f], ",") if f in ("ad", "pl") else g[f].cast("string")
            out = out.withColumn(f"{s}.{f}", F.coalesce(value, F.lit("NA")))
    return out


def genotype_labels(genotypes: Column, rules: dict[str, object], no_call: bool = False) -> Column:
    """Genotypes with FT set to the labels of the rules (functions of a genotype) they fail, PASS without any; failing ones
    lose their alleles if asked."""
    def mark(g: Column) -> Column:
        bad = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(rule(g), F.lit(False)), F.lit(n)) for n, rule in rules.items()])))
        out = g.withField("ft", F.when(F.size(bad) > 0, F.array_join(bad, ";")).otherwise("PASS"))
        return out.withField("gt", F.when(F.size(bad) > 0, F.transform(g["gt"], lambda a: F.lit(-1))).otherwise(g["gt"])) if no_call else out

    return F.transform(genotypes, mark)


def _picked(places: Column, at, column: str) -> Column:
    """The values of an array column at places; at maps a place to an index."""
    return F.transform(places, lambda k: F.get(F.col(column), at(k)))


def drop_unused_alternates(df: DataFrame, per_alt: tuple[str, ...] = (), per_allele: tuple[str, ...] = (), per_genotype: tuple[str, ...] = ()) -> DataFrame:
    """Rows (alts, gts: arrays of alleles) without the alternates nobody calls; allele numbers are renumbered, and array columns
    with a value per alternate, per allele or per diploid genotype keep those of the alleles that stay."""
    used = F.filter(F.sequence(F.lit(1), F.greatest(F.size("alts"), F.lit(1))), lambda k: F.exists(F.flatten("gts"), lambda a: a == k))
    kept = df.withColumn("_u", used)
    alleles = F.concat(F.array(F.lit(0)), F.col("_u"))
    gts = F.transform("gts", lambda g: F.transform(g, lambda a: F.when(a > 0, F.array_position(F.col("_u"), a).cast("int")).otherwise(a)))
    made = {"gts": gts, "alts": F.transform("_u", lambda k: F.get(F.col("alts"), k - 1))}
    made |= {c: _picked(F.col("_u"), lambda k: k - 1, c) for c in per_alt}
    made |= {c: _picked(alleles, lambda k: k, c) for c in per_allele}
    # Kept alleles are in order, so i <= j holds for the old numbers too.
    place = lambda i, j: (j * (j + 1) / 2).cast("int") + i
    pairs = F.flatten(F.transform(alleles, lambda j: F.transform(F.filter(alleles, lambda i: i <= j), lambda i: place(i, j))))
    made |= {c: _picked(pairs, lambda k: k, c) for c in per_genotype}
    return kept.withColumns(made).drop("_u")


def top_alternates(alleles: DataFrame, most: int, site: list[str], score: str = "score", index: str = "alt_index") -> DataFrame:
    """At most ``most`` alternates of a site by score (the first of equals), in their old order, renumbered from 1 as new_index."""
    w = Window.partitionBy(*site).orderBy(F.col(score).desc(), index)
    best = alleles.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
    return best.withColumn("new_index", F.row_number().over(Window.partitionBy(*site).orderBy(index)))


def annotate_from(variants: DataFrame, resource: DataFrame, fields: list[str], flag: str = "in_resource") -> DataFrame:
    """Variants (contig, pos, ref, alts) with a resource's fields where it has a row at that start with an alternate in common
    (the first by id), and a flag whether it has."""
    r = resource.select("contig", "pos", F.col("ref").alias("_ref"), F.col("alts").alias("_alts"), F.struct("id", *fields).alias("_f"))
    hit = variants.select("id", "contig", "pos", "ref", "alts").join(r, ["contig", "pos"]).where((F.col("ref") == F.col("_ref")) & F.arrays_overlap("alts", "_alts"))
    first = hit.groupBy("id").agg(F.min("_f").alias("_f"))
    return variants.join(first, "id", "left").select(*variants.columns, *[F.col("_f")[f].alias(f"resource_{f}") for f in fields], F.col("_f").isNotNull().alias(flag))


def cardinality_errors(values: Column, number: str, alts: Column, ploidy: int = 2) -> Column:
    """Whether a field's values break its Number: 1, A (per alternate), R (per allele), G (per genotype) or a count."""
    n = F.size(alts)
    want = {"A": n, "R": n + 1, "G": ((n + 1) * (n + 2) / 2).cast("int") if ploidy == 2 else n + 1}.get(number, F.lit(int(number)) if number.isdigit() else F.size(values))
    return F.coalesce(F.size(values) != want, F.lit(False))
