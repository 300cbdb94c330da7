"""Variants: types, labels, selection, tables, concordance, evaluation, genotypes, tranches, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import evaluation, expr, genotype, gvcf, tranche, validate, variants as V
from ..plans import encodings as E

W = "with " + E.sql_variants()
KIND = "case when length(ref) <> length(alt) then 'INDEL' when length(ref) = 1 then 'SNP' else 'MNP' end"
TS = "ref || alt in ('AG','GA','CT','TC')"
FIELDS = expr.column_resolver({"QUAL": "num", "qual": "num", "dp": "num", "af": "num", "size": "num", "note": "str", "kind_text": "str", "brand": "str"})


def variant_type_counts(spark, d):
    v = E.variants(spark, d)
    return v.groupBy("contig", V.variant_type(F.col("ref"), F.col("alts")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def transition_ratio(spark, d):
    v = E.variants(spark, d).where((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("ref") != F.col("alt")))
    ts = V.is_transition(F.col("ref"), F.col("alt"))
    out = v.groupBy("contig").agg(F.count_if(ts).alias("transitions"), F.count_if(~ts).alias("transversions"))
    return evaluation.ratio(out, "transitions", "transversions", "ratio").withColumn("ratio", F.round("ratio", 9))


def split_multiallelic(spark, d):
    v = E.variants(spark, d).withColumn("alts", F.array("alt", F.concat("alt", F.lit("T")), F.lit("<DEL>"))).withColumn("ac", F.array("size", F.col("size") + 1, F.col("size") * 2))
    return V.split_multiallelic(v, ("ac",)).select("id", "alt_index", "alt", F.col("ac").alias("ac"), V.allele_type(F.col("ref"), F.col("alt")).alias("kind"))


SPLIT_SQL = f"""{W}, s as (select id, ref, unnest([0, 1, 2]) as alt_index, unnest([alt, alt || 'T', '<DEL>']) as alt2, unnest([size, size + 1, size * 2]) as ac from variants)
 select id, alt_index, alt2 as alt, ac, case when alt2 = '<DEL>' then 'SYMBOLIC' when length(ref) <> length(alt2) then 'INDEL' when length(ref) = 1 then 'SNP' else 'MNP' end as kind from s"""


def unpivot_fields(spark, d):
    v = E.variants(spark, d).select("id", F.col("ref").alias("REF"), F.col("alt").alias("ALT"), F.col("dp").cast("string").alias("DP"), F.col("note").alias("NOTE"))
    return v.unpivot("id", ["REF", "ALT", "DP", "NOTE"], "field", "value").select("id", "field", F.coalesce("value", F.lit("NA")).alias("value"))


UNPIVOT_SQL = f"{W} select id, unnest(['REF', 'ALT', 'DP', 'NOTE']) as field, coalesce(unnest([ref, alt, dp::varchar, note]), 'NA') as value from variants"


def variant_table(spark, d):
    v = E.variants(spark, d)
    return v.select(F.col("contig").alias("CHROM"), (F.col("pos") + 1).alias("POS"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), V.variant_type(F.col("ref"), F.col("alts")).alias("TYPE"), V.is_transition(F.col("ref"), F.col("alt")).cast("int").alias("TRANSITION"), F.coalesce(F.col("dp").cast("string"), F.lit("NA")).alias("DP"), (F.length("alt") - F.length("ref")).alias("EVENTLENGTH"))


def minimal_alleles(spark, d):
    v = E.variants(spark, d).select("id", "pos", F.concat("ref", F.lit("CA")).alias("ref"), F.concat("alt", F.lit("CA")).alias("alt"))
    return v.select("id", V.minimal_alleles(F.col("pos"), F.col("ref"), F.col("alt")).alias("m")).select("id", "m.pos", "m.ref", "m.alt")


_RULES = {"LowQual": "QUAL < 950.0", "LowDepth": "dp < 3 || dp == null", "HighAF": "af > 0.7 && kind_text =~ \"^S\"", "Odd": "size % 2 == 1 && !(note == \"ECONOMY\")"}


def filter_labels(spark, d):
    rules = {n: expr.compile_expression(t, FIELDS) for n, t in _RULES.items()}
    v = E.variants(spark, d)
    return v.select("id", F.array_join(V.labels(F.array(F.lit("PASS")), rules), ";").alias("filter"))


LABEL_SQL = f"""{W}, l as (select id, list_filter([case when af > 0.7 and regexp_matches(kind_text, '^S') then 'HighAF' end, case when coalesce(dp < 3, false) or dp is null then 'LowDepth' end, case when qual < 950.0 then 'LowQual' end, case when size % 2 = 1 and not coalesce(note = 'ECONOMY', false) then 'Odd' end], lambda x: x is not null) as f from variants)
 select id, case when len(f) = 0 then 'PASS' else array_to_string(f, ';') end as filter from l"""


def filter_labels_missing_policy(spark, d):
    tests = ["dp < 3", "!(dp < 3)", "dp == null", "dp != null", "note =~ \"^E\"", "note !~ \"^E\"", "dp + 1 > 4 || note == \"SMALL\"", "dp / 0 > 1"]
    cols = [expr.compile_expression(t, FIELDS, missing_fails=p).alias(f"t{k}_{int(p)}") for k, t in enumerate(tests) for p in (False, True)]
    return E.variants(spark, d).select("id", *cols)


def _policy_sql() -> str:
    parts = []
    for p in ("false", "true"):
        n = int(p == "true")
        parts += [f"coalesce(dp < 3, {p}) as t0_{n}", f"not coalesce(dp < 3, {p}) as t1_{n}", f"dp is null as t2_{n}", f"dp is not null as t3_{n}", f"coalesce(regexp_matches(note, '^E'), false) as t4_{n}",
                  f"not coalesce(regexp_matches(note, '^E'), false) as t5_{n}", f"coalesce(dp + 1 > 4, {p}) or coalesce(note = 'SMALL', {p}) as t6_{n}", f"{p} as t7_{n}"]
    return f"{W} select id, {', '.join(parts)} from variants"


def invert_filter(spark, d):
    c = ~expr.compile_expression("QUAL < 950.0 || dp > 4", FIELDS)
    return E.variants(spark, d).where(c).select("id", "qual")


def select_expression(spark, d):
    c = expr.compile_expression("af >= 0.3 && (brand.contains(\"1\") || kind_text == \"SMALL\")", FIELDS) | expr.compile_expression("-size < -45", FIELDS)
    return E.variants(spark, d).where(c).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


def select_types(spark, d):
    v = V.select_types(E.variants(spark, d), include=("SNP", "INDEL"), exclude=("MNP",), alleles="BIALLELIC", min_indel=2, max_indel=3)
    return v.select("id", "ref", "alt")


def cluster_filter(spark, d):
    return V.clustered(E.variants(spark, d), 3, 300).select("id", "in_cluster")


CLUSTER_SQL = f"""{W}, s as (select *, case when lead(pos, 2) over (partition by contig order by pos, id) - pos <= 300 then 1 else 0 end as c from variants)
 select id, max(c) over (partition by contig order by pos, id rows between 2 preceding and current row) = 1 as in_cluster from s"""


def mask_filter(spark, d):
    from ..operators.ranges import point_join

    mask = E.targets(spark, d)
    hit = point_join(E.variants(spark, d).select("id", "contig", "pos"), mask, how="left_semi").select("id").withColumn("masked", F.lit(True))
    return E.variants(spark, d).select("id").join(hit, "id", "left").select("id", F.coalesce("masked", F.lit(False)).alias("masked"))


def allele_specific_filter(spark, d):
    v = E.variants(spark, d).select("id", "size", F.array(F.col("size") % 4, F.col("size") % 6).alias("x"), F.array("alt", "ref").alias("alts"))
    lab = V.allele_specific_labels(F.col("alts"), {"Low": lambda i: F.get(F.col("x"), i) < 2, "Even": lambda i: F.get(F.col("x"), i) % 2 == 0})
    return v.select("id", F.array_join(lab, ";").alias("filter"))


AS_SQL = f"""{W} select id, array_to_string(list_filter([case when (size % 4) % 2 = 0 and (size % 6) % 2 = 0 then 'Even' end, case when size % 4 < 2 and size % 6 < 2 then 'Low' end], lambda x: x is not null), ';') as filter from variants"""


def _two(spark, d):
    v = E.variants(spark, d)
    return v.where("id % 3 <> 0"), v.where("id % 2 = 0")


def concordance(spark, d):
    return V.concordant(*_two(spark, d)).select("id")


def discordance(spark, d):
    return V.concordant(*_two(spark, d), keep=False).select("id")


def genotype_concordance(spark, d):
    v = E.variants(spark, d)
    a = v.select("contig", "pos", (F.col("size") % 3).cast("string").alias("gt"))
    b = v.where("id % 2 = 0").select("contig", "pos", ((F.col("size") + F.col("id") % 2) % 3).cast("string").alias("gt"))
    return evaluation.contingency(a, b, ["contig", "pos"], "gt")


def validation_contingency(spark, d):
    v = E.variants(spark, d)
    a = v.select("id", F.when(F.col("qual") < 1000, "FILTERED").when(F.col("size") % 4 == 0, "REF").otherwise("ALT").alias("status"))
    b = v.where("id % 5 <> 0").select("id", F.when(F.col("dp").isNull(), "NO_CALL").when(F.col("size") % 3 == 0, "REF").otherwise("ALT").alias("status"))
    return evaluation.contingency(a, b, ["id"], "status")


def _alleles(spark, d):
    v = E.variants(spark, d)
    return v.withColumn("kind", V.allele_type(F.col("ref"), F.col("alt"))).withColumn("af_bin", evaluation.af_bin(F.col("af"))).withColumn("novelty", F.when(F.col("id") % 3 == 0, "known").otherwise("novel"))


_COUNTS = f"""count(*) as n_alleles, count(*) filter ({KIND} = 'SNP') as n_snps, count(*) filter ({KIND} = 'MNP') as n_mnps, count(*) filter (length(alt) > length(ref)) as n_insertions, count(*) filter (length(alt) < length(ref)) as n_deletions,
 count(*) filter ({KIND} = 'SNP' and {TS}) as n_transitions, count(*) filter ({KIND} = 'SNP' and not ({TS})) as n_transversions"""
AF = "case when af <= 0 then '0' when af < 0.01 then '0-.01' when af < 0.05 then '.01-.05' when af < 0.1 then '.05-.1' when af < 0.5 then '.1-.5' when af < 1 then '.5-1' else '1' end"


def eval_stratified(spark, d):
    return evaluation.stratified(_alleles(spark, d), ["contig", "kind", "af_bin", "novelty"])


EVAL_SQL = f"""{W}, s as (select *, {KIND} as kind, {AF} as af_bin, case when id % 3 = 0 then 'known' else 'novel' end as novelty from variants)
 select 'all' as stratification, 'all' as level, {_COUNTS} from s union all select 'contig', contig::varchar, {_COUNTS} from s group by contig union all select 'kind', kind, {_COUNTS} from s group by kind
 union all select 'af_bin', af_bin, {_COUNTS} from s group by af_bin union all select 'novelty', novelty, {_COUNTS} from s group by novelty"""


def af_bins(spark, d):
    return _alleles(spark, d).groupBy("af_bin").agg(F.count(F.lit(1)).alias("n"))


def indel_histogram(spark, d):
    return evaluation.indel_histogram(_alleles(spark, d))


def theta_pi(spark, d):
    v = E.variants(spark, d).select((F.col("size") % 20).alias("ac"), F.lit(40).alias("an"))
    return evaluation.pairwise_diversity(v).withColumn("theta_pi", F.round("theta_pi", 6))


def trio_violations(spark, d):
    v = E.variants(spark, d).select((F.col("size") % 3).alias("mother"), (F.col("id") % 3).cast("int").alias("father"), ((F.col("size") + F.col("id")) % 3).cast("int").alias("child"))
    return evaluation.mendelian_violations(v)


TRIO_SQL = f"""{W}, t as (select size % 3 as mother, cast(id % 3 as int) as father, cast((size + id) % 3 as int) as child from variants)
 select mother, father, child, count(*) as n, not (case when child = 0 then mother < 2 and father < 2 when child = 2 then mother > 0 and father > 0 else (mother < 2 and father > 0) or (mother > 0 and father < 2) end) as violation from t group by all"""


def genotype_gt_gq(spark, d):
    v = E.variants(spark, d).select("id", F.array(F.col("size") % 7 * 10, F.col("id").cast("int") % 11 * 9, F.col("size") % 5 * 13 - 1).alias("pl"))
    return v.select("id", genotype.best_genotype(F.col("pl")).alias("g")).select("id", "g.genotype", "g.gq")


GT_SQL = f"""{W}, p as (select id, [size % 7 * 10, cast(id as int) % 11 * 9, size % 5 * 13 - 1] as pl from variants), s as (select *, list_sort(list_filter(pl, lambda x: x >= 0)) as v from p)
 select id, cast(list_position(pl, v[1]) - 1 as int) as genotype, cast(case when len(v) >= 2 then least(v[2] - v[1], 99) else 0 end as int) as gq from s"""


def genotype_posteriors(spark, d):
    v = E.variants(spark, d).select("id", F.array(*[(F.col("size") % k * 10).cast("double") for k in (7, 5, 3)]).alias("pl"))
    g = genotype.posterior_genotype(F.col("pl"), F.array(F.lit(-0.01), F.lit(-1.7), F.lit(-2.3)))
    return v.select("id", g.alias("g")).select("id", "g.genotype", F.round(F.get("g.posteriors", F.lit(0)), 6).alias("p0"))


POST_SQL = f"""{W}, z as (select id, [-(size % 7) * 1.0 - 0.01, -(size % 5) * 1.0 - 1.7, -(size % 3) * 1.0 - 2.3]::double[] as z from variants)
 select id, cast(list_position(z, list_max(z)) - 1 as int) as genotype, round(pow(10.0, z[1]) / (pow(10.0, z[1]) + pow(10.0, z[2]) + pow(10.0, z[3])), 6) as p0 from z"""


def site_quality(spark, d):
    v = E.variants(spark, d).select("contig", F.array(*[(F.col("size") % k * 10).cast("double") for k in (7, 5, 3)]).alias("pl"))
    return v.groupBy("contig").agg(F.round(genotype.site_quality(genotype.log10_hom_ref(F.col("pl"))), 4).alias("qual"))


QUAL_SQL = f"""{W}, z as (select contig, log10(pow(10.0, -(size % 7)) / (pow(10.0, -(size % 7)) + pow(10.0, -(size % 5)) + pow(10.0, -(size % 3)))) as l from variants)
 select contig, round(greatest(0.0, -10.0 * sum(l)), 4) as qual from z group by contig"""


def allele_counts(spark, d):
    gt = F.array(F.array(F.col("size") % 3 - 1, F.col("size") % 2), F.array(F.lit(0), (F.col("id") % 3).cast("int")))
    v = E.variants(spark, d).select("id", V.allele_numbers(gt, F.lit(2)).alias("a"))
    return v.select("id", "a.an", F.get("a.ac", F.lit(0)).alias("ac1"), F.get("a.ac", F.lit(1)).alias("ac2"), F.round(F.get("a.af", F.lit(0)), 9).alias("af1"))


AC_SQL = f"""{W}, g as (select id, list_filter([size % 3 - 1, size % 2, 0, cast(id % 3 as int)], lambda x: x >= 0) as c from variants)
 select id, cast(len(c) as int) as an, cast(len(list_filter(c, lambda x: x = 1)) as int) as ac1, cast(len(list_filter(c, lambda x: x = 2)) as int) as ac2, round(len(list_filter(c, lambda x: x = 1))::double / nullif(len(c), 0), 9) as af1 from g"""


def cohort_af(spark, d):
    v = E.variants(spark, d).select("contig", F.col("size").alias("ac"))
    return v.groupBy("contig").agg(F.sum("ac").alias("ac"), (F.count(F.lit(1)) * 100).alias("an")).withColumn("af", F.round(F.try_divide(F.col("ac").cast("double"), F.col("an").cast("double")), 9))


def inbreeding(spark, d):
    v = E.variants(spark, d).select("id", (F.col("size") % 13).alias("refs"), (F.col("size") % 9).alias("hets"), (F.col("size") % 5).alias("homs"))
    return v.select("id", F.round(genotype.inbreeding_coefficient(F.col("refs"), F.col("hets"), F.col("homs")), 9).alias("f"))


INBREEDING_SQL = f"""{W}, g as (select id, size % 13 as r, size % 9 as h, size % 5 as v from variants), p as (select *, (2.0 * r + h)::double / nullif(2.0 * (r + h + v), 0) as p, r + h + v as n from g)
 select id, round(case when n >= 10 then 1.0 - h::double / nullif(2.0 * p * (1.0 - p) * n, 0) end, 9) as f from p"""


def combine_union_alleles(spark, d):
    v = E.variants(spark, d).select("contig", "pos", "ref", "alts", (F.col("id") % 4).alias("sample"), F.coalesce("dp", F.lit(0)).alias("dp"))
    v = v.withColumn("pos", F.floor(F.col("pos") / 90))
    out = gvcf.combine(v)
    return out.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), "n_samples", "dp")


COMBINE_SQL = f"""{W} select contig, pos // 90 as pos, ref, array_to_string(list_sort(list(distinct alt)), ',') as alts, count(distinct id % 4) as n_samples, cast(sum(coalesce(dp, 0)) as bigint) as dp from variants group by 1, 2, 3"""


def spanning_deletions(spark, d):
    v = E.variants(spark, d).withColumn("ref", F.rpad("ref", 40, "A"))
    return gvcf.spanning_deletion(v.withColumn("pos", F.floor(F.col("pos") / 3))).select("id", "spanned")


SPANNING_SQL = f"""{W} select id, coalesce(max(pos // 3 + 40) over (partition by contig order by pos // 3, id rows between unbounded preceding and 1 preceding) > pos // 3, false) as spanned from variants"""


def _scores(spark, d):
    return E.variants(spark, d).select("id", F.round(F.col("qual") - F.col("size") * 7, 2).alias("score"), (F.col("id") % 3 == 0).alias("truth"))


SCORES = "scores as (select id, round(qual - size * 7, 2) as score, id % 3 = 0 as truth from variants)"


def tranche_table(spark, d):
    return tranche.tranche_table(_scores(spark, d), (90.0, 99.0, 99.9, 100.0))


TRANCHE_SQL = f"""{W}, {SCORES}, b as (select score, count(*) as n, sum(truth::int) as t from scores group by 1), r as (select score, sum(n) over w as calls, sum(t) over w as tc from b window w as (order by score desc rows unbounded preceding)),
 k as (select sum(truth::int) as total from scores), p as (select g.t as target, total, score, calls, tc from r, k, (select unnest([90.0, 99.0, 99.9, 100.0])::double as t) g where tc >= ceil(g.t * total / 100.0))
 select target, cast(total as bigint) as truth_sites, max(score) as min_score, cast(arg_max(calls, score) as bigint) as calls, cast(arg_max(tc, score) as bigint) as truth_calls from p group by target, total"""


def tranche_filter(spark, d):
    c = tranche.tranche_label(F.col("score"), [("t90", 1000.0), ("t99", 800.0), ("t100", 700.0)])
    return _scores(spark, d).select("id", c.alias("filter"))


def score_normalise(spark, d):
    s = tranche.normalise(_scores(spark, d), ["score"], F.col("truth"))
    return s.select("id", F.round("score", 6).alias("score"))


def fscore_threshold(spark, d):
    p = E.variants(spark, d).select((F.col("size") / 51.0).alias("p"))
    return tranche.f_score_threshold(p).select(F.round("threshold", 9).alias("threshold"), F.round("f_score", 6).alias("f_score"))


FSCORE_SQL = f"""{W}, b as (select size / 51.0::double as p, count(*) as n from variants group by 1), c as (select p, sum(n * p) over w as e, sum(n * (1 - p)) over w as t from b window w as (order by p rows unbounded preceding)),
 f as (select p, round(2 * t / (2 * t + (max(t) over () - t) + e), 12) as f, p = max(p) over () as last from c) select round(case when last then 1.0 else p end, 9) as threshold, round(f, 6) as f_score from f order by f desc, p desc limit 1"""


def fdr_threshold(spark, d):
    p = E.variants(spark, d).select((F.col("size") / 51.0).alias("p"))
    return tranche.fdr_threshold(p, 0.2).select(F.round("threshold", 9).alias("threshold"))


FDR_SQL = f"""{W}, b as (select size / 51.0::double as p, count(*) as n from variants group by 1), c as (select p, sum(n * p) over w / sum(n) over w as m from b window w as (order by p rows unbounded preceding)), s as (select min(p) filter (m > 0.2) as stop from c)
 select round(case when stop is null then 1.0 else coalesce((select max(p) from c where p < stop), 0.0) end, 9) as threshold from s"""


def weighted_median(spark, d):
    v = E.variants(spark, d).select("contig", "size", F.coalesce("dp", F.lit(0)).alias("w"))
    return tranche.weighted_median(v.where("w > 0"), "size", "w", ["contig"])


WM_SQL = f"""{W}, b as (select contig, size, sum(dp) as w from variants where dp > 0 group by 1, 2), r as (select *, sum(w) over (partition by contig order by size) as up, sum(w) over (partition by contig) as total from b) select contig, min(size) as weighted_median from r where 2 * up >= total group by contig"""


def worst_variants(spark, d):
    return tranche.worst(_scores(spark, d), "score", 600.0, 25, "id").select("id", "score")


WORST_SQL = f"{W}, {SCORES}, r as (select *, row_number() over (order by score, id) as rn from scores) select id, score from r where score < 600.0 or rn <= 25"


def resource_flags(spark, d):
    v = E.variants(spark, d)
    res = {"known": v.where("id % 2 = 0"), "training": v.where("id % 3 = 0"), "truth": v.where("id % 5 = 0")}
    return tranche.resource_flags(v.select("id", "contig", "pos"), {k: x.select("contig", "pos") for k, x in res.items()}, ["contig", "pos"]).select("id", *res)


def validate_issues(spark, d):
    v = E.variants(spark, d).withColumn("alts", F.when(F.col("id") % 50 == 0, F.array("alt", "alt")).otherwise(F.array("alt"))).withColumn("gts", F.array(F.array(F.lit(0), (F.col("size") % 2))))
    known = v.where("id % 100 <> 7").select("id")
    contigs = v.where("contig <> 24").select("contig").distinct()
    ref = v.select("contig", "pos", F.when(F.col("id") % 40 == 0, "N").otherwise(F.substring("ref", 1, 1)).alias("base"))
    return validate.issues(v.withColumn("ord", F.col("id") * 17 % 1000003), ref, known, contigs).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


VALIDATE_SQL = f"""{W}, o as (select *, lag(pos) over (partition by contig order by id * 17 % 1000003) as p from variants)
 select 'ref_mismatch' as rule, count(*) as n from variants where id % 40 = 0 having count(*) > 0 union all select 'unknown_id', count(*) from variants where id % 100 = 7 having count(*) > 0 union all select 'unknown_contig', count(*) from variants where contig = 24 having count(*) > 0
 union all select 'duplicate_allele', count(*) from variants where id % 50 = 0 having count(*) > 0 union all select 'unused_alternate', count(*) from variants where id % 50 = 0 or size % 2 = 0 having count(*) > 0 union all select 'unsorted', count(*) from o where p > pos having count(*) > 0"""


def dictionary_compare(spark, d):
    n = E.table(spark, d, "nation")
    a = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 100).alias("length"), F.md5(F.col("n_name").cast("binary")).alias("md5"))
    b = n.where("n_nationkey > 3").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 100 + (F.col("n_nationkey") == 7).cast("int")).alias("length"), F.md5(F.when(F.col("n_nationkey") == 9, F.lit("x")).otherwise(F.col("n_name")).cast("binary")).alias("md5"))
    return validate.dictionary_comparison(a, b).select("name", "length_a", "length_b", "status")


DICT_SQL = """with a as (select n_name as name, n_nationkey * 100 as length, md5(n_name) as md5 from nation where n_nationkey < 20), b as (select n_name as name, n_nationkey * 100 + case when n_nationkey = 7 then 1 else 0 end as length, md5(case when n_nationkey = 9 then 'x' else n_name end) as md5 from nation where n_nationkey > 3)
 select coalesce(a.name, b.name) as name, a.length as length_a, b.length as length_b, case when a.length is null then 'only_b' when b.length is null then 'only_a' when a.length <> b.length then 'length_differs' when a.md5 <> b.md5 then 'md5_differs' else 'same' end as status from a full join b on a.name = b.name"""


def sequence_functions(spark, d):
    v = E.variants(spark, d).select("id", F.concat("ref", "alt", F.lit("ACGGTTA")).alias("s"))
    return v.select("id", S.reverse_complement(F.col("s")).alias("rc"), F.round(S.gc_content(F.col("s")), 9).alias("gc"), S.iupac(F.substring("s", 1, 1), F.substring("s", 2, 1)).alias("iupac"), F.md5(F.col("s").cast("binary")).alias("md5"), F.size(S.kmers(F.col("s"), 3)).alias("kmers"))


SEQ_SQL = f"""{W}, q as (select id, ref || alt || 'ACGGTTA' as s from variants), p as (select *, least(s[1], s[2]) || greatest(s[1], s[2]) as pr from q)
 select id, reverse(translate(s, 'ACGTacgtN', 'TGCAtgcaN')) as rc, round(length(regexp_replace(s, '[^GC]', '', 'g'))::double / nullif(length(regexp_replace(s, '[^ACGT]', '', 'g')), 0), 9) as gc,
 case when s[1] = s[2] then s[1] else case pr when 'AG' then 'R' when 'CT' then 'Y' when 'CG' then 'S' when 'AT' then 'W' when 'GT' then 'K' when 'AC' then 'M' else 'N' end end as iupac, md5(s) as md5, cast(greatest(length(s) - 2, 0) as int) as kmers from p"""


QUERIES = {
    "variant_type_counts": (variant_type_counts, f"{W} select contig, {KIND} as kind, count(*) as n from variants group by all"),
    "transition_ratio": (transition_ratio, f"{W}, c as (select contig, count(*) filter ({TS}) as transitions, count(*) filter (not ({TS})) as transversions from variants where length(ref) = 1 and length(alt) = 1 and ref <> alt group by 1) select *, round(transitions::double / nullif(transversions, 0), 9) as ratio from c"),
    "split_multiallelic": (split_multiallelic, SPLIT_SQL),
    "unpivot_fields": (unpivot_fields, UNPIVOT_SQL),
    "variant_table": (variant_table, f"""{W} select contig as "CHROM", pos + 1 as "POS", ref as "REF", alt as "ALT", {KIND} as "TYPE", cast({TS} as int) as "TRANSITION", coalesce(dp::varchar, 'NA') as "DP", cast(length(alt) - length(ref) as int) as "EVENTLENGTH" from variants"""),
    "minimal_alleles": (minimal_alleles, None),
    "filter_labels": (filter_labels, LABEL_SQL),
    "filter_labels_missing_policy": (filter_labels_missing_policy, _policy_sql()),
    "invert_filter": (invert_filter, f"{W} select id, qual from variants where not (qual < 950.0 or coalesce(dp > 4, false))"),
    "select_expression": (select_expression, f"{W} select contig, count(*) as n from variants where (af >= 0.3 and (contains(brand, '1') or kind_text = 'SMALL')) or -size < -45 group by contig"),
    "select_types": (select_types, f"{W} select id, ref, alt from variants where (length(ref) = 1 and length(alt) = 1) or (length(ref) <> length(alt) and abs(length(ref) - length(alt)) between 2 and 3)"),
    "cluster_filter": (cluster_filter, CLUSTER_SQL),
    "mask_filter": (mask_filter, f"""{W}, {E.SQL_TARGETS} select id, exists (select 1 from targets t where t.contig = v.contig and v.pos >= t.start and v.pos < t."end") as masked from variants v"""),
    "allele_specific_filter": (allele_specific_filter, AS_SQL),
    "concordance": (concordance, f"{W} select id from variants a where id % 3 <> 0 and exists (select 1 from variants b where b.id % 2 = 0 and a.contig = b.contig and a.pos = b.pos and a.ref = b.ref and a.alt = b.alt)"),
    "discordance": (discordance, f"{W} select id from variants a where id % 3 <> 0 and not exists (select 1 from variants b where b.id % 2 = 0 and a.contig = b.contig and a.pos = b.pos and a.ref = b.ref and a.alt = b.alt)"),
    "genotype_concordance": (genotype_concordance, f"{W} select (a.size % 3)::varchar as eval_status, coalesce(((b.size + b.id % 2) % 3)::varchar, 'missing') as comp_status, count(*) as n from variants a left join (select * from variants where id % 2 = 0) b on a.contig = b.contig and a.pos = b.pos group by all"),
    "validation_contingency": (validation_contingency, f"{W} select case when a.qual < 1000 then 'FILTERED' when a.size % 4 = 0 then 'REF' else 'ALT' end as eval_status, case when b.id is null then 'missing' when b.dp is null then 'NO_CALL' when b.size % 3 = 0 then 'REF' else 'ALT' end as comp_status, count(*) as n from variants a left join (select * from variants where id % 5 <> 0) b on a.id = b.id group by all"),
    "eval_stratified": (eval_stratified, EVAL_SQL),
    "af_bins": (af_bins, f"{W} select {AF} as af_bin, count(*) as n from variants group by 1"),
    "indel_histogram": (indel_histogram, f"{W} select cast(length(alt) - length(ref) as int) as length, count(*) as n from variants where length(ref) <> length(alt) and abs(length(alt) - length(ref)) <= 10 group by 1"),
    "theta_pi": (theta_pi, f"{W} select round(sum(2.0 * (size % 20) * (40 - size % 20) / (40 * 39.0))::double, 6) as theta_pi, count(*) as n_sites from variants"),
    "trio_violations": (trio_violations, TRIO_SQL),
    "genotype_gt_gq": (genotype_gt_gq, GT_SQL),
    "genotype_posteriors": (genotype_posteriors, POST_SQL),
    "site_quality": (site_quality, QUAL_SQL),
    "allele_counts": (allele_counts, AC_SQL),
    "cohort_af": (cohort_af, f"{W} select contig, cast(sum(size) as bigint) as ac, count(*) * 100 as an, round(sum(size)::double / (count(*) * 100), 9) as af from variants group by contig"),
    "inbreeding": (inbreeding, INBREEDING_SQL),
    "combine_union_alleles": (combine_union_alleles, COMBINE_SQL),
    "spanning_deletions": (spanning_deletions, SPANNING_SQL),
    "tranche_table": (tranche_table, TRANCHE_SQL),
    "tranche_filter": (tranche_filter, f"{W}, {SCORES} select id, case when score >= 1000.0 then 't90' when score >= 800.0 then 't99' when score >= 700.0 then 't100' else 't100+' end as filter from scores"),
    "score_normalise": (score_normalise, f"{W}, {SCORES} select id, round((score - (select avg(score) from scores where truth)) / (select stddev_pop(score) from scores where truth), 6) as score from scores"),
    "fscore_threshold": (fscore_threshold, FSCORE_SQL),
    "fdr_threshold": (fdr_threshold, FDR_SQL),
    "weighted_median": (weighted_median, WM_SQL),
    "worst_variants": (worst_variants, WORST_SQL),
    "resource_flags": (resource_flags, f"{W} select a.id, exists (select 1 from variants b where b.contig = a.contig and b.pos = a.pos and b.id % 2 = 0) as known, exists (select 1 from variants b where b.contig = a.contig and b.pos = a.pos and b.id % 3 = 0) as training, exists (select 1 from variants b where b.contig = a.contig and b.pos = a.pos and b.id % 5 = 0) as truth from variants a"),
    "validate_issues": (validate_issues, VALIDATE_SQL),
    "dictionary_compare": (dictionary_compare, DICT_SQL),
    "sequence_functions": (sequence_functions, SEQ_SQL),
}
