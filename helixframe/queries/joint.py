"""Filter-language methods, joint genotyping, comparison sets, fragments and other rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, sequence as S
from ..operators import dedup, evaluation, expr, joint, methods as M, pileup, ranges, tranche, variants as V
from ..plans import encodings as E

W = "with " + E.sql_variants()
R = "with " + E.sql_reads()
KIND = "case when length(ref) <> length(alt) then 'INDEL' when length(ref) = 1 then 'SNP' else 'MNP' end"
FIELDS = expr.column_resolver({"size": "num", "qual": "num"})


def _genotyped(spark, d):
    """Variants with two samples' genotypes, FILTER labels and an INFO map."""
    size, i = F.col("size"), F.col("id").cast("int")
    one = F.struct(F.lit("S1").alias("sample"), F.array(size % 2, F.when(size % 7 == 0, -1).otherwise(size % 3 % 2)).alias("gt"), F.when(size % 11 > 0, size % 11).alias("dp"), (size * 3 % 50).alias("gq"), F.array(size % 9, size % 4).alias("ad"), F.array(F.lit(0), size % 30, size % 50).alias("pl"))
    two = F.struct(F.lit("S2").alias("sample"), F.array(i % 3, i % 3).alias("gt"), (size % 5).alias("dp"), (i % 40).alias("gq"), F.array(i % 6, i % 3).alias("ad"), F.array(F.lit(0), i % 30, i % 50).alias("pl"))
    v = E.variants(spark, d).withColumn("genotypes", F.array(one, two)).withColumn("filter", F.when(size % 4 == 0, F.array(F.lit("LowQual"), F.lit("PASS"))).otherwise(F.array(F.lit("PASS"))))
    return v.withColumn("info", F.when(size % 3 == 0, F.create_map(F.lit("DB"), F.lit("1"))).otherwise(F.create_map(F.lit("X"), F.lit("2"))))


G = f"""{W}, g as (select *, cast(size % 2 as int) as a, case when size % 7 = 0 then -1 else size % 3 % 2 end as b, nullif(size % 11, 0) as dp1, size * 3 % 50 as gq1, id % 3 as c, {KIND} as kind, length(ref) = 1 and length(alt) = 1 as single, ref || alt in ('AG','GA','CT','TC') as ts from variants)"""
_SITE = {
    "isSNP()": "kind = 'SNP'", "isIndel()": "kind = 'INDEL'", "isMNP()": "kind = 'MNP'", "isSymbolic()": "false", "isMixed()": "false", "isNoVariation()": "false", "isVariant()": "true", "isTransition()": "single and ts", "isTransversion()": "single and not ts",
    "isBiallelic()": "true", "isMultiallelic()": "false", "isFiltered()": "size % 4 = 0", "isPass()": "size % 4 <> 0", "isNotFiltered()": "size % 4 <> 0", "filtersIsEmpty()": "size % 4 <> 0", "isPolymorphicInSamples()": "a > 0 or b > 0 or c > 0",
    "isMonomorphicInSamples()": "not (a > 0 or b > 0 or c > 0)", "hasGenotypes()": "true", "genotypesIsEmpty()": "false", "hasAttribute('DB')": "size % 3 = 0", "hasAlternateAllele(0)": "true", "hasAlternateAllele(1)": "false",
}
_S1 = 'getGenotype("S1").'
_GENOTYPE = {
    _S1 + "isHet()": "b >= 0 and a <> b", _S1 + "isHom()": "b >= 0 and a = b", _S1 + "isHomRef()": "a = 0 and b = 0", _S1 + "isHomVar()": "a > 0 and a = b", _S1 + "isNoCall()": "b < 0", _S1 + "isCalled()": "b >= 0", _S1 + "isAvailable()": "true",
    _S1 + "getGQ() > 20": "gq1 > 20", _S1 + "getDP() < 5": "coalesce(dp1 < 5, false)", _S1 + "getAD()[1] == 2": "size % 4 = 2", _S1 + "getPL(2) >= 30": "size % 50 >= 30", _S1 + "getPloidy() == 2": "true", _S1 + "hasDP()": "dp1 is not null",
    _S1 + "getMIN_DP() > 0": "false", 'getGenotype("S9").isHet()': "false", 'getGenotype("S2").isHomVar()': "c > 0",
}
_ALLELE = {
    "getReference().isReference()": "true", "getReference().length() == 3": "length(ref) = 3", "getAlternateAllele(0).length() > 1": "length(alt) > 1", "getAlternateAllele(0).isSymbolic()": "false", "getAlternateAllele(0).isNonReference()": "true",
    "getAlternateAllele(1).isCalled()": "false", "getAlternateAllele(0).isNonRefAllele()": "false", "getAlternateAllele(0).isBreakpoint() || vc.getAlternateAllele(0).isSingleBreakend() || vc.getAlternateAllele(0).isNoCall()": "false",
}


def _tested(spark, d, tests):
    v, known = _genotyped(spark, d), M.site_methods()
    return v.select("id", *[expr.compile_expression(f"vc.{t}", FIELDS, known).alias(f"t{k}") for k, t in enumerate(tests)])


def _tested_sql(tests):
    return f"{G} select id, {', '.join(f'{c} as t{k}' for k, c in enumerate(tests.values()))} from g"


def site_methods(spark, d):
    return _tested(spark, d, _SITE)


def genotype_methods(spark, d):
    return _tested(spark, d, _GENOTYPE)


def allele_methods(spark, d):
    return _tested(spark, d, _ALLELE)


def select_genotypes(spark, d):
    return M.select_genotypes(_genotyped(spark, d), "GQ > 20 && isHet == 1 || !isNoCall() && AD[1] > 2").select("id")


def nonvariant_filtered(spark, d):
    v = _genotyped(spark, d).withColumn("alts", F.when(F.col("size") % 10 == 0, F.array(F.lit("."))).otherwise(F.col("alts")))
    return v.select("id", M.is_non_variant(F.col("alts"), F.col("genotypes")).alias("non_variant"), M.is_non_variant(F.col("alts")).alias("site_only"), M.is_filtered(F.col("filter")).alias("filtered"))


def filtered_to_no_call(spark, d):
    g = F.array(F.struct(F.array(F.col("size") % 2, F.lit(1)).alias("gt"), F.when(F.col("size") % 3 == 0, "lowGQ").otherwise("PASS").alias("ft")), F.struct(F.array(F.lit(0), F.lit(0)).alias("gt"), F.lit(None).cast("string").alias("ft")))
    v = E.variants(spark, d).select("id", V.filtered_to_no_call(g).alias("g"))
    return v.select("id", F.array_join(F.transform(F.flatten(F.transform("g", lambda x: x["gt"])), lambda a: a.cast("string")), ",").alias("gts"))


def subset_samples(spark, d):
    v = V.subset_samples(_genotyped(spark, d), ("S2", "S7"))
    return v.select("id", F.size("genotypes").alias("n"), F.get("genotypes", F.lit(0))["sample"].alias("sample"), F.get("genotypes", F.lit(0))["gq"].alias("gq"))


def remap_likelihoods(spark, d):
    size = F.col("size")
    pl = F.array(*[(size * k) % 60 for k in range(1, 7)])
    v = E.variants(spark, d).select("id", V.remap_pl(pl, [0, 2]).alias("pl"), joint.remap_values(F.array(size, size + 1, size + 2), F.array(F.lit(2), F.lit(None).cast("int"), F.lit(1)), "R").alias("r"), joint.remap_values(F.array(size, size + 1), F.array(F.lit(2), F.lit(1)), "A").alias("a"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")
    return v.select("id", *[text(c).alias(c) for c in ("pl", "r", "a")])


REMAP_SQL = f"""{W} select id, concat_ws(',', size * 1 % 60, size * 4 % 60, size * 6 % 60) as pl, concat_ws(',', size, size + 2, '.', size + 1) as r, concat_ws(',', size + 1, size) as a from variants"""


def genotype_priors(spark, d):
    v = E.variants(spark, d)
    p = joint.genotype_priors(F.array(F.lit(0.0), -F.col("size") / 10.0, -F.col("size") / 7.0), F.array(F.lit(0.0), -F.col("size") / 5.0, -F.col("size") / 4.0))
    return v.select("id", *[F.round(F.get(p, F.lit(k)), 9).alias(f"g{k}") for k in range(6)])


PRIORS_SQL = f"{W} select id, 0.0::double as g0, round(-size / 10.0, 9) as g1, round(-size / 5.0, 9) as g2, round(-size / 7.0, 9) as g3, round(-size / 10.0 - size / 7.0, 9) as g4, round(-size / 4.0, 9) as g5 from variants"


def joint_pl(spark, d):
    size, i = F.col("size"), F.col("id").cast("int")
    value = lambda r, a: -((size * (r + 1) * 7 + i * (a + 1) * 3) % 37) / 10.0
    reads = F.array(*[F.array(*[value(r, a) for a in range(3)]) for r in range(4)], F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0)))
    return E.variants(spark, d).select("id", F.array_join(F.transform(joint.joint_pl(reads, 99), lambda x: x.cast("string")), ",").alias("pl"))


_PAIR = "sum(greatest(a{0}, a{1}) + log10(1 + pow(10, -abs(a{0} - a{1}))) - log10(2))"
JOINT_SQL = f"""{W}, r as (select id, -((size * (r + 1) * 7 + id * 3) % 37) / 10.0 as a0, -((size * (r + 1) * 7 + id * 6) % 37) / 10.0 as a1, -((size * (r + 1) * 7 + id * 9) % 37) / 10.0 as a2 from variants, (select unnest(range(4)) as r)),
 s as (select id, [sum(a0)::double, {_PAIR.format(0, 1)}, sum(a1)::double, {_PAIR.format(0, 2)}, {_PAIR.format(1, 2)}, sum(a2)::double] as s from r group by id)
 select id, array_to_string(list_transform(s, lambda x: least(99, cast(floor(-10 * (x - list_max(s)) + 0.5) as int))), ',') as pl from s"""


def joint_reference_confidence(spark, d):
    v = E.variants(spark, d).select("contig", F.array(F.col("size") % 30, F.when(F.col("size") % 9 == 0, -1).otherwise(F.col("size") % 7), F.col("size") % 50).cast("array<int>").alias("pl"))
    out = joint.reference_confidence(v, F.array(F.lit(-0.001), F.lit(-3.0), F.lit(-3.3)), ["contig"])
    return out.select("contig", F.round("log10_p_reference", 5).alias("log10_p_reference"), F.round("qual", 4).alias("qual"), "n_samples")


JOINT_REF_SQL = f"""{W}, t as (select contig, -0.1 * (size % 30) - 0.001 as t0, case when size % 9 > 0 then -0.1 * (size % 7) - 3.0 end as t1, -0.1 * (size % 50) - 3.3 as t2 from variants),
 p as (select contig, least(0, t0 - log10(pow(10, t0) + coalesce(pow(10, t1), 0) + pow(10, t2))) as p from t)
 select contig, round(sum(p), 5) as log10_p_reference, round(greatest(-10 * sum(p), 0), 4) as qual, count(*) as n_samples from p group by contig"""


def call_confidence(spark, d):
    pl = F.array(F.col("size") * 3, F.col("size") % 20, F.col("size") % 45 - F.when(F.col("size") == 13, 99).otherwise(0)).cast("array<int>")
    v = E.variants(spark, d).select("id", joint.call_confidence(pl, F.lit(10.0), F.lit(0.01)).alias("c"))
    return v.select("id", F.round("c.qual", 6).alias("qual"), F.round("c.log10_p_absent", 7).alias("log10_p_absent"))


CONF_SQL = f"""with recursive {E.sql_variants()}, start as (select distinct size, -0.1 * (size * 3) as l0, -0.1 * (size % 20) as l1, -0.1 * (size % 45) as l2 from variants where size <> 13),
 walk as (select size, l0, l1, l2, 0 as k, log10(0.5) as r, log10(0.5) as a, 0.0::double as rc, 0.0::double as ac, true as going from start
  union all
  select size, l0, l1, l2, k + 1, log10((10 + n.rn) / (10.01 + n.rn + n.an)), log10((0.01 + n.an) / (10.01 + n.rn + n.an)), n.rn, n.an, greatest(abs(n.rn - rc), abs(n.an - ac)) > 0.1
  from (select *, pow(10, l0 + 2 * r) as x, pow(10, log10(2) + l1 + r + a) as y, pow(10, l2 + 2 * a) as z from walk where going and k < 100) w, lateral (select (2 * x + y) / (x + y + z) as rn, (y + 2 * z) / (x + y + z) as an) n),
 last as (select size, arg_max(struct_pack(l0 := l0, l1 := l1, l2 := l2, r := r, a := a), k) as s from walk group by size),
 fin as (select size, s.l0 + 2 * s.r - log10(pow(10, s.l0 + 2 * s.r) + pow(10, log10(2) + s.l1 + s.r + s.a) + pow(10, s.l2 + 2 * s.a)) as p from last)
 select id, round(case when v.size = 13 then 0 else greatest(0, -10 * p) end, 6) as qual, round(case when v.size <> 13 then least(p, 0) end, 7) as log10_p_absent from variants v left join fin on v.size = fin.size"""


def carried_blocks(spark, d):
    v = E.variants(spark, d).select("contig", "pos", (F.col("id") % 3).cast("string").alias("sample"), F.col("size").alias("gq"), F.coalesce("dp", F.lit(0)).alias("dp"))
    s = E.table(spark, d, "supplier").select((F.col("s_suppkey") % 25).cast("int").alias("contig"), (F.col("s_suppkey") * 10).alias("start"), (F.col("s_suppkey") * 10 + 900).alias("end"), (F.col("s_suppkey") % 3).cast("string").alias("sample"), (F.col("s_suppkey") % 60).cast("int").alias("gq"), F.lit(9).alias("dp"))
    return joint.carry_blocks(v.groupBy("contig", "pos", "sample").agg(F.max("gq").alias("gq"), F.max("dp").alias("dp")), s, ["gq", "dp"])


CARRY_SQL = f"""{W}, v as (select contig, pos, (id % 3)::varchar as sample, max(size) as gq, max(coalesce(dp, 0)) as dp from variants group by all), s as (select cast(s_suppkey % 25 as int) as contig, s_suppkey * 10 as start, s_suppkey * 10 + 900 as "end", (s_suppkey % 3)::varchar as sample, cast(s_suppkey % 60 as int) as gq from supplier),
 c as (select x.contig, x.pos, s.sample, arg_max(s.gq, s.start) as gq from (select distinct contig, pos from v) x join s on x.contig = s.contig and x.pos >= s.start and x.pos < s."end" group by all)
 select contig, pos, sample, gq, dp, false as from_block from v union all select contig, pos, sample, gq, 9, true from c where not exists (select 1 from v where v.contig = c.contig and v.pos = c.pos and v.sample = c.sample)"""


def recal_scores(spark, d):
    v = E.variants(spark, d)
    s = v.where("id % 3 <> 0").select("contig", "pos", "ref", "alt", (F.col("qual") / 100.0).alias("score"), F.concat(F.lit("A"), F.col("size") % 4).alias("culprit"), (F.col("size") % 2 == 0).alias("positive"), (F.col("size") % 5 == 0).alias("negative"))
    rows = v.withColumn("alts", F.when(F.col("id") % 2 == 0, F.array("alt", F.lit("<X>"))).otherwise(F.array(F.lit("<X>"))))
    by = lambda allele: joint.apply_scores(rows.select("id", "contig", "pos", "ref", "alts"), s, allele).select("id", F.lit(allele).alias("by_allele"), F.round("score", 6).alias("score"), "culprit", "positive")
    return by(True).unionByName(by(False))


RECAL_SQL = f"""{W}, s as (select *, qual / 100.0 as score, 'A' || (size % 4) as culprit, size % 2 = 0 as positive from variants where id % 3 <> 0), o as (select *, row_number() over (partition by contig, pos order by score desc, ref desc, alt desc) as rn from s)
 select v.id, true as by_allele, round(s.score, 6) as score, s.culprit, s.positive from variants v left join s on v.id % 2 = 0 and s.contig = v.contig and s.pos = v.pos and s.ref = v.ref and s.alt = v.alt
 union all select v.id, false, round(o.score, 6), o.culprit, o.positive from variants v left join o on o.contig = v.contig and o.pos = v.pos and o.rn = 1"""


def read_uncertainty(spark, d):
    p = E.reads(spark, d).select(F.col("name").alias("read_id"), (-F.col("score") / 10.0).alias("log10_likelihood"))
    return joint.best_and_second(p).select("read_id", "best", "second", F.round("uncertainty", 6).alias("uncertainty"))


UNCERTAIN_SQL = f"""{R}, o as (select name as read_id, -score / 10.0 as v, row_number() over (partition by name order by score) as k from reads)
 select read_id, max(v) filter (k = 1) as best, max(v) filter (k = 2) as second, round(max(v) filter (k = 1) - max(v) filter (k = 2), 6) as uncertainty from o group by 1"""


def comparison_set(spark, d):
    v = E.variants(spark, d).select("id", "contig", "pos", "ref", "alts", "size", "alt")
    comp = v.where("id % 2 = 0").withColumn("alts", F.when(F.col("size") % 4 == 0, F.array(F.lit("<X>"))).otherwise(F.col("alts"))).withColumn("contig", F.col("contig")).unionByName(v.where("id % 6 = 0"))
    out = evaluation.compare(evaluation.compare(v, comp, True, "strict"), comp, False, "loose")
    return evaluation.novelty(out, comp.where("id % 4 = 0")).select("id", "strict", "loose", "novelty")


COMPARE_SQL = f"""{W}, c as (select contig, pos, ref, case when size % 4 = 0 then '<X>' else alt end as alt, id from variants where id % 2 = 0 union all select contig, pos, ref, alt, id from variants where id % 6 = 0)
 select id, exists (select 1 from c where c.contig = v.contig and c.pos = v.pos and c.ref = v.ref and c.alt = v.alt) as strict, exists (select 1 from c where c.contig = v.contig and c.pos = v.pos) as loose, case when exists (select 1 from c where c.contig = v.contig and c.pos = v.pos and c.id % 4 = 0) then 'known' else 'novel' end as novelty from variants v"""


def frequency_summary(spark, d):
    g = E.variants(spark, d).select("contig", (F.col("size") % 5 - 1).alias("dosage"))
    return evaluation.frequency_summary(g, ["contig"]).select("contig", "n_called", F.round("mean_af", 9).alias("mean_af"))


def theta_watterson_sites(spark, d):
    return evaluation.watterson(E.variants(spark, d).where("size % 2 = 1"), 41).select("n_sites", F.round("theta_w", 6).alias("theta_w"))


def stratified_novelty(spark, d):
    v = E.variants(spark, d)
    a = evaluation.novelty(v, v.where("id % 3 = 0")).withColumn("kind", V.allele_type(F.col("ref"), F.col("alt"))).withColumn("filtered", F.when(F.col("size") % 4 == 0, "filtered").otherwise("called")).withColumn("family", F.concat(F.lit("F"), F.col("size") % 3))
    return evaluation.stratified(a, ["novelty", "filtered", "family"]).select("stratification", "level", "n_alleles", "n_snps", "n_deletions")


_COUNTS = f"count(*) as n_alleles, count(*) filter ({KIND} = 'SNP') as n_snps, count(*) filter (length(alt) < length(ref)) as n_deletions"
NOVEL_SQL = f"""{W}, a as (select *, case when exists (select 1 from variants k where k.id % 3 = 0 and k.contig = v.contig and k.pos = v.pos) then 'known' else 'novel' end as novelty, case when size % 4 = 0 then 'filtered' else 'called' end as filtered, 'F' || (size % 3) as family from variants v)
 select 'novelty' as stratification, novelty as level, {_COUNTS} from a group by 2 union all select 'filtered', filtered, {_COUNTS} from a group by 2 union all select 'family', family, {_COUNTS} from a group by 2 union all select 'all', 'all', {_COUNTS} from a"""


def distinct_fragments(spark, d):
    r = E.reads(spark, d).select("contig", "pos", "mapq", "name").withColumn("pos", F.floor(F.col("pos") / 500))
    return pileup.distinct_fragments(r, ["contig", "pos"], low=10, high=50, qual="mapq")


def mate_five_prime(spark, d):
    r = E.reads(spark, d).withColumn("mate_cigar", F.when(F.col("len") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("cigar")))
    p = dedup.mate_five_prime(F.when(F.col("tile") == 0, -1).otherwise(F.col("mate_contig")), F.col("mate_pos"), F.col("score") % 2 == 0, S.cigar_ops(F.col("mate_cigar")))
    return r.select("rid", p.cast("long").alias("mate_pos5"))


MATE_SQL = f"""{R}, s as (select *, case when len % 5 = 0 then 0 when rid is null then 0 else list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MD]', 1), lambda x: x::int)) end as span from reads)
 select rid, cast(case when tile = 0 then -1 when score % 2 = 0 and span > 0 then mate_pos + span - 1 else mate_pos end as bigint) as mate_pos5 from s"""


def sort_duplicates(spark, d):
    from pyspark.sql import Window

    r = E.reads(spark, d).select("rid", "library", "contig", "pos", (F.col("flag").bitwiseAND(16) != 0).alias("reverse"), "mate_contig", "mate_pos", F.col("library").alias("mate_reverse"))
    w = Window.partitionBy("library", "contig").orderBy(*dedup.duplicate_order("library", "contig", "pos", "reverse", "mate_contig", "mate_pos", "mate_reverse", "rid"))
    return r.select("rid", F.row_number().over(w).alias("place"))


def interval_exact_join(spark, d):
    t = E.targets(spark, d)
    counts = t.withColumn("count", F.col("start") % 97)
    return ranges.exact_join(t.where("contig < 20").withColumn("gc", F.col("end") % 11), counts, "count")


def separate_contigs(spark, d):
    return ranges.separate_contigs(E.targets(spark, d), 40)


SEPARATE_SQL = f"""with {E.SQL_TARGETS}, n as (select contig, sum("end" - start) as n from targets group by 1), k as (select *, greatest(1, cast(floor(n * 40 / sum(n) over ()) as bigint)) as k from n), f as (select *, sum(k) over (order by contig) - k as first from k),
 a as (select *, sum("end" - start) over (partition by contig order by start, "end" rows unbounded preceding) - ("end" - start) / 2.0 as at from targets)
 select a.contig, a.start, a."end", cast(f.first + least(floor(a.at * f.k / f.n), f.k - 1) as int) as shard from a join f on a.contig = f.contig"""


def reads_with_tail(spark, d):
    r = E.reads(spark, d).select("rid", F.when(F.col("tile") == 0, -1).otherwise(F.col("contig")).alias("contig"), F.col("pos").alias("start"), "end")
    kept = pileup.in_intervals_with_tail(r, E.targets(spark, d).where("start % 3 = 0"))
    return kept.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("positions"))


TAIL_SQL = f"""{R}, {E.SQL_TARGETS}, r as (select rid, case when tile = 0 then -1 else contig end as contig, pos as start, "end" from reads)
 select contig, count(*) as n, cast(sum(start) as bigint) as positions from r where contig < 0 or exists (select 1 from targets t where t.start % 3 = 0 and t.contig = r.contig and t.start < r."end" and r.start < t."end") group by 1"""


def number_texts(spark, d):
    x = F.when(F.col("size") == 7, F.lit(float("nan"))).when(F.col("size") == 9, F.lit(None)).otherwise(F.col("size") / 8.0)
    return E.variants(spark, d).select("id", *[numeric.fixed_text(x, k).alias(f"t{k}") for k in (2, 4)], numeric.short_text(F.col("size") / 8.0).alias("short"), numeric.round_half_up(F.col("size") / 4.0 - 6).alias("half_up"), numeric.genotype_index(F.col("size") % 4, F.col("size") % 3).alias("genotype"))


TEXT_SQL = f"""{W}, x as (select *, case when size in (7, 9) then null else size / 8.0 end as x from variants)
 select id, coalesce(printf('%.2f', round(x, 2)), 'NaN') as t2, coalesce(printf('%.4f', round(x, 4)), 'NaN') as t4, case when size % 8 = 0 then (size // 8)::varchar else (size / 8.0)::varchar end as short, cast(floor(size / 4.0 - 6 + 0.5) as bigint) as half_up,
 cast(greatest(size % 4, size % 3) * (greatest(size % 4, size % 3) + 1) // 2 + least(size % 4, size % 3) as int) as genotype from x"""


def log_sums(spark, d):
    size = F.col("size")
    v = E.variants(spark, d)
    return v.select("id", F.round(numeric.log10_sum(F.array(-size / 10.0, -size / 3.0, F.lit(-2.0))), 9).alias("log10_sum"), F.round(numeric.ln_factorial(size % 20), 6).alias("ln_factorial"))


LOG_SQL = f"{W} select id, round(log10(pow(10, -size / 10.0) + pow(10, -size / 3.0) + pow(10, -2.0)), 9) as log10_sum, round(lgamma(size % 20 + 1), 6) as ln_factorial from variants"


def covariates(spark, d):
    r = E.reads(spark, d).select("rid", F.expr("repeat('ACGGT', 3)").alias("bases"), F.array(*[(F.col("len") * (k + 3) % 31).cast("int") for k in range(15)]).alias("quals"), (F.col("x") % 15).alias("offset"), (F.col("flag").bitwiseAND(16) != 0).alias("reverse"), (F.col("flag").bitwiseAND(128) != 0).alias("read2"))
    return r.select("rid", S.context_covariate(F.col("bases"), F.col("quals"), F.col("offset"), 2, 2, F.col("reverse")).alias("context"), S.cycle_covariate(F.col("offset"), F.lit(15), F.col("read2"), F.col("reverse")).alias("cycle"))


COVARIATE_SQL = f"""{R}, b as (select rid, x % 15 as o, flag & 16 > 0 as rev, flag & 128 > 0 as two, array_to_string(list_transform(range(15), lambda k: case when len * (k + 3) % 31 <= 2 then 'N' else 'ACGGT'[k % 5 + 1] end), '') as s from reads),
 c as (select *, case when rev then reverse(translate(s, 'ACGT', 'TGCA')) else s end as t from b)
 select rid, case when o >= 1 and not contains(substr(t, o, 2), 'N') then substr(t, o, 2) end as context, cast(case when rev then 15 - o else o + 1 end * case when two then -1 else 1 end as int) as cycle from c"""


def merged_tranches(spark, d):
    t = E.variants(spark, d).select((F.col("size") % 5).cast("double").alias("min_score"), F.col("size").alias("n_known"), (F.col("size") % 7).alias("n_novel"), (F.col("qual") / 500.0).alias("novel_titv"))
    return tranche.merge_tranches(t).select("min_score", "n_known", "n_novel", F.round("novel_titv", 6).alias("novel_titv"))


def annotation_decode(spark, d):
    v = E.variants(spark, d).select("id", (F.col("size") % 5 / 10.0).alias("FS"), (F.col("size") % 3 * 0.6931472).alias("SOR"), (F.col("size") % 61).cast("double").alias("MQ"), F.when(F.col("size") % 6 > 0, F.col("size") / 10.0).alias("QD"))
    decoded = v.withColumns({n: F.round(tranche.decode_annotation(n, F.col(n), F.lit(0.5), 60), 9) for n in ("FS", "SOR", "MQ")})
    return tranche.impute_missing(decoded, ["QD"], F.lit(0.25))


DECODE_SQL = f"""{W}, x as (select id, size % 5 / 10.0 as fs, size % 3 * 0.6931472::double as sor, cast(size % 61 as double) as mq, case when size % 6 > 0 then size / 10.0 end as qd from variants), l as (select *, ln((mq + 0.01) / (60.01 - mq)) as lg from x)
 select id, round(case when fs <= 0.01 then fs + 0.005 else fs end, 9) as "FS", round(case when abs(sor - 0.6931472) <= 0.01 then sor + 0.005 else sor end, 9) as "SOR", round(case when abs(lg - ln(60.01 / 0.01)) <= 0.01 then lg + 0.025 else lg end, 9) as "MQ", coalesce(qd, 0.25) as "QD" from l"""


QUERIES = {
    "site_methods": (site_methods, _tested_sql(_SITE)),
    "genotype_methods": (genotype_methods, _tested_sql(_GENOTYPE)),
    "allele_methods": (allele_methods, _tested_sql(_ALLELE)),
    "select_genotypes": (select_genotypes, f"{G} select id from g where (gq1 > 20 and b >= 0 and a <> b) or (b >= 0 and size % 4 > 2) or (id % 3 > 2)"),
    "nonvariant_filtered": (nonvariant_filtered, f"{G} select id, size % 10 = 0 or not (a = 1 or b = 1 or c = 1) as non_variant, size % 10 = 0 as site_only, size % 4 = 0 as filtered from g"),
    "filtered_to_no_call": (filtered_to_no_call, f"{W} select id, case when size % 3 = 0 then '-1,-1' else (size % 2) || ',1' end || ',0,0' as gts from variants"),
    "subset_samples": (subset_samples, f"{W} select id, 1 as n, 'S2' as sample, cast(id % 40 as int) as gq from variants"),
    "remap_likelihoods": (remap_likelihoods, REMAP_SQL),
    "genotype_priors": (genotype_priors, PRIORS_SQL),
    "joint_pl": (joint_pl, JOINT_SQL),
    "joint_reference_confidence": (joint_reference_confidence, JOINT_REF_SQL),
    "call_confidence": (call_confidence, CONF_SQL),
    "carried_blocks": (carried_blocks, CARRY_SQL),
    "recal_scores": (recal_scores, RECAL_SQL),
    "read_uncertainty": (read_uncertainty, UNCERTAIN_SQL),
    "comparison_set": (comparison_set, COMPARE_SQL),
    "frequency_summary": (frequency_summary, f"{W} select contig, count(*) as n_called, round(avg(case when size % 5 = 2 then 0.5 when size % 5 >= 3 then 1.0 else 0.0 end), 9) as mean_af from variants where size % 5 > 0 group by 1"),
    "theta_watterson_sites": (theta_watterson_sites, f"{W} select count(*) as n_sites, round(count(*) / (select sum(1.0::double / k) from (select unnest(range(1, 41)) as k)), 6) as theta_w from variants where size % 2 = 1"),
    "stratified_novelty": (stratified_novelty, NOVEL_SQL),
    "distinct_fragments": (distinct_fragments, f"{R} select contig, cast(floor(pos / 500) as bigint) as pos, count(distinct name) as fragments from reads where mapq between 10 and 50 group by all"),
    "mate_five_prime": (mate_five_prime, MATE_SQL),
    "sort_duplicates": (sort_duplicates, f"{R} select rid, cast(row_number() over (partition by library, contig order by pos, flag & 16 > 0, mate_contig, mate_pos, rid) as int) as place from reads"),
    "interval_exact_join": (interval_exact_join, f"""with {E.SQL_TARGETS} select contig, start, "end", "end" % 11 as gc, start % 97 as count from targets where contig < 20"""),
    "separate_contigs": (separate_contigs, SEPARATE_SQL),
    "reads_with_tail": (reads_with_tail, TAIL_SQL),
    "number_texts": (number_texts, TEXT_SQL),
    "log_sums": (log_sums, LOG_SQL),
    "covariates": (covariates, COVARIATE_SQL),
    "merged_tranches": (merged_tranches, f"{W} select cast(size % 5 as double) as min_score, cast(sum(size) as bigint) as n_known, cast(sum(size % 7) as bigint) as n_novel, round(sum(qual / 500.0 * (size % 7)) / nullif(sum(size % 7), 0), 6) as novel_titv from variants group by 1"),
    "annotation_decode": (annotation_decode, DECODE_SQL),
}
