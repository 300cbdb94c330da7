"""Contamination, report tables, read filters and other rules with their SQL; SQL for queries of other modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import cnv, contamination, gvcf, kernels, readfilters, recal, somatic, validate, variants as V
from ..plans import encodings as E
from . import calls, models, reads, somatic as somatic_queries, tables
from .reads import COV

W = "with " + E.sql_variants()
R = "with " + E.sql_reads()


def _full_reads(spark, d):
    r = E.reads(spark, d)
    seq = F.repeat(F.lit("A"), (F.col("len") + F.when(F.col("x") == 1, 1).otherwise(0)).cast("int"))
    return r.select("*", F.when(F.col("tile") > 0, F.concat(F.lit("g"), F.col("tile"))).alias("read_group"), F.col("name").cast("string").alias("qname"), F.when(F.col("x") == 2, F.lit("*")).otherwise(seq).alias("seq"), F.repeat(F.lit("I"), F.col("len")).alias("qual"))


_OFF = "(flag & 4) > 0 or contig is null or contig < 0 or pos is null or pos < 0"
_MATE_OFF = "(flag & 8) > 0 or mate_contig is null or mate_contig < 0 or mate_pos is null or mate_pos < 0"
_GOOD = "not regexp_matches(cigar, '(^|[A-Z=])0+[A-Z=]|N|[0-9]+[ID][0-9]+[ID]|^([0-9]+[SH])*[0-9]+D|D([0-9]+[SH])*$')"
_LENGTHS = f"length(seq) = list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda x: x::int)) or {_OFF}"
_PARAMETERS = {"MappingQuality": {"low": 20, "high": 40}, "ReadGroup": {"keep": "g3"}, "ReadGroupBlackList": {"drop": ("g1", "g2")}, "ReadName": {"name": "7"}, "ReadLength": {"low": 10, "high": 40}, "SoftClipped": {"most": 0.1}}
_FILTER_SQL = {
    "AllowAll": "true", "Mapped": f"not ({_OFF})", "NotDuplicate": "flag & 1024 = 0", "NotSecondary": "flag & 256 = 0", "NotSupplementary": "flag & 2048 = 0", "PrimaryLine": "flag & 2304 = 0", "PassesVendorQuality": "flag & 512 = 0", "MappingQuality": "mapq between 20 and 40",
    "MappingQualityAvailable": "mapq <> 255", "MappingQualityNotZero": "mapq <> 0", "Paired": "flag & 1 > 0", "ProperlyPaired": "flag & 2 > 0", "FirstOfPair": "flag & 64 > 0", "SecondOfPair": "flag & 128 > 0", "ForwardStrand": "flag & 16 = 0", "ReverseStrand": "flag & 16 > 0",
    "MateOnSameContig": f"flag & 1 = 0 or {_MATE_OFF} or contig = mate_contig", "MateDifferentStrand": f"flag & 1 > 0 and not ({_MATE_OFF}) and (flag & 16 > 0) <> (flag & 32 > 0)", "MateUnmapped": _MATE_OFF, "NonZeroReferenceLength": "len > 0", "GoodCigar": _GOOD, "HasReadGroup": "rg is not null",
    "ReadGroup": "rg = 'g3'", "ReadGroupBlackList": "rg is null or rg not in ('g1', 'g2')", "ReadName": "name = 7", "ReadLength": "length(seq) between 10 and 40", "ReadLengthEqualsCigarLength": _LENGTHS, "SeqIsStored": "seq <> '*'", "MatchingBasesAndQuals": "length(seq) = len",
    "ValidAlignmentStart": "true", "SoftClipped": "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)S', 1), lambda x: x::int)), 0)::double / list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda x: x::int)) <= 0.1",
    "Wellformed": f"seq <> '*' and rg is not null and length(seq) = len and ({_LENGTHS}) and ({_OFF} or {_GOOD})",
}
_FULL = f"{R}, f as (select *, case when tile > 0 then 'g' || tile end as rg, case when x = 2 then '*' else repeat('A', len + case when x = 1 then 1 else 0 end) end as seq from reads)"


def read_filters_all(spark, d):
    """Every read filter by itself, and the calibration and pile-up chains."""
    r = _full_reads(spark, d)
    chains = {"calibration": readfilters.chain(readfilters.CALIBRATION), "pileup": readfilters.chain(readfilters.PILEUP)}
    return r.agg(*[F.count_if(readfilters.chain([n], parameters=_PARAMETERS)).alias(n) for n in readfilters.FILTERS], *[F.count_if(c).alias(n) for n, c in chains.items()])


def _filters_sql():
    both = " and ".join(f"({_FILTER_SQL[n]})" for n in readfilters.CALIBRATION), " and ".join(f"({_FILTER_SQL[n]})" for n in readfilters.PILEUP)
    cols = [f'count(*) filter ({_FILTER_SQL[n]}) as "{n}"' for n in readfilters.FILTERS]
    return f"{_FULL} select {', '.join(cols)}, count(*) filter ({both[0]}) as calibration, count(*) filter ({both[1]}) as pileup from f"


def hard_filters(spark, d):
    size, i = F.col("size"), F.col("id").cast("int")
    v = E.variants(spark, d).select(
        "id", (size % 40 + 10).alias("median_base_quality"), (size % 50 + 15).alias("median_mapping_quality"), (i % 300).alias("ref_fragment_length"), (i % 7 * 3000).alias("alt_fragment_length"), (size % 4).alias("median_read_position"), (i % 4).alias("events_in_region"),
        (size % 3).alias("n_alts_passing"), (i % 11 * 1000000).alias("n_count"), (size % 9).alias("alt_count"), (i % 5).alias("forward_alt"), (size % 5).alias("reverse_alt"), (i % 13 == 0).alias("in_panel"), F.lit(0.1).alias("af"), (size % 6).alias("unique_alt_count"))
    return v.select("id", F.array_join(V.labels(F.array(F.lit("PASS")), {n: c() for n, c in somatic.HARD_FILTERS.items()}), ";").alias("filter"))


HARD_SQL = f"""{W} select id, coalesce(nullif(array_to_string(list_sort(list_filter([case when size % 40 < 10 then 'base_qual' end, case when size % 50 < 15 then 'map_qual' end, case when abs(id % 300 - id % 7 * 3000) > 10000 then 'fragment' end, case when size % 4 < 1 then 'position' end,
 case when id % 4 > 2 then 'clustered_events' end, case when size % 3 > 1 then 'multiallelic' end, case when id % 11 * 1000000 > (size % 9) * 1e6 then 'n_ratio' end, case when id % 5 < 1 or size % 5 < 1 then 'strict_strand' end, case when id % 13 = 0 then 'panel_of_normals' end,
 case when size % 6 < 1 then 'duplicate' end], lambda x: x is not null)), ';'), ''), 'PASS') as filter from variants"""


def dictionary_relations(spark, d):
    n = E.table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 100).alias("length"), F.md5(F.col("n_name").cast("binary")).alias("md5"))
    pairs = {"equal": (n, n), "subset": (n.where("length < 900"), n), "superset": (n, n.where("length >= 300")), "overlapping": (n.where("length < 900"), n.where("length > 300")), "disjoint": (n.where("length < 900"), n.where("length >= 900")), "conflicting": (n, n.withColumn("length", F.col("length") + 1))}
    out = None
    for name, (a, b) in pairs.items():
        part = validate.dictionary_relation(validate.dictionary_comparison(a, b)).withColumn("pair", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def applied_deltas(spark, d):
    v = E.variants(spark, d).select("id", recal.apply_deltas(F.array(F.col("size"), F.lit(2), F.lit(90)), F.array(F.col("size") % 7 - 3, -F.col("size"), F.col("size"))).alias("q"))
    return v.select("id", *[F.get("q", F.lit(k)).alias(f"q{k}") for k in range(3)])


def stitched_blocks(spark, d):
    """Blocks cut at tiles' edges, with PLs, merged over the edges."""
    s = E.table(spark, d, "part").select((F.col("p_size") % 5).alias("contig"), F.col("p_partkey").alias("at"), (F.col("p_partkey") % 1000 / 200 % 3 * 40).cast("int").alias("gq"), F.col("p_size").alias("size"))
    b = s.select(F.lit("s").alias("sample"), F.lit(1).alias("contig"), (F.col("at") * 10).alias("start"), (F.col("at") * 10 + F.when(F.col("at") % 37 == 0, 9).otherwise(10)).alias("end"), "gq", (F.col("size") % 9).alias("dp"), F.array(F.lit(0), F.col("size"), F.col("size") * 10).alias("pl"))
    out = gvcf.merge_blocks(b)
    return out.select("start", "end", "band", "min_gq", "n_blocks", F.get("pl", F.lit(1)).alias("pl1"), F.get("pl", F.lit(2)).alias("pl2"))


STITCH_SQL = """with b as (select p_partkey * 10 as start, p_partkey * 10 + case when p_partkey % 37 = 0 then 9 else 10 end as "end", cast(trunc(fmod((p_partkey % 1000) / 200.0, 3) * 40) as int) as gq, p_size as size from part),
 g as (select *, gq // 1 as q, case when gq < 60 then gq when gq < 70 then 60 when gq < 80 then 61 when gq < 90 then 62 when gq < 99 then 63 else 64 end as band from b),
 n as (select *, case when lag("end") over (order by start) is distinct from start or lag(band) over (order by start) is distinct from band then 1 else 0 end as new from g), r as (select *, sum(new) over (order by start) as run from n)
 select min(start) as start, max("end") as "end", cast(min(band) as int) as band, min(gq) as min_gq, count(*) as n_blocks, min(size) as pl1, min(size) * 10 as pl2 from r group by run"""


def pair_matrix(spark, d):
    """All reads of a region against all its haplotypes."""
    v = E.variants(spark, d)
    s = F.substr(F.repeat(F.lit("ACGTTGCAAC"), 8), F.col("size") % 9 + 1, F.lit(40))
    haps = v.where("id % 40 = 1").select(F.col("contig").alias("region"), F.col("id").alias("hap_id"), s.alias("hap"))
    reads = v.where("id % 10 = 3").select(F.col("contig").alias("region"), F.col("id").alias("read_id"), F.concat(F.substr(s, F.lit(1), F.lit(12)), F.lit("G"), F.substr(s, F.lit(14), F.lit(12))).alias("read"), F.array_repeat(F.lit(30) - F.col("size") % 10, 25).alias("quals"))
    return kernels.score_matrix(reads, haps).select("read_id", "hap_id", F.round("log10_likelihood", 6).alias("log10_likelihood"))


def _hmm(pairs: str, result: str) -> str:
    """The pair-HMM over CTE ``p`` (k, hap of 40, read of 25, e), a base of the read a step."""
    return f"""with recursive {E.sql_variants()}, {pairs},
 hmm as (select k, 0 as r, list_transform(range(41), lambda x: 0.0::double) as m, list_transform(range(41), lambda x: 0.0::double) as i, list_transform(range(41), lambda x: 1 / 40.0::double) as d from p
  union all
  select k, r + 1, m2 as m, list_transform(range(41), lambda j: case when j > 0 then m[j + 1] * pow(10, -4.5) + i[j + 1] * pow(10, -1.0) else 0 end) as i,
   list_transform(range(41), lambda j: coalesce(list_sum(list_transform(range(1, greatest(j, 1)), lambda q: m2[q + 1] * pow(10, -4.5) * pow(10, -1.0 * (j - 1 - q)))), 0)) as d
  from (select h.*, list_transform(range(41), lambda j: case when j > 0 then case when p.hap[j] = p.read[h.r + 1] then 1 - p.e else p.e / 3 end * (h.m[greatest(j, 1)] * (1 - 2 * pow(10, -4.5)) + (h.i[greatest(j, 1)] + h.d[greatest(j, 1)]) * (1 - pow(10, -1.0))) else 0 end) as m2 from hmm h join p on h.k = p.k where r < 25)),
 l as (select k, log10(list_sum(m) + list_sum(i)) as l from hmm where r = 25) {result}"""


_SHAPES = """s as (select distinct size as k, substr(repeat('ACGTTGCAAC', 8), size % 9 + 1, 40) as hap, 30 - size % 10 as q from variants), p as (select k, hap, substr(hap, 1, 12) || 'G' || substr(hap, 14, 12) as read, pow(10, -q / 10.0) as e from s)"""
PAIRHMM_SQL = _hmm(_SHAPES, "select id, round(l, 6) as log10_likelihood from variants v join l on v.size = l.k")
BEST_SQL = _hmm(_SHAPES, """, a as (select contig as read_id, 'h' || (id % 4) as best, id % 4 as o, max(l) as v from variants v join l on v.size = l.k group by all), c as (select *, greatest(v, max(v) over (partition by read_id) - 4.5) as w from a),
 o as (select *, row_number() over (partition by read_id order by w desc, o) as rn, lead(w) over (partition by read_id order by w desc, o) as nx from c) select read_id, best, coalesce(w - nx, 'inf'::double) as confidence, coalesce(w - nx, 'inf'::double) > 0.2 as informative from o where rn = 1""")
_MATRIX = """h as (select contig, id as hap_id, substr(repeat('ACGTTGCAAC', 8), size % 9 + 1, 40) as hap from variants where id % 40 = 1), t as (select contig, id as read_id, substr(repeat('ACGTTGCAAC', 8), size % 9 + 1, 40) as s, 30 - size % 10 as q from variants where id % 10 = 3),
 p as (select read_id::varchar || '/' || hap_id::varchar as k, hap, substr(s, 1, 12) || 'G' || substr(s, 14, 12) as read, pow(10, -q / 10.0) as e from t join h on t.contig = h.contig)"""
MATRIX_SQL = _hmm(_MATRIX, "select split_part(k, '/', 1)::bigint as read_id, split_part(k, '/', 2)::bigint as hap_id, round(l, 6) as log10_likelihood from l")

EXACT_SQL = f"""{W}, t as (select distinct size % 7 as a, size % 11 as b, size % 5 as c, size % 13 as e from variants), f as (select *, a + b as row, a + c as col, a + b + c + e as n from t),
 lf as (select f.*, x, lgamma(row + 1) + lgamma(n - row + 1) + lgamma(col + 1) + lgamma(n - col + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(row - x + 1) - lgamma(col - x + 1) - lgamma(n - row - col + x + 1) as lp from f, lateral (select unnest(range(greatest(0, row + col - n), least(row, col) + 1)) as x)),
 fisher as (select a, b, c, e, least(1.0, sum(exp(lp)) filter (lp <= seen + 1e-12)) as fisher from (select *, max(case when x = a then lp end) over (partition by a, b, c, e) as seen from lf) group by all),
 g as (select *, b as ref2, a as het, c as hom, a + b + c as m, 2 * least(b, c) + a as rare from t), hs as (select g.*, h from g, lateral (select unnest(range(rare % 2, rare + 1, 2)) as h) where m > 0),
 hp as (select *, lgamma(m + 1) + h * ln(2) - lgamma((rare - h) / 2 + 1) - lgamma(h + 1) - lgamma(m - h - (rare - h) / 2 + 1) as lp from hs), hn as (select *, exp(lp - max(lp) over (partition by a, b, c, e)) as w from hp),
 ex as (select a, b, c, e, (coalesce(sum(w) filter (h = het), 0) / 2 + coalesce(sum(w) filter (h > het), 0)) / sum(w) as tail from hn group by all)
 select id, round(fisher, 9) as fisher, round(case when tail is null then 0 when tail < pow(10, -99.9) then 999 else greatest(0, -10 * log10(tail)) end, 6) as excess_het
 from variants v join fisher f on f.a = v.size % 7 and f.b = v.size % 11 and f.c = v.size % 5 and f.e = v.size % 13 left join ex on ex.a = f.a and ex.b = f.b and ex.c = f.c and ex.e = f.e"""

MINIMAL_SQL = f"""{W}, x as (select id, pos, ref || 'CA' as r, alt || 'CA' as a from variants), t as (select *, coalesce(list_max(list_filter(range(1, least(length(r), length(a))), lambda k: r[-k:] = a[-k:])), 0) as k from x),
 s as (select id, pos, r[1:length(r) - k] as r, a[1:length(a) - k] as a from t), h as (select *, coalesce(list_max(list_filter(range(1, least(length(r), length(a))), lambda k: r[1:k] = a[1:k])), 0) as k from s) select id, pos + k as pos, r[k + 1:] as ref, a[k + 1:] as alt from h"""

_CODONS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in S.CODONS.items()) + "}"
PROTEIN_SQL = f"""{W}, c as (select id, alt[1] as alt, id % 30 as o, substr('ATGGCATTCGGATGACCAGTTAAACGTTGA', cast(id % 30 // 3 * 3 + 1 as int), 3) as codon from variants), n as (select *, codon[1:o % 3] || alt || codon[o % 3 + 2:] as changed from c), a as (select *, {_CODONS}[codon] as x, {_CODONS}[changed] as y from n)
 select id, codon as ref_codon, changed as alt_codon, case when x = y then 'SILENT' when y = '*' then 'NONSENSE' when x = '*' then 'NONSTOP' else 'MISSENSE' end as kind from a"""

SEGMENT_SQL = f"""with {E.SQL_COUNTS}, s as (select sample, count(*) as n_points, round(avg(count) / 8.0 * (1 + case when sample % 5 = 0 then 0.5 else 0 end), 9) as ratio from counts group by 1), a as (select * from s where ratio between 0.9 and 1.1),
 m as (select sum(n_points * ratio) / sum(n_points) as m, count(*) as k, sum(n_points) as n from a), d as (select m.m, case when any_value(k) > 1 then sqrt(sum(n_points * pow(ratio - m.m, 2)) / ((any_value(k) - 1)::double / any_value(k) * any_value(m.n))) else 'nan'::double end as s from a, m group by m.m),
 i as (select a.* from a, d where case when s = 0 then abs(ratio - m) <= 1e-12 else abs(ratio - m) <= s * 2.0 end), m2 as (select sum(n_points * ratio) / sum(n_points) as m, count(*) as k, sum(n_points) as n from i),
 d2 as (select any_value(m2.m) as m, case when any_value(k) > 1 then sqrt(sum(n_points * pow(ratio - m2.m, 2)) / ((any_value(k) - 1)::double / any_value(k) * any_value(m2.n))) else 'nan'::double end as s from i, m2)
 select sample, n_points, ratio, case when ratio between 0.9 and 1.1 or isnan(s) or s is null then '0' when ratio - m < -2 * s then '-' when ratio - m > 2 * s then '+' else '0' end as call from s, d2"""

HET_SQL = f"""{W}, t as (select distinct size % 17 + 3 as r, id % 13 as k from variants), b as (select r, k, j, lgamma(r + k + 2) - lgamma(j + 1) - lgamma(r + k + 2 - j) as lc, r + k + 1 as n from t, lateral (select unnest(range(k + 1, r + k + 2)) as j)),
 c as (select r, k, least(1, sum(exp(lc + j * ln(0.05) + (n - j) * ln(0.95)))) as low from b group by all), u as (select r, k, lgamma(r + k + 2) - lgamma(j + 1) - lgamma(r + k + 2 - j) as lc, j, r + k + 1 as n from t, lateral (select unnest(range(r + 1, r + k + 2)) as j)),
 w as (select r, k, least(1, sum(exp(lc + j * ln(0.05) + (n - j) * ln(0.95)))) as high from u group by all), o as (select c.r, c.k, low + high as tail from c join w on c.r = w.r and c.k = w.k)
 select id, round(case when tail < 1 then -log10(greatest(tail, 1e-300)) else 0 end, 6) as het_odds from variants v join o on o.r = v.size % 17 + 3 and o.k = v.id % 13 where case when tail < 1 then -log10(greatest(tail, 1e-300)) else 0 end >= 1.0"""

PILEUP_SQL = f"""{R}, n as (select contig, pos, base, count(*) as n from reads group by all), f as (select *, sum(n) over (partition by contig, pos) as t, arg_max(base, (n, base)) over (partition by contig, pos) as top from n),
 l as (select *, n::double / t as f, n * log10(n::double / t / 0.01) + (t - n) * (log10(greatest(1 - n::double / t, 1e-12)) - log10(0.99)) as lod from f) select contig, cast(sum(n) as bigint) as corrected from l where lod < 3 and f < 0.5 and base <> top group by contig"""


def _quality_sql() -> str:
    """Empirical qualities of four covariate tables, put together."""
    def table(name: str, keys: str, prior: str) -> str:
        return f"""{name} as (select {keys}, arg_max(q, struct_pack(z := z, m := -q)) as q from (select {keys}, q, -0.5 * pow(least(abs(q - ({prior})), 40) / 0.5, 2) + (mm + 1) * ln(pow(10, -q / 10.0)) + (n + 2 - mm - 1) * case when q > 0 then ln(greatest(1 - pow(10, -q / 10.0), 1e-300)) when n + 2 > mm + 1 then -1e300 else 0 end as z
 from (select {keys}, count(*) as n, sum(mismatch::int) as mm from cov group by all), (select unnest(range(61)) as q)) group by all)"""
    tables = [table("ql", "library", "30"), table("qr", "library, reported", "reported"), table("qc", "library, reported, cycle", "reported"), table("qx", "library, reported, context", "reported")]
    return f"""{R}, {COV}, {', '.join(tables)}, o as (select library, reported, cycle, context, count(*) as n from cov group by all)
 select o.library, o.reported, o.cycle, o.context, o.n, cast(o.reported + round(least(greatest(coalesce(qr.q, ql.q, 30) + coalesce(qc.q - coalesce(qr.q, ql.q, 30), 0) + coalesce(qx.q - coalesce(qr.q, ql.q, 30), 0) - o.reported, -20), 20)) as int) as recalibrated
 from o join ql using (library) join qr using (library, reported) join qc using (library, reported, cycle) join qx using (library, reported, context)"""


def _contaminated(spark, d):
    v, size, i = E.variants(spark, d), F.col("size"), F.col("id").cast("int")
    kind = F.when(i % 3 == 0, "hom_alt").when(i % 3 == 1, "hom_ref").otherwise("het")
    # Three samples, whose segments are balanced, tilted and lost.
    return v.select(
        F.concat(F.lit("s"), F.col("contig") % 3).alias("sample"), kind.alias("genotype"), (size + 20).alias("depth"),
        F.when(i % 3 == 0, size % 4).otherwise(size + 20 - size % 5).alias("ref_count"), F.when(i % 3 == 0, size + 20 - size % 4).otherwise(size % 5).alias("alt_count"), (size % 10 / 20.0 + 0.02).alias("af"),
        F.when(F.col("contig") % 3 == 0, 0.45).when(F.col("contig") % 3 == 1, 0.23).otherwise(0.1).alias("maf"))


def contamination_cascade(spark, d):
    out = contamination.estimate(_contaminated(spark, d))
    return out.select("sample", F.round("contamination", 7).alias("contamination"), F.round("error", 7).alias("error"), "by", "n_sites")


CASCADE_SQL = f"""{W}, s as (select 's' || (contig % 3) as sample, case id % 3 when 0 then 'hom_alt' when 1 then 'hom_ref' else 'het' end as genotype, size + 20 as depth, case when id % 3 = 0 then size % 4 else size + 20 - size % 5 end as rc, case when id % 3 = 0 then size + 20 - size % 4 else size % 5 end as ac,
  size % 10 / 20.0 + 0.02 as af, case contig % 3 when 0 then 0.45 when 1 then 0.23 else 0.1 end as maf from variants), q as (select sample, greatest(0.1, quantile_disc(ac::double / depth, 0.9)) as most from s where ac::double / depth < 0.15 group by 1),
 t as (select k, round(0.40 - 0.04 * k, 2) as m, case when k < 4 then 'hom_alt' when k < 5 then 'hom_ref' else 'low_alt' end as kind from (select unnest(range(11)) as k)),
 r as (select s.sample, k, kind, depth::double as d, case when kind = 'hom_alt' then rc else ac end as o, case when kind = 'hom_alt' then 1 - af else af end as f from s cross join t left join q on q.sample = s.sample where case when kind = 'low_alt' then ac::double / depth < 0.15 and ac::double / depth <= most else genotype = kind and maf > m end),
 a as (select sample, k, kind, sum(d * f) as w, sum(f * (1 - f) * d * d) as two, greatest(0, sum(o) - floor(sum(d) * (0.001 / 3) + 0.5)) / sum(d * f) as c, count(*) as n from r group by all having sum(d * f) > 0),
 b as (select *, w * w - two + w as qa, -(2 * c * w * w + w) as qb, c * c * w * w as qc, sqrt(greatest(w * c * (1 - c) + two * c * c, 0)) / w as side from a), z as (select *, (-qb - sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa) as lo, (-qb + sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa) as hi from b),
 e as (select *, greatest(case when qa > 0 and hi between c and 1 then hi - c else side end, case when qa > 0 and lo between 0 and c then c - lo else side end) as err from z),
 p as (select *, row_number() over (partition by sample order by case when err < c * 0.2 + 0.001 then 0 else 1 end, case when err < c * 0.2 + 0.001 then k else -k end) as rn from e), ch as (select * from p where rn = 1 and (err < c * 0.2 + 0.001 or k = 10))
 select x.sample, round(coalesce(least(c, 1), 0), 7) as contamination, round(coalesce(err, 1), 7) as error, coalesce(kind, 'none') as by, coalesce(n, 0) as n_sites from (select distinct sample from s) x left join ch on ch.sample = x.sample"""


def contamination_lookup(spark, d):
    v = E.variants(spark, d).select("id", F.concat(F.lit("s"), F.col("id") % 4).alias("sample"), "contig", "pos")
    seg = E.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 4).alias("sample"), (F.col("s_suppkey") % 25).cast("int").alias("contig"), (F.col("s_suppkey") * 10).alias("start"), (F.col("s_suppkey") * 10 + 4000).alias("end"), (F.col("s_suppkey") % 50 / 100.0).alias("maf"))
    samples = spark.createDataFrame([("s0", 0.01), ("s1", 0.2), ("s2", 0.0)], "sample string, contamination double")
    out = contamination.look_up(v, seg, samples)
    priors = spark.createDataFrame([("AC", "T", 0.02), ("CG", "T", 0.5), ("AC", "T", 0.01)], "context string, alt string, prior double")
    return contamination.orientation_prior(out.withColumn("context", F.when(F.col("id") % 2 == 0, "AC").otherwise("CG")).withColumn("alt", F.when(F.col("id") % 3 == 0, "T").otherwise("A")), priors).select("id", "maf", "contamination", F.round("log10_prior", 6).alias("log10_prior"))


LOOKUP_SQL = f"""{W}, v as (select id, 's' || (id % 4) as sample, contig, pos from variants), g as (select 's' || (s_suppkey % 4) as sample, cast(s_suppkey % 25 as int) as contig, s_suppkey * 10 as start, s_suppkey * 10 + 4000 as "end", s_suppkey % 50 / 100.0 as maf from supplier),
 h as (select v.id, arg_min(g.maf, g.start) as maf from v join g on v.sample = g.sample and v.contig = g.contig and v.pos >= g.start and v.pos < g."end" group by 1)
 select v.id, coalesce(h.maf, 0.5)::double as maf, case v.sample when 's0' then 0.01 when 's1' then 0.2 else 0.0 end::double as contamination, round(log10(case when v.id % 3 = 0 then case when v.id % 2 = 0 then 0.02 else 0.5 end else 1e-8 end), 6) as log10_prior from v left join h on v.id = h.id"""


def balanced_segments(spark, d):
    s = E.table(spark, d, "part").select(F.lit("s").alias("sample"), (F.col("p_partkey") % 5).alias("contig"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 1000 < 500, F.col("p_size") / 500.0).otherwise(1 - F.col("p_size") / 400.0 - 0.2).alias("share"))
    return contamination.balanced_segments(s, 0.08).select("contig", "start", "end", F.round("maf", 8).alias("maf"), "n_sites")


BALANCED_SQL = """with s as (select p_partkey % 5 as contig, p_partkey as pos, case when p_partkey % 1000 < 500 then p_size / 500.0 else 1 - p_size / 400.0 - 0.2 end as share from part), f as (select *, least(share, 1 - share) as f from s),
 n as (select *, case when coalesce(abs(f - lag(f) over (partition by contig order by pos)) > 0.08, true) then 1 else 0 end as n from f), r as (select *, sum(n) over (partition by contig order by pos) as run from n)
 select contig, min(pos) as start, max(pos) + 1 as "end", round(avg(f), 8) as maf, count(*) as n_sites from r group by contig, run"""


def smoothed_segments(spark, d):
    c = E.counts(spark, d).select(F.col("sample").alias("contig"), F.floor(F.col("interval") / 4).alias("part"), F.log2(F.col("count").cast("double")).alias("x"), "interval")
    s = c.groupBy("contig", "part").agg(F.min("interval").cast("long").alias("start"), (F.max("interval") + 1).cast("long").alias("end"), F.count(F.lit(1)).alias("n_points"), F.avg("x").alias("mean"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("sd"))
    return cnv.smooth(s.drop("part"))


def _text(c):
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")


def split_fields(spark, d):
    size = F.col("size")
    v = E.variants(spark, d).withColumn("alts", F.array("alt", F.lit("<DEL>"))).withColumn("af_", F.array(size, size + 1)).withColumn("ad", F.array(size, size * 2, size * 3)).withColumn("pl", F.array(*[size * k for k in range(6)]))
    out = V.split_multiallelic(v, ("af_",), ("ad",), ("pl",))
    return out.select("id", "alt_index", F.col("af_").alias("a"), _text("ad").alias("r"), _text("pl").alias("g"))


def compacted_alternates(spark, d):
    size = F.col("size")
    v = E.variants(spark, d).select("id", F.array("alt", F.lit("<A>"), F.lit("<B>")).alias("alts"), F.array(F.array(F.lit(0), F.when(size % 2 == 0, 3).otherwise(0)), F.array(F.lit(-1), F.when(size % 3 == 0, 1).otherwise(3))).alias("gts"),
                                     F.array(size, size + 1, size + 2).alias("a"), F.array(size, size + 1, size + 2, size + 3).alias("r"), F.array(*[size * 100 + k for k in range(10)]).alias("g"))
    out = V.drop_unused_alternates(v, ("a",), ("r",), ("g",))
    return out.select("id", _text("alts").alias("alts"), _text(F.flatten("gts")).alias("gts"), _text("a").alias("a"), _text("r").alias("r"), _text("g").alias("g"))


COMPACT_SQL = f"""{W}, k as (select *, size % 3 = 0 as one, size % 2 = 0 or size % 3 <> 0 as three from variants)
 select id, array_to_string(list_concat(case when one then [alt] else [] end, case when three then ['<B>'] else [] end), ',') as alts, concat_ws(',', 0, case when size % 2 = 0 then case when one then 2 else 1 end else 0 end, -1, case when one then 1 else 1 end) as gts,
 array_to_string(list_concat(case when one then [size] else [] end, case when three then [size + 2] else [] end), ',') as a, array_to_string(list_concat([size], case when one then [size + 1] else [] end, case when three then [size + 3] else [] end), ',') as r,
 array_to_string(list_transform(case when one and three then [0, 1, 2, 6, 7, 9] when one then [0, 1, 2] else [0, 6, 9] end, lambda x: size * 100 + x), ',') as g from k"""


def recal_deltas(spark, d):
    c = reads._covariates(spark, d)
    a, b = (recal.covariate_table(c.where(x), ["library", "reported"]) for x in ("cycle % 2 = 0 and reported > 8", "cycle % 2 = 1"))
    return recal.delta_rows(a, b, ["library", "reported"])


def _deltas_sql() -> str:
    def side(name: str, cond: str) -> str:
        return f"""{name} as (select library, reported, n, cast(arg_max(q, struct_pack(z := z, m := -q)) as int) as q from (select library, reported, n, q, -0.5 * pow(least(abs(q - reported), 40) / 0.5, 2) + (mm + 1) * ln(pow(10, -q / 10.0)) + (n + 1 - mm) * case when q > 0 then ln(1 - pow(10, -q / 10.0)) else -1e300 end as z
 from (select library, reported, count(*) as n, sum(mismatch::int) as mm from cov where {cond} group by all), (select unnest(range(61)) as q)) group by all)"""
    return f"""{R}, {COV}, {side("a", "cycle % 2 = 0 and reported > 8")}, {side("b", "cycle % 2 = 1")} select library, reported, a.n as observations_before, a.q as empirical_before, a.q - reported as accuracy_before, b.n as observations_after, b.q as empirical_after, b.q - reported as accuracy_after from a full join b using (library, reported)"""


def interval_filters(spark, d):
    t = E.targets(spark, d).withColumn("gc_content", F.col("start") % 97 / 97.0).withColumn("mappability", F.when(F.col("end") % 5 > 0, F.col("end") % 13 / 13.0))
    return cnv.annotation_filter(t, {"gc_content": (0.1, 0.9), "mappability": (0.3, 1.0)}).select("contig", "start", "end")


def extreme_counts(spark, d):
    return cnv.extreme_count_filter(E.counts(spark, d), 10.0, 90.0, 20.0).select("interval", F.round("bad_share", 6).alias("bad_share"))


QUERIES = {
    "split_fields": (split_fields, f"{W} select id, 0 as alt_index, size as a, size || ',' || (size * 2) as r, concat_ws(',', 0, size, size * 2) as g from variants union all select id, 1, size + 1, size || ',' || (size * 3), concat_ws(',', 0, size * 3, size * 5) from variants"),
    "compacted_alternates": (compacted_alternates, COMPACT_SQL),
    "recal_deltas": (recal_deltas, _deltas_sql()),
    "interval_filters": (interval_filters, f"""with {E.SQL_TARGETS} select contig, start, "end" from targets where start % 97 / 97.0 between 0.1 and 0.9 and ("end" % 5 = 0 or "end" % 13 / 13.0 between 0.3 and 1.0)"""),
    "extreme_counts": (extreme_counts, f"""with {E.SQL_COUNTS}, p as (select sample, quantile_cont(count, 0.1) as lo, quantile_cont(count, 0.9) as hi from counts group by 1), b as (select interval, round(100.0 * count(*) filter (count < lo or count > hi) / count(*), 6) as bad_share from counts join p using (sample) group by 1) select * from b where bad_share <= 20"""),
    "read_filters_all": (read_filters_all, _filters_sql()),
    "hard_filters": (hard_filters, HARD_SQL),
    "dictionary_relations": (dictionary_relations, "select unnest(['equal', 'subset', 'superset', 'overlapping', 'disjoint', 'conflicting']) as relation, unnest(['equal', 'subset', 'superset', 'overlapping', 'disjoint', 'conflicting']) as pair"),
    "applied_deltas": (applied_deltas, f"{W} select id, least(93, greatest(1, size + size % 7 - 3)) as q0, least(93, greatest(1, 2 - size)) as q1, least(93, 90 + size) as q2 from variants"),
    "stitched_blocks": (stitched_blocks, STITCH_SQL),
    "pair_matrix": (pair_matrix, MATRIX_SQL),
    "contamination_cascade": (contamination_cascade, CASCADE_SQL),
    "contamination_lookup": (contamination_lookup, LOOKUP_SQL),
    "balanced_segments": (balanced_segments, BALANCED_SQL),
    "smoothed_segments": (smoothed_segments, None),
    "pairhmm_scores": (models.pairhmm_scores, PAIRHMM_SQL),
    "best_alleles": (models.best_alleles, BEST_SQL),
    "exact_tests": (models.exact_tests, EXACT_SQL),
    "minimal_alleles": (calls.minimal_alleles, MINIMAL_SQL),
    "protein_changes": (somatic_queries.protein_changes, PROTEIN_SQL),
    "cnv_call_segments": (tables.cnv_call_segments, SEGMENT_SQL),
    "het_sites": (somatic_queries.het_sites, HET_SQL),
    "pileup_correction": (somatic_queries.pileup_correction, PILEUP_SQL),
    "recal_applied": (reads.recal_applied, _quality_sql()),
}
