"""Count matrices, copy number, sequence composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import sequence as S
from ..operators import cnv
from ..plans import encodings as E

W = "with " + E.SQL_COUNTS
DOC = "d as (select doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as s from documents)"


def _sequence(spark, d):
    return E.table(spark, d, "documents").select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("s"))


def low_count_filter(spark, d):
    return cnv.low_count_filter(E.counts(spark, d), 5, 50.0)


LOW_SQL = f"{W}, s as (select count(distinct sample) as s from counts), l as (select interval, count(*) filter (count < 5) as low from counts group by 1) select interval from l, s where not low > 50.0 * s / 100.0"


def panel_filters(spark, d):
    return cnv.extreme_filter(E.counts(spark, d), 5.0, 95.0, 10.0)


QUANT = "case when n = 0 then null when {p} * (n + 1) / 100.0 < 1 then v[1] when {p} * (n + 1) / 100.0 >= n then v[n] else v[cast(floor({p} * (n + 1) / 100.0) as bigint)] + ({p} * (n + 1) / 100.0 - floor({p} * (n + 1) / 100.0)) * (v[cast(floor({p} * (n + 1) / 100.0) as bigint) + 1] - v[cast(floor({p} * (n + 1) / 100.0) as bigint)]) end"
PANEL_SQL = f"""{W}, l as (select sample, list(count::double order by count) as v, count(*) as n from counts group by 1), q as (select sample, {QUANT.format(p=5.0)} as lo, {QUANT.format(p=95.0)} as hi from l), s as (select count(*) as s from q),
 o as (select interval, count(*) filter (c.count < lo or c.count > hi) as bad from counts c join q on c.sample = q.sample group by 1) select interval from o, s where not bad > 10.0 * s / 100.0"""


def sample_percentiles(spark, d):
    v = E.counts(spark, d).groupBy("sample").agg(F.sort_array(F.collect_list(F.col("count").cast("double"))).alias("v"))
    return v.select("sample", F.round(numeric.quantile_n_plus_one(F.col("v"), 30.0), 9).alias("p30"), numeric.quantile_floor(F.col("v"), 0.75).alias("q3"))


PERCENTILE_SQL = f"{W}, l as (select sample, list(count::double order by count) as v, count(*) as n from counts group by 1) select sample, round({QUANT.format(p=30.0)}, 9) as p30, v[cast(floor(0.75 * (n - 1)) as bigint) + 1] as q3 from l"


def cnv_standardise(spark, d):
    return cnv.standardise(E.counts(spark, d)).select("sample", "interval", F.round("log2_ratio", 6).alias("log2_ratio"))


STD = """f as (select sample, interval, count::double / sum(count) over (partition by sample) as f from counts), m as (select sample, median(f) as m from f group by 1),
 l as (select f.sample, interval, log2(greatest(f / m, 1e-10)) as l from f join m on f.sample = m.sample), m2 as (select sample, median(l) as m from l group by 1), std as (select l.sample, interval, l - m as r from l join m2 on l.sample = m2.sample)"""


def gc_correction(spark, d):
    c = E.counts(spark, d).select("sample", "interval", F.col("count").cast("double").alias("value"), ((F.col("interval") * 7 + F.col("sample")) % 101 / 100.0).alias("gc"))
    return cnv.gc_correct(c).select("sample", "interval", F.round("corrected", 6).alias("corrected"))


GC_SQL = f"""{W}, b as (select sample, interval, count::double as value, cast(floor(((interval * 7 + sample) % 101) / 100.0 * 100 + 0.5) as int) as bin from counts), m as (select bin, median(value) as m, count(*) as n from b group by 1),
 s as (select x.bin, sum(exp(-abs(x.bin - y.bin) / (0.02 * 101)) * y.n * y.m) / sum(exp(-abs(x.bin - y.bin) / (0.02 * 101)) * y.n) as s from m x, m y group by 1) select sample, interval, round(value / nullif(s, 0), 6) as corrected from b join s on b.bin = s.bin"""


def _points(spark, d):
    c = E.counts(spark, d)
    return c.select(F.col("sample").alias("contig"), F.col("interval").cast("long").alias("start"), (F.col("interval") + 1).cast("long").alias("end"), F.log2(F.col("count").cast("double")).alias("log2_ratio"))


def cnv_changepoints(spark, d):
    return cnv.change_points(_points(spark, d), 0.6).groupBy("contig", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


CHANGE_SQL = f"""{W}, p as (select sample as contig, interval::bigint as start, interval + 1::bigint as "end", log2(count::double) as v from counts), l as (select *, lag(v) over w as pv, lag("end") over w as pe from p window w as (partition by contig order by start)),
 s as (select *, cast(sum(case when pe is null or start > pe or abs(v - pv) > 0.6 then 1 else 0 end) over (partition by contig order by start rows unbounded preceding) as int) as segment from l) select contig, segment, min(start) as start, cast(max("end") as bigint) as "end", count(*) as n from s group by 1, 2"""


def cnv_segments(spark, d):
    return cnv.segment(_points(spark, d), 0.8, 3)


def cnv_call_segments(spark, d):
    c = E.counts(spark, d).groupBy("sample").agg(F.count(F.lit(1)).alias("n_points"), F.avg("count").alias("m"))
    s = c.select("sample", "n_points", F.round(F.col("m") / 8.0 * (1 + (F.col("sample") % 5 == 0).cast("int") * 0.5), 9).alias("ratio"))
    return cnv.call_segments(s).select("sample", "n_points", "ratio", "call")


def panel_denoise(spark, d):
    s = cnv.standardise(E.counts(spark, d)).select("sample", "interval", "log2_ratio")
    return cnv.denoise(s.where("sample >= 15"), s.where("sample < 15"), 5).select("sample", "interval", F.round("denoised", 6).alias("denoised"))


def base_composition(spark, d):
    s = _sequence(spark, d)
    return s.agg(*[F.sum(F.length("s") - F.length(F.replace(F.col("s"), F.lit(b), F.lit("")))).alias(b) for b in "ACGT"]).unpivot([], list("ACGT"), "base", "n")


BASE_SQL = f"""with {DOC}, c as (select {', '.join(f"cast(sum(length(s) - length(replace(s, '{b}', ''))) as bigint) as {chr(34)}{b}{chr(34)}" for b in "ACGT")} from d) select * from (unpivot c on * into name base value n)"""


def kmer_counts(spark, d):
    return _sequence(spark, d).select(F.explode(S.kmers(F.col("s"), 6)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


KMER = "k as (select unnest([s[i : i + {0}] for i in range(1, greatest(length(s) - {0}, 0)::bigint + 1)]) as kmer from d)"


def kmer_edges(spark, d):
    pairs = _sequence(spark, d).select(F.explode(S.kmers(F.col("s"), 6)).alias("e")).select(F.substring("e", 1, 5).alias("a"), F.substring("e", 2, 5).alias("b"))
    edges = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    return edges.groupBy("a").agg(F.count(F.lit(1)).alias("out_degree"), F.sum("weight").alias("weight"))


def context_counts(spark, d):
    c = _sequence(spark, d).select(F.explode(S.kmers(F.col("s"), 3)).alias("c"))
    flip = S.reverse_complement(F.col("c"))
    return c.select(F.least("c", flip).alias("context")).groupBy("context").agg(F.count(F.lit(1)).alias("n"))


def gc_by_document(spark, d):
    return _sequence(spark, d).select("doc_id", F.round(S.gc_content(F.col("s")), 9).alias("gc"))


def proteins(spark, d):
    return _sequence(spark, d).select("doc_id", F.length(S.translate_sequence(F.col("s"))).alias("n"), F.length(F.replace(S.translate_sequence(F.col("s")), F.lit("*"), F.lit(""))).alias("residues"))


PROTEIN_SQL = f"""with {DOC}, c as (select doc_id, [s[3 * i + 1 : 3 * i + 3] for i in range(0, length(s) // 3)] as c from d) select doc_id, cast(len(c) as int) as n, cast(len(list_filter(c, lambda x: x not in ('TAA', 'TAG', 'TGA'))) as int) as residues from c"""


def index_summary(spark, d):
    i = E.intervals(spark, d)
    n = F.col("end") - F.col("start")
    return i.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.var_samp(n), 6).alias("variance"))


def speaker_runs(spark, d):
    from pyspark.sql import Window

    c = E.table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    runs = c.withColumn("_n", (F.lag("role").over(w).isNull() | (F.lag("role").over(w) != F.col("role"))).cast("int")).withColumn("run", F.sum("_n").over(w))
    return runs.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("n"))


RUNS_SQL = """with l as (select *, lag(role) over (partition by conv_id order by turn) as p from conversations), r as (select *, cast(sum(case when p is null or p <> role then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as run from l) select conv_id, run, min(role) as role, count(*) as n from r group by 1, 2"""

QUERIES = {
    "low_count_filter": (low_count_filter, LOW_SQL),
    "panel_filters": (panel_filters, PANEL_SQL),
    "sample_percentiles": (sample_percentiles, PERCENTILE_SQL),
    "cnv_standardise": (cnv_standardise, f"{W}, {STD} select sample, interval, round(r, 6) as log2_ratio from std"),
    "gc_correction": (gc_correction, GC_SQL),
    "cnv_changepoints": (cnv_changepoints, CHANGE_SQL),
    "cnv_segments": (cnv_segments, None),
    "cnv_call_segments": (cnv_call_segments, None),
    "panel_denoise": (panel_denoise, None),
    "base_composition": (base_composition, BASE_SQL),
    "kmer_counts": (kmer_counts, f"with {DOC}, {KMER.format(5)} select kmer, count(*) as n from k group by 1"),
    "kmer_edges": (kmer_edges, f"with {DOC}, {KMER.format(5)}, e as (select kmer[1:5] as a, kmer[2:6] as b, count(*) as w from k group by 1, 2) select a, count(*) as out_degree, cast(sum(w) as bigint) as weight from e group by 1"),
    "context_counts": (context_counts, f"with {DOC}, {KMER.format(2)} select least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as context, count(*) as n from k group by 1"),
    "gc_by_document": (gc_by_document, f"with {DOC} select doc_id, round(length(regexp_replace(s, '[^GC]', '', 'g'))::double / nullif(length(s), 0), 9) as gc from d"),
    "proteins": (proteins, PROTEIN_SQL),
    "index_summary": (index_summary, f"""with {E.sql_intervals()} select contig, count(*) as n, round(avg("end" - start), 6) as mean, round(var_samp("end" - start), 6) as variance from intervals group by 1"""),
    "speaker_runs": (speaker_runs, RUNS_SQL),
}
