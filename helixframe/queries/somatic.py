"""Somatic evidence, annotation, correction, flow space, segmentation, streaming forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import annotate, cnv, correction, flow, ranges, somatic
from ..plans import encodings as E
from ..streaming import events
from .calls import W
from .reads import W as RW

TRANSCRIPTS = 'tx as (select cast(s_suppkey % 25 as int) as contig, s_suppkey * 300 as start, s_suppkey * 300 + 900 + s_suppkey % 7 * 100 as "end", s_name as transcript, s_suppkey % 3 = 0 as principal from supplier)'


def _transcripts(spark, d):
    k = F.col("s_suppkey")
    return E.table(spark, d, "supplier").select((k % 25).cast("int").alias("contig"), (k * 300).alias("start"), (k * 300 + 900 + k % 7 * 100).alias("end"), F.col("s_name").alias("transcript"), (k % 3 == 0).alias("principal"))


def transcript_overlap(spark, d):
    return annotate.best_transcript(E.variants(spark, d).select("id", "contig", "pos"), _transcripts(spark, d)).select("id", "transcript")


TX_SQL = f"""{W}, {TRANSCRIPTS}, h as (select v.id, transcript, row_number() over (partition by v.id order by principal desc, t."end" - t.start desc, transcript) as k from variants v join tx t on v.contig = t.contig and v.pos >= t.start and v.pos < t."end")
 select v.id, h.transcript from variants v left join h on v.id = h.id and h.k = 1"""


def region_classes(spark, d):
    t = _transcripts(spark, d)
    exons = t.select("contig", "start", (F.col("start") + 500).alias("end"))
    coding = t.select("contig", (F.col("start") + 200).alias("start"), "end")
    return annotate.region_class(E.variants(spark, d).select("id", "contig", "pos"), exons, coding).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


REGION_SQL = f"""{W}, {TRANSCRIPTS}, c as (select v.id, exists (select 1 from tx t where t.contig = v.contig and v.pos >= t.start and v.pos < t.start + 500) as e, exists (select 1 from tx t where t.contig = v.contig and v.pos >= t.start + 200 and v.pos < t."end") as c from variants v)
 select case when e and c then 'CDS' when e then 'UTR' when c then 'INTRON' else 'IGR' end as region, count(*) as n from c group by 1"""


def protein_changes(spark, d):
    v = E.variants(spark, d).select("id", F.substring("alt", 1, 1).alias("alt"), (F.col("id") % 30).cast("int").alias("offset"))
    c = annotate.codon_change(F.lit("ATGGCATTCGGATGACCAGTTAAACGTTGA"), F.col("offset"), F.col("alt"))
    return v.select("id", c.alias("c")).select("id", "c.ref_codon", "c.alt_codon", "c.kind")


def tabular_annotation(spark, d):
    t = E.targets(spark, d).withColumn("label", F.concat(F.lit("t"), F.col("start") % 5))
    return annotate.tabular_annotation(E.variants(spark, d).select("id", "contig", "pos"), t, ["label"]).select("id", "label")


TAB_SQL = f"""{W}, {E.SQL_TARGETS}, h as (select id, array_to_string(list_sort(list(distinct 't' || (t.start % 5))), '|') as label from variants v join targets t on v.contig = t.contig and v.pos >= t.start and v.pos < t."end" group by 1) select v.id, h.label from variants v left join h on v.id = h.id"""


def haplotype_filter(spark, d):
    v = E.variants(spark, d).select("id", F.when(F.col("id") % 7 > 0, F.col("contig")).alias("phase"), "pos", (F.col("size") / 50.0).alias("p"))
    return somatic.phased_filter(v).select("id", F.round("haplotype_p", 9).alias("haplotype_p"))


HAP_SQL = f"""{W}, v as (select id, case when id % 7 > 0 then contig end as phase, pos, size / 50.0::double as p from variants) select id, round(case when phase is not null then max(p) over (partition by phase order by pos range between 100 preceding and 100 following) else p end, 9) as haplotype_p from v"""


def combined_errors(spark, d):
    c = lambda k: F.when(F.col("size") % k != 0, (F.col("size") % k) / float(k))
    e = somatic.error_probability({"artifact": [c(3), c(4)], "germline": [c(5)]})
    return E.variants(spark, d).select("id", F.round(e, 9).alias("error"))


COMBINED_SQL = f"""{W}, v as (select id, greatest(case when size % 3 <> 0 then (size % 3) / 3.0::double end, case when size % 4 <> 0 then (size % 4) / 4.0::double end) as a, case when size % 5 <> 0 then (size % 5) / 5.0::double end as g from variants)
 select id, round(case when coalesce(a, g) is null then -1.0 else 1.0 - (1.0 - coalesce(a, 0.0)) * (1.0 - coalesce(g, 0.0)) end, 9) as error from v"""


def germline_posteriors(spark, d):
    v = E.variants(spark, d).select("id", somatic.germline_posterior((F.col("size") / 5.0 - 3.0), F.col("af") / 10.0).alias("p"))
    return v.select("id", F.round("p", 6).alias("p"))


GERMLINE_SQL = f"""{W}, v as (select id, greatest(af / 10.0, 1e-6) as f, size / 5.0::double - 3.0 as o from variants), z as (select id, (2 * f * (1 - f) + f * f) / (1 - (2 * f * (1 - f) + f * f)) / 1e-6 * pow(10.0, -o) as z from v) select id, round(z / (1.0 + z), 6) as p from z"""


def somatic_posteriors(spark, d):
    return E.variants(spark, d).select("id", F.round(somatic.posterior_error(F.col("size") / 10.0 - 2.0, F.lit(-1.0)), 9).alias("error"))


def somatic_lods(spark, d):
    v = E.variants(spark, d).select("id", (F.col("size") % 9).alias("alt_count"), (F.col("size") + 20).alias("depth"))
    return somatic.lods(v).select("id", F.round("tumor_lod", 6).alias("tumor_lod"))


def strand_artifacts(spark, d):
    r = E.reads(spark, d).groupBy("library", "contig", "pos").agg(F.count_if(F.col("flag").bitwiseAND(16) == 0).alias("forward_alt"), F.count_if(F.col("flag").bitwiseAND(16) != 0).alias("reverse_alt"))
    return somatic.strand_artifacts(r.groupBy("library", "forward_alt", "reverse_alt").agg(F.count(F.lit(1)).alias("n")), "library")


def het_sites(spark, d):
    v = E.variants(spark, d).select("id", (F.col("size") % 17 + 3).alias("ref_count"), (F.col("id") % 13).cast("int").alias("alt_count"))
    return somatic.het_sites(v).select("id", F.round("het_odds", 6).alias("het_odds"))


def pileup_correction(spark, d):
    b = E.reads(spark, d).select("contig", "pos", "rid", "base")
    return correction.correct_by_pileup(b).where("base != corrected").groupBy("contig").agg(F.count(F.lit(1)).alias("corrected"))


def kmer_correction(spark, d):
    v = E.variants(spark, d)
    base = F.repeat(F.lit("ACGTTGCAACGGATC"), 3)
    seq = F.when(F.col("id") % 20 == 0, F.concat(F.substr(base, F.lit(1), F.lit(20)), F.lit("N"), F.substr(base, F.lit(22), F.lit(24)))).otherwise(base)
    out = correction.correct_regions(v.select(F.col("contig").alias("region"), F.col("id").alias("read_id"), seq.alias("seq")))
    return out.groupBy("region").agg(F.count_if(F.col("seq") != F.col("corrected")).alias("corrected"), F.countDistinct("corrected").alias("kinds"))


def known_site_mask(spark, d):
    r = E.reads(spark, d).select("contig", "pos", "rid")
    known = E.variants(spark, d).select("contig", (F.col("pos") * 50).alias("pos"))
    return correction.known_site_mask(r, known).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


def fragment_likelihoods(spark, d):
    r = E.reads(spark, d).groupBy("name", F.col("base").alias("haplotype")).agg(F.sum(-F.col("score")).alias("likelihood"))
    return r.groupBy("haplotype").agg(F.count(F.lit(1)).alias("fragments"), F.sum("likelihood").alias("total"))


def theta_watterson(spark, d):
    v = E.variants(spark, d).select((F.col("size") % 20 + 2).alias("an"))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("an") - 1), F.lit(0.0), lambda s, k: s + 1.0 / k)
    return v.agg(F.round(F.sum(1.0 / harmonic), 6).alias("theta"), F.count(F.lit(1)).alias("n_sites"))


def kernel_segments(spark, d):
    c = E.counts(spark, d).select(F.col("sample").alias("contig"), F.col("interval").cast("long").alias("start"), (F.col("interval") + 1).cast("long").alias("end"), F.log2(F.col("count").cast("double")).alias("log2_ratio"))
    return cnv.kernel_segments(c)


def segment_posteriors(spark, d):
    c = E.counts(spark, d).select("sample", (F.col("interval") % 3).alias("segment"), F.log2(F.col("count").cast("double")).alias("log2_ratio"))
    return cnv.segment_posteriors(c, ["sample", "segment"])


def index_bins(spark, d):
    i = E.intervals(spark, d)
    n = i.groupBy(F.floor(F.col("start") / 4096).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # bins of one index: bounded
    first = n[0]["bin"]
    counts = [0] * (n[-1]["bin"] - first + 1)
    for r in n:
        counts[r["bin"] - first] = r["n"]
    merged, width = ranges.merge_index_bins(counts, 4096)
    return spark.createDataFrame([(k, c, width) for k, c in enumerate(merged)], "bin int, n long, width int")


def flow_keys(spark, d):
    def run(batches):
        for b in batches:
            keys = [flow.to_flows(s) for s in b["s"]]
            yield pd.DataFrame({"id": b["id"], "flows": [len(k) for k in keys], "same": [flow.from_flows(k) == s for k, s in zip(keys, b["s"], strict=True)],
                                "likelihood": [round(flow.flow_likelihood(flow.flow_matrix(k, [20] * len(k)), k), 6) for k in keys]})

    s = E.variants(spark, d).select("id", F.concat("ref", F.lit("TTTGGCA"), "alt", F.lit("ACC")).alias("s"))
    return s.mapInPandas(run, "id long, flows long, same boolean, likelihood double")


def tumbling_counts(spark, d):
    return events.tumbling_counts(E.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


TUMBLING_SQL = "select cast(epoch_us(ts) // 3600000000 * 3600 as bigint) as window_start, event_type, count(*) as n from events group by all"


def session_islands(spark, d):
    s = events.session_islands(E.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end_us"), "n")


SESSION_SQL = """with l as (select user_id, epoch_us(ts) as t, lag(epoch_us(ts)) over (partition by user_id order by ts) as p from events), s as (select *, sum(case when p is null or t - p >= 21600000000 then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) as k from l)
 select user_id, cast(min(t) as bigint) as start, cast(max(t) + 21600000000 as bigint) as end_us, count(*) as n from s group by user_id, k"""

QUERIES = {
    "transcript_overlap": (transcript_overlap, TX_SQL),
    "region_classes": (region_classes, REGION_SQL),
    "protein_changes": (protein_changes, None),
    "tabular_annotation": (tabular_annotation, TAB_SQL),
    "haplotype_filter": (haplotype_filter, HAP_SQL),
    "combined_errors": (combined_errors, COMBINED_SQL),
    "germline_posteriors": (germline_posteriors, GERMLINE_SQL),
    "somatic_posteriors": (somatic_posteriors, f"{W} select id, round(1.0 / (1.0 + pow(10.0, size / 10.0::double - 2.0 - 1.0)), 9) as error from variants"),
    "somatic_lods": (somatic_lods, f"{W}, c as (select id, size % 9 as a, size + 20 as n from variants) select id, round((lgamma(a + 1.0) + lgamma(n - a + 1.0) - lgamma(n + 2.0) - a * ln(0.001) - (n - a) * ln(0.999)) / ln(10.0), 6) as tumor_lod from c"),
    "strand_artifacts": (strand_artifacts, None),
    "het_sites": (het_sites, None),
    "pileup_correction": (pileup_correction, None),
    "kmer_correction": (kmer_correction, None),
    "known_site_mask": (known_site_mask, f"{RW}, {E.sql_variants()} select contig, count(*) as n from reads r where not exists (select 1 from variants v where v.contig = r.contig and v.pos * 50 = r.pos) group by 1"),
    "fragment_likelihoods": (fragment_likelihoods, f"{RW}, f as (select name, base as haplotype, sum(-score) as l from reads group by 1, 2) select haplotype, count(*) as fragments, cast(sum(l) as bigint) as total from f group by 1"),
    "theta_watterson": (theta_watterson, f"{W}, a as (select size % 20 + 2 as an from variants), h as (select an, (select sum(1.0::double / k) from range(1, 30) g(k) where k < an) as h from a) select round(sum(1.0 / h), 6) as theta, count(*) as n_sites from h"),
    "kernel_segments": (kernel_segments, None),
    "segment_posteriors": (segment_posteriors, None),
    "index_bins": (index_bins, None),
    "flow_keys": (flow_keys, None),
    "tumbling_counts": (tumbling_counts, TUMBLING_SQL),
    "session_islands": (session_islands, SESSION_SQL),
}
