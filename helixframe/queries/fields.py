"""Field tables, genotype labels, alternates, resources, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genotype, ranges, recal, validate, variants as V
from ..plans import encodings as E
from ..sources.text import rotated
from .calls import W


def _genotypes(v):
    make = lambda s, a, b, q: F.struct(F.lit(s).alias("sample"), F.array(a.cast("int"), b.cast("int")).alias("gt"), q.cast("int").alias("gq"), F.col("dp").cast("int").alias("dp"), F.array(F.col("size"), F.col("size") % 5).alias("ad"), F.array(F.lit(0), q.cast("int"), F.lit(99)).alias("pl"), F.lit(None).cast("string").alias("ft"))
    return v.withColumn("genotypes", F.array(make("s1", F.col("size") % 2, F.col("id") % 2, F.col("size") * 2), make("s2", F.col("size") % 3 - 1, F.lit(0), F.col("id") % 60)))


def info_wildcards(spark, d):
    v = E.variants(spark, d)
    info = F.map_from_arrays(F.array(F.lit("AC_x"), F.lit("AC_a"), F.lit("DP")), F.array(F.array(F.col("size").cast("string")), F.array(F.lit("1"), (F.col("size") % 3).cast("string")), F.array(F.lit("9"))))
    return v.withColumn("info", info).select("id", V.info_wildcard(F.col("info"), "AC_").alias("ac"), V.info_wildcard(F.col("info"), "ZZ").alias("zz"))


def genotype_table(spark, d):
    v = V.genotype_fields(_genotypes(E.variants(spark, d)), ["gt", "gq", "dp", "ad"], ["s1", "s2"])
    return v.select("id", *[F.col(f"`{s}.{f}`").alias(f"{s}_{f}") for s in ("s1", "s2") for f in ("gt", "gq", "dp", "ad")])


GENOTYPES_SQL = f"""{W} select id, (size % 2)::varchar || '/' || (id % 2)::varchar as s1_gt, (size * 2)::varchar as s1_gq, coalesce(dp::varchar, 'NA') as s1_dp, size::varchar || ',' || (size % 5)::varchar as s1_ad,
 (case when size % 3 - 1 < 0 then '.' else (size % 3 - 1)::varchar end) || '/0' as s2_gt, (id % 60)::varchar as s2_gq, coalesce(dp::varchar, 'NA') as s2_dp, size::varchar || ',' || (size % 5)::varchar as s2_ad from variants"""


def genotype_filter_labels(spark, d):
    g = V.genotype_labels(F.col("genotypes"), {"LowGQ": lambda x: x["gq"] < 20, "LowDP": lambda x: x["dp"] < 3}, no_call=True)
    v = _genotypes(E.variants(spark, d)).withColumn("g", F.explode(g))
    return v.select("id", F.col("g.sample").alias("sample"), F.col("g.ft").alias("ft"), F.array_join(F.transform("g.gt", lambda a: a.cast("string")), "/").alias("gt"))


GLABEL_SQL = f"""{W}, g as (select id, 's1' as sample, size * 2 as gq, dp, (size % 2)::varchar || '/' || (id % 2)::varchar as gt from variants union all select id, 's2', id % 60, dp, (size % 3 - 1)::varchar || '/0' from variants),
 l as (select *, array_to_string(list_filter([case when coalesce(dp < 3, false) then 'LowDP' end, case when gq < 20 then 'LowGQ' end], lambda x: x is not null), ';') as f from g) select id, sample, case when f = '' then 'PASS' else f end as ft, case when f = '' then gt else '-1/-1' end as gt from l"""


def unused_alternates(spark, d):
    v = E.variants(spark, d).select("id", F.array("alt", F.lit("<DEL>"), F.lit("*")).alias("alts"), F.array(F.array(F.lit(0), F.col("size") % 4), F.array((F.col("id") % 3).cast("int"), F.lit(-1))).alias("gts"))
    u = V.drop_unused_alternates(v)
    return u.select("id", F.array_join("alts", ",").alias("alts"), F.array_join(F.transform(F.flatten("gts"), lambda a: a.cast("string")), "/").alias("gt"))


UNUSED_SQL = f"""{W}, g as (select id, [alt, '<DEL>', '*'] as alts, [0, size % 4, cast(id % 3 as int), -1] as gt from variants), u as (select *, list_filter([1, 2, 3], lambda k: list_contains(gt, k)) as u from g)
 select id, array_to_string(list_transform(u, lambda k: alts[k]), ',') as alts, array_to_string(list_transform(gt, lambda a: case when a > 0 then list_position(u, a) else a end), '/') as gt from u"""


def top_alternates(spark, d):
    v = E.variants(spark, d).select("contig", F.col("id").alias("alt_index"), (F.col("size") % 17).alias("score"))
    return V.top_alternates(v, 6, ["contig"])


TOP_SQL = f"""{W}, r as (select contig, id as alt_index, size % 17 as score, row_number() over (partition by contig order by size % 17 desc, id) as k from variants) select contig, alt_index, score, cast(row_number() over (partition by contig order by alt_index) as int) as new_index from r where k <= 6"""


def resource_annotation(spark, d):
    v = E.variants(spark, d)
    r = v.where("id % 4 = 0").withColumn("alts", F.when(F.col("id") % 8 == 0, F.array(F.lit("Z"))).otherwise(F.col("alts")))
    return V.annotate_from(v, r, ["qual"]).select("id", "resource_qual", "in_resource")


def cardinality_issues(spark, d):
    v = E.variants(spark, d)
    values = F.when(F.col("size") % 6 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("size") % 7 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1)))
    return v.agg(*[F.count_if(V.cardinality_errors(values, n, F.col("alts"))).alias(f"n_{n}") for n in ("1", "A", "R", "G", "3")])


CARD = "case when size % 6 = 0 then 2 when size % 7 = 0 then 3 else 1 end"


def reference_confidences(spark, d):
    v = E.variants(spark, d).select("id", F.array_repeat(F.lit(30), F.col("size") % 9).alias("r"), F.array_repeat(F.lit(20), F.col("size") % 4).alias("a"))
    return v.select("id", F.array_join(genotype.reference_confidence(F.col("r"), F.col("a")), ",").alias("pl"))


def _reference(spark, d):
    docs = E.table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("contig"), F.rpad(F.substring(F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", ""), 1, 60), 60, "N").alias("seq"))
    return docs.select("contig", F.lit(0).cast("long").alias("start"), "seq")


REFERENCE = "ref as (select cast(doc_id as int) as contig, rpad(substr(regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g'), 1, 60), 60, 'N') as seq from documents)"


def reference_snps(spark, d):
    a = _reference(spark, d)
    b = a.withColumn("seq", F.translate("seq", "G", "T"))
    return validate.reference_differences(a, b).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def alternate_reference(spark, d):
    r = _reference(spark, d)
    snps = r.select("contig", (F.col("contig") % 60).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("t").alias("alt"))
    return V.apply_to_reference(r, snps).select("contig", "seq")


def rotated_reference(spark, d):
    return _reference(spark, d).select("contig", rotated(F.col("seq"), F.col("contig") % 61).alias("seq"))


def known_bins(spark, d):
    r = _reference(spark, d)
    bins = r.select("contig", F.explode(F.array(*[F.lit(k * 20).cast("long") for k in range(3)])).alias("start")).withColumn("end", F.col("start") + 20)
    return ranges.drop_unknown_bins(bins, r)


def _whole_reference(spark, d):
    docs = E.table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("contig"), F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "").alias("seq"))
    return docs.select("contig", F.lit(0).cast("long").alias("start"), "seq").where("seq != ''")


WHOLE = "ref as (select * from (select cast(doc_id as int) as contig, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') as seq from documents) where seq <> '')"


def whole_reference_snps(spark, d):
    a = _whole_reference(spark, d)
    return validate.reference_differences(a, a.withColumn("seq", F.translate("seq", "G", "T"))).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def whole_alternate_reference(spark, d):
    r = _whole_reference(spark, d)
    snps = r.select("contig", (F.col("contig").cast("long") * 7919 % F.length("seq")).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("t").alias("alt"))
    return V.apply_to_reference(r, snps).select("contig", "seq")


def whole_rotated_reference(spark, d):
    return _whole_reference(spark, d).select("contig", rotated(F.col("seq"), F.col("contig").cast("long") * 7919 % F.length("seq")).alias("seq"))


def whole_known_bins(spark, d):
    r = _whole_reference(spark, d).withColumn("seq", F.translate("seq", "G", "N"))
    bins = r.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long") - 1, F.lit(20).cast("long"))).alias("start")).withColumn("end", F.col("start") + 20)
    return ranges.drop_unknown_bins(bins, r)


def quantized_qualities(spark, d):
    counts = {r["q"]: r["n"] for r in E.reads(spark, d).groupBy(F.col("mapq").alias("q")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per quality
    levels = recal.quantize([counts.get(q, 0) for q in range(94)])
    return spark.createDataFrame(list(enumerate(levels)), "quality int, level int")


QUERIES = {
    "info_wildcards": (info_wildcards, f"{W} select id, 'AC_a=1,' || (size % 3)::varchar || ';AC_x=' || size::varchar as ac, 'NA' as zz from variants"),
    "genotype_table": (genotype_table, GENOTYPES_SQL),
    "genotype_filter_labels": (genotype_filter_labels, GLABEL_SQL),
    "unused_alternates": (unused_alternates, UNUSED_SQL),
    "top_alternates": (top_alternates, TOP_SQL),
    "resource_annotation": (resource_annotation, f"{W} select id, case when id % 4 = 0 and id % 8 <> 0 then qual end as resource_qual, id % 4 = 0 and id % 8 <> 0 as in_resource from variants"),
    "cardinality_issues": (cardinality_issues, f'{W} select count(*) filter ({CARD} <> 1) as "n_1", count(*) filter ({CARD} <> 1) as "n_A", count(*) filter ({CARD} <> 2) as "n_R", count(*) filter ({CARD} <> 3) as "n_G", count(*) filter ({CARD} <> 3) as "n_3" from variants'),
    "reference_confidences": (reference_confidences, None),
    "reference_snps": (reference_snps, f"with {REFERENCE}, p as (select contig, unnest(range(0, 60)) as pos, seq from ref) select contig, count(*) as n, min(pos) as first from p where seq[pos + 1] = 'G' group by 1"),
    "alternate_reference": (alternate_reference, f"with {REFERENCE} select contig, substr(seq, 1, contig % 60) || 't' || substr(seq, contig % 60 + 2) as seq from ref"),
    "rotated_reference": (rotated_reference, f"with {REFERENCE} select contig, substr(seq, contig % 61 % 60 + 1) || substr(seq, 1, contig % 61 % 60) as seq from ref"),
    "known_bins": (known_bins, f'with {REFERENCE}, b as (select contig, seq, unnest([0, 20, 40])::bigint as start from ref) select contig, start, start + 20 as "end" from b where regexp_matches(substr(seq, start + 1, 20), \'[ACGT]\')'),
    "whole_reference_snps": (whole_reference_snps, f"with {WHOLE}, p as (select contig, unnest(range(0, length(seq))) as pos, seq from ref) select contig, count(*) as n, min(pos) as first, max(pos) as last from p where seq[pos + 1] = 'G' group by 1"),
    "whole_alternate_reference": (whole_alternate_reference, f"with {WHOLE}, p as (select *, contig::bigint * 7919 % length(seq) as k from ref) select contig, substr(seq, 1, k) || 't' || substr(seq, k + 2) as seq from p"),
    "whole_rotated_reference": (whole_rotated_reference, f"with {WHOLE}, p as (select *, contig::bigint * 7919 % length(seq) as k from ref) select contig, substr(seq, k + 1) || substr(seq, 1, k) as seq from p"),
    "whole_known_bins": (whole_known_bins, f'with {WHOLE}, b as (select contig, translate(seq, \'G\', \'N\') as seq, unnest(range(0, length(seq), 20))::bigint as start from ref) select contig, start, start + 20 as "end" from b where regexp_matches(substr(seq, start + 1, 20), \'[ACGT]\')'),
    "quantized_qualities": (quantized_qualities, None),
}
