"""Interval algebra, overlap joins, sorting, blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gvcf, ranges
from ..plans import encodings as E

W = "with " + E.sql_intervals()
M = f"{W}, {E.sql_merged('intervals')}"


def interval_merge(spark, d):
    return ranges.merge(E.intervals(spark, d), abutting=False)


def interval_merge_abutting(spark, d):
    return ranges.merge(E.intervals(spark, d))


def _halves(spark, d):
    i = E.intervals(spark, d)
    return i.where("event_id % 2 = 0").select("contig", "start", "end"), i.where("event_id % 2 = 1").select("contig", "start", "end")


HALVES = f"""{W}, a0 as (select contig, start, "end" from intervals where event_id % 2 = 0), b0 as (select contig, start, "end" from intervals where event_id % 2 = 1), {E.sql_merged('a0', 'a')}, {E.sql_merged('b0', 'b')}"""


def interval_intersect(spark, d):
    return ranges.intersect(*_halves(spark, d))


def interval_subtract(spark, d):
    return ranges.subtract(*_halves(spark, d))


SUBTRACT_SQL = f"""{HALVES}, e as (select contig, p, sum(x) as x, sum(y) as y from (select contig, start as p, 1 as x, 0 as y from a union all select contig, "end", -1, 0 from a union all select contig, start, 0, 1 from b union all select contig, "end", 0, -1 from b) group by all),
 s as (select contig, p as start, lead(p) over w as "end", sum(x) over w as x, sum(y) over w as y from e window w as (partition by contig order by p)),
 k as (select contig, start, "end" from s where x > 0 and y = 0 and "end" is not null), {E.sql_merged('k', 'm')} select * from m"""


def interval_pad(spark, d):
    return ranges.pad(ranges.merge(E.intervals(spark, d)), 3600)


PAD_SQL = f"""{M}, n as (select *, lag("end") over w as b, lead(start) over w as a from merged window w as (partition by contig order by start, "end"))
 select contig, cast(case when b <= start and start - b < 7200 then b + (start - b) // 2 else greatest(start - 3600, 0) end as bigint) as start,
 cast(case when a >= "end" and a - "end" < 7200 then "end" + (a - "end") // 2 else "end" + 3600 end as bigint) as "end" from n"""


def interval_bins(spark, d):
    return ranges.fixed_bins(ranges.merge(E.intervals(spark, d)), 300)


BINS_SQL = f"""{M} select contig, s as start, least(s + 300, "end") as "end" from (select *, unnest(range(start, "end", 300)) as s from merged)"""


def interval_territory(spark, d):
    return ranges.territory(E.intervals(spark, d))


def scatter_count(spark, d):
    s = ranges.scatter(ranges.merge(E.intervals(spark, d)), 8)
    return s.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


SCATTER_SQL = f"""{M}, c as (select *, sum("end" - start) over (order by contig, start, "end" rows unbounded preceding) - ("end" - start) / 2.0 as mid, sum("end" - start) over () as total from merged)
 select cast(least(floor(mid * 8 / total), 7) as int) as shard, count(*) as n, cast(sum("end" - start) as bigint) as bases from c group by 1"""


def overlap_join(spark, d):
    a, b = (x.withColumn("k", F.lit(k)) for k, x in enumerate(_halves(spark, d)))
    p = ranges.overlap_join(a, b, 600)
    n = F.least("end", "end_r") - F.greatest("start", "start_r")
    return p.groupBy("contig").agg(F.count(F.lit(1)).alias("pairs"), F.sum(n).alias("bases"))


OVERLAP_SQL = f"""{HALVES} select x.contig, count(*) as pairs, cast(sum(least(x."end", y."end") - greatest(x.start, y.start)) as bigint) as bases from a0 x join b0 y on x.contig = y.contig and x.start < y."end" and y.start < x."end" group by 1"""


def overlap_semi(spark, d):
    i = E.intervals(spark, d)
    return ranges.overlap_join(i.where("event_type = 'purchase'"), i.where("event_type = 'error'"), 600, "left_semi").select("event_id", "contig", "start")


def overlap_anti(spark, d):
    i = E.intervals(spark, d)
    return ranges.overlap_join(i.where("event_type = 'purchase'"), i.where("event_type = 'error'"), 600, "left_anti").select("event_id", "contig", "start")


SEMI = """ select event_id, contig, start from intervals x where event_type = 'purchase' and {0} exists (select 1 from intervals y where y.event_type = 'error' and x.contig = y.contig and x.start < y."end" and y.start < x."end")"""


def output_modes(spark, d):
    a, b = _halves(spark, d)
    p = ranges.overlap_join(a, ranges.merge(b), 600)
    return p.groupBy("contig").agg(*[F.count_if(c()).alias(n) for n, c in ranges.OUTPUT_MODES.items()])


MODES_SQL = f"""{HALVES} select x.contig, count(*) as overlaps, count(*) filter (x.start >= y.start and x.start < y."end") as starts_in, count(*) filter (x."end" > y.start and x."end" <= y."end") as ends_in,
 count(*) filter (x.start >= y.start and x."end" <= y."end") as contained from a0 x join b y on x.contig = y.contig and x.start < y."end" and y.start < x."end" group by 1"""


def track_annotation(spark, d):
    a, b = _halves(spark, d)
    bins = ranges.fixed_bins(ranges.merge(a), 300)
    track = ranges.merge(b).withColumn("score", (F.col("start") % 10).cast("double"))
    return ranges.annotate_weighted(bins, track, "score").withColumn("mean_score", F.round("mean_score", 9))


TRACK_SQL = f"""{HALVES}, n as (select contig, s as start, least(s + 300, "end") as "end" from (select *, unnest(range(start, "end", 300)) as s from a)),
 o as (select n.contig, n.start, n."end", sum((least(n."end", b."end") - greatest(n.start, b.start)) * cast(b.start % 10 as double)) as s from n join b on n.contig = b.contig and n.start < b."end" and b.start < n."end" group by all)
 select n.contig, n.start, n."end", round(coalesce(s / (n."end" - n.start), 0.0), 9) as mean_score from n left join o on n.contig = o.contig and n.start = o.start and n."end" = o."end" """


def sort_coordinate_topn(spark, d):
    r = E.reads(spark, d)
    top = r.orderBy("contig", "pos", "flag", "rid").limit(1000).select("contig", "pos", "flag", "rid")
    return top.withColumn("rn", F.row_number().over(Window.orderBy("contig", "pos", "flag", "rid")))


def sort_queryname(spark, d):
    r = E.reads(spark, d)
    w = Window.partitionBy("name").orderBy(F.col("flag").bitwiseAND(1).asc(), F.col("flag").bitwiseAND(128).asc(), F.col("flag").bitwiseAND(16).asc(), F.col("flag").bitwiseAND(256).asc(), "rid")
    return r.select("name", "rid", F.row_number().over(w).alias("rn"))


RW = "with " + E.sql_reads()


def gathered_shards(spark, d):
    r = E.reads(spark, d).select("contig", "pos", "rid")
    shards = [r.where(F.col("contig") % 3 == k) for k in range(3)]
    all_ = shards[0].unionByName(shards[1]).unionByName(shards[2])
    w = Window.partitionBy("contig").orderBy("pos", "rid")
    return all_.withColumn("_p", F.lag("pos").over(w)).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_if(F.col("_p") == F.col("pos")).alias("same_start"))


GATHER_SQL = f"""{RW}, l as (select *, lag(pos) over (partition by contig order by pos, rid) as p from reads) select contig, count(*) as n, min(pos) as first, max(pos) as last, count(*) filter (p = pos) as same_start from l group by contig"""


def _blocks(spark, d):
    e = E.intervals(spark, d)
    m = ranges.fixed_bins(ranges.merge(e), 120)
    return m.select(F.col("contig").alias("sample"), F.lit(0).alias("contig"), "start", "end", (F.col("start") / 120 % 9 * 12).cast("int").alias("gq"), (F.col("start") % 50).cast("int").alias("dp"))


BLOCKS = f"""{M}, blocks as (select contig as sample, 0 as contig, start, "end", cast(floor((start / 120.0 - 9 * floor(start / 1080.0)) * 12) as int) as gq, cast(start % 50 as int) as dp from (select contig, s as start, least(s + 120, "end") as "end" from (select *, unnest(range(start, "end", 120)) as s from merged)))"""
BAND = "(case when gq <= 60 then gq when gq < 70 then 60 when gq < 80 then 61 when gq < 90 then 62 when gq < 99 then 63 else 64 end)"


def gvcf_banding(spark, d):
    b = _blocks(spark, d)
    return b.groupBy(gvcf.band(F.col("gq")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def reference_block_merge(spark, d):
    return gvcf.merge_blocks(_blocks(spark, d))


BLOCK_MERGE_SQL = f"""{BLOCKS}, n as (select *, {BAND} as band, lag("end") over w as pe, lag({BAND}) over w as pb from blocks window w as (partition by sample, contig order by start)),
 r as (select *, sum(case when pe is null or pe <> start or pb <> band then 1 else 0 end) over (partition by sample, contig order by start rows unbounded preceding) as run from n)
 select sample, contig, min(start) as start, max("end") as "end", cast(min(band) as int) as band, min(gq) as min_gq, cast(floor(median(dp) + 0.5) as int) as dp, count(*) as n_blocks from r group by sample, contig, run"""


def block_split(spark, d):
    e = E.intervals(spark, d)
    blocks = ranges.merge(e.where("event_type <> 'purchase'"))
    cut = gvcf.split_at_variants(blocks, e.where("event_type = 'purchase'").select("contig", "start", (F.col("start") + 90).alias("end")))
    return cut.groupBy("contig").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("bases"))


SPLIT_SQL = f"""{W}, a0 as (select contig, start, "end" from intervals where event_type <> 'purchase'), b0 as (select contig, start, start + 90 as "end" from intervals where event_type = 'purchase'), {E.sql_merged('a0', 'a', True)}, {E.sql_merged('b0', 'b', True)},
 e as (select contig, p, sum(x) as x, sum(y) as y from (select contig, start as p, 1 as x, 0 as y from a union all select contig, "end", -1, 0 from a union all select contig, start, 0, 1 from b union all select contig, "end", 0, -1 from b) group by all),
 s as (select contig, p as start, lead(p) over w as "end", sum(x) over w as x, sum(y) over w as y from e window w as (partition by contig order by p)),
 k as (select contig, start, "end" from s where x > 0 and y = 0 and "end" is not null), {E.sql_merged('k', 'm')} select contig, count(*) as pieces, cast(sum("end" - start) as bigint) as bases from m group by contig"""


QUERIES = {
    "interval_merge": (interval_merge, f"{W}, {E.sql_merged('intervals', abutting=False)} select * from merged"),
    "interval_merge_abutting": (interval_merge_abutting, f"{M} select * from merged"),
    "interval_intersect": (interval_intersect, f"""{HALVES} select a.contig, greatest(a.start, b.start) as start, least(a."end", b."end") as "end" from a join b on a.contig = b.contig and a.start < b."end" and b.start < a."end" """),
    "interval_subtract": (interval_subtract, SUBTRACT_SQL),
    "interval_pad": (interval_pad, PAD_SQL),
    "interval_bins": (interval_bins, BINS_SQL),
    "interval_territory": (interval_territory, f"""{M} select contig, cast(sum("end" - start) as bigint) as bases from merged group by contig"""),
    "scatter_count": (scatter_count, SCATTER_SQL),
    "overlap_join": (overlap_join, OVERLAP_SQL),
    "overlap_semi": (overlap_semi, W + SEMI.format("")),
    "overlap_anti": (overlap_anti, W + SEMI.format("not")),
    "output_modes": (output_modes, MODES_SQL),
    "track_annotation": (track_annotation, TRACK_SQL),
    "sort_coordinate_topn": (sort_coordinate_topn, f"{RW}, t as (select contig, pos, flag, rid, cast(row_number() over (order by contig, pos, flag, rid) as int) as rn from reads) select * from t where rn <= 1000"),
    "sort_queryname": (sort_queryname, f"{RW} select name, rid, cast(row_number() over (partition by name order by flag & 1, flag & 128, flag & 16, flag & 256, rid) as int) as rn from reads"),
    "gathered_shards": (gathered_shards, GATHER_SQL),
    "gvcf_banding": (gvcf_banding, f"""{BLOCKS} select cast({BAND} as int) as band, count(*) as n, cast(sum("end" - start) as bigint) as bases from blocks group by 1"""),
    "reference_block_merge": (reference_block_merge, BLOCK_MERGE_SQL),
    "block_split": (block_split, SPLIT_SQL),
}
