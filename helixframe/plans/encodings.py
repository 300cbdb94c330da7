"""Reads, variants, intervals and counts as views of the relational test tables.

The column expressions are texts that Spark and DuckDB read alike, so that a query and its SQL see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FLAG = """(case when l_returnflag <> 'N' then 1 else 0 end) + (case when l_returnflag <> 'N' and l_linestatus = 'O' then 2 else 0 end)
 + (case when l_linenumber = 7 and l_partkey % 3 = 0 then 4 else 0 end) + (case when l_returnflag <> 'N' and l_linenumber = 6 then 8 else 0 end)
 + (case when l_partkey % 2 = 1 then 16 else 0 end) + (case when l_returnflag <> 'N' and l_linenumber % 2 = 1 then 64 else 0 end)
 + (case when l_returnflag <> 'N' and l_linenumber % 2 = 0 then 128 else 0 end) + (case when l_tax > 0.075 then 256 else 0 end)
 + (case when l_discount > 0.095 then 512 else 0 end) + (case when l_quantity >= 48 then 1024 else 0 end)"""
_LEN = "cast(l_quantity as int)"
#: lineitem as aligned reads.
READS = [
    "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey as rid", "l_orderkey as name", "cast(l_suppkey % 25 as int) as contig", "l_partkey * 50 as pos", f"{_LEN} as len",
    "l_linenumber * 8 as mapq", f"cast({_FLAG} as int) as flag", "cast((l_suppkey + l_linenumber) % 25 as int) as mate_contig", "l_partkey * 50 + 300 as mate_pos", "l_returnflag as library",
    f"case l_linenumber % 4 when 0 then concat(cast({_LEN} as string), 'M') when 1 then concat('3S', cast({_LEN} as string), 'M') when 2 then concat(cast({_LEN} as string), 'M2I', cast({_LEN} as string), 'M') else concat(cast({_LEN} as string), 'M3D', cast({_LEN} as string), 'M4S') end as cigar",
    "cast(floor(l_extendedprice) as bigint) % 400 as score", "substr('ACGT', cast((l_partkey + l_linenumber) % 4 as int) + 1, 1) as base", "cast(l_partkey % 7 as int) as tile", "cast(l_partkey % 100 as int) as x", "cast(l_suppkey as int) as y",
]
#: part as variants.
VARIANTS = [
    "p_partkey as id", "cast(p_size % 25 as int) as contig", "p_partkey * 3 as pos",
    "case when p_partkey % 10 = 5 then concat(substr('ACGT', cast(p_partkey % 4 as int) + 1, 1), 'GT') else substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) end as ref",
    "case when p_partkey % 10 = 0 then concat(substr('ACGT', cast((p_partkey * 7 + p_size) % 4 as int) + 1, 1), 'ACA') else substr('ACGT', cast((p_partkey * 7 + p_size + 1) % 4 as int) + 1, 1) end as alt",
    "p_retailprice as qual", "nullif(p_size % 7, 0) as dp", "cast(p_size % 11 as double) / 10 as af", "p_brand as brand", "p_type as kind_text", "p_size as size",
    "case when p_size % 5 = 0 then null else p_type end as note",
]
#: events as intervals of seconds.
SECONDS = "cast(epoch_us(ts) // 1000000 as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*READS).withColumn("end", F.col("pos") + F.col("len"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*VARIANTS).withColumn("alts", F.array("alt"))


def intervals(spark: SparkSession, sf_dir: str, seconds: int = 600) -> DataFrame:
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("contig"), start.alias("start"), (start + seconds + F.col("event_id") % 7 * 60).alias("end"), "event_id", "event_type")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as 25 contigs' target intervals."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 25).cast("int").alias("contig"), (F.col("s_suppkey") * 400).alias("start"), (F.col("s_suppkey") * 400 + 700).alias("end"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per (customer's nation, month) as (sample, interval, count)."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    return o.groupBy(F.col("c_nationkey").alias("sample"), month.alias("interval")).agg(F.count(F.lit(1)).alias("count"))


def sql_reads() -> str:
    text = ", ".join(READS).replace("as string", "as varchar")
    return f'reads as (select *, pos + len as "end" from (select {text} from lineitem))'


def sql_variants() -> str:
    return f"variants as (select {', '.join(VARIANTS)} from part)"


def sql_intervals(seconds: int = 600) -> str:
    return f'intervals as (select cast(user_id as int) as contig, {SECONDS} as start, {SECONDS} + {seconds} + event_id % 7 * 60 as "end", event_id, event_type from events)'


SQL_TARGETS = 'targets as (select cast(s_suppkey % 25 as int) as contig, s_suppkey * 400 as start, s_suppkey * 400 + 700 as "end" from supplier)'
SQL_COUNTS = "counts as (select c_nationkey as sample, cast(year(o_orderdate) * 12 + month(o_orderdate) as int) as interval, count(*) as count from orders join customer on o_custkey = c_custkey group by all)"


def sql_merged(source: str, name: str = "merged", abutting: bool = True, keys: str = "contig") -> str:
    """CTEs that merge the intervals of a CTE."""
    op = ">" if abutting else ">="
    return f"""{name}_r as (select *, max("end") over (partition by {keys} order by start, "end" rows between unbounded preceding and 1 preceding) as reach from {source}),
 {name}_i as (select *, sum(case when reach is null or start {op} reach then 1 else 0 end) over (partition by {keys} order by start, "end" rows unbounded preceding) as island from {name}_r),
 {name} as (select {keys}, min(start) as start, max("end") as "end" from {name}_i group by {keys}, island)"""
