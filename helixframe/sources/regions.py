"""Tables laid out by place, so that a scan of regions opens their files only: the counterpart of an indexed file.

Rows lie in folders by contig and by bins of positions. A list of regions becomes a filter on the two, which Spark applies to
the folders before it opens a file, and a filter on the rows that reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 1_000_000


def write_by_place(df: DataFrame, path: str, width: int = WIDTH, end: str | None = None) -> None:
    """``df`` (contig, pos) as Parquet by contig and bin, in order inside the files. end: for rows that span positions, the column
    of their end (exclusive); the longest span is kept beside the table, as far as a scan must look back."""
    span = 1
    if end is not None:
        span = df.agg(F.max(F.col(end) - F.col("pos"))).first()[0] or 1
    rows = df.withColumn("_contig", F.col("contig").cast("string")).withColumn("_bin", F.floor(F.col("pos") / width))
    # One range of the order a task: few tasks write to a folder, and a crowded bin is shared by several.
    rows = rows.repartitionByRange("_contig", "_bin", "pos").sortWithinPartitions("_contig", "_bin", "pos")
    rows.write.mode("overwrite").partitionBy("_contig", "_bin").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(width, int(span), end or "")], "width long, span long, end string").coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def read_regions(spark: SparkSession, path: str, regions: Sequence[tuple[object, int, int]] | None = None) -> DataFrame:
    """The rows of a table of ``write_by_place`` that overlap one of the regions (contig, start, end), a bounded list; all rows
    without a list. Each row comes once, however many regions it overlaps."""
    layout = spark.read.schema("width long, span long, end string").json(f"{path}/layout").first()
    df = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    df = df.withColumn("_contig", F.col("_contig").cast("string"))
    if regions is None:
        return df.drop("_contig", "_bin")
    end = F.col(layout["end"]) if layout["end"] else F.col("pos") + 1
    tests = []
    for contig, a, b in regions:
        low, high = max(a - layout["span"] + 1, 0) // layout["width"], max(a, b - 1) // layout["width"]
        tests.append((F.col("_contig") == str(contig)) & F.col("_bin").between(low, high) & (F.col("pos") < b) & (F.col("pos") > a - layout["span"]) & (end > a))
    return df.where(reduce(lambda x, y: x | y, tests, F.lit(False))).drop("_contig", "_bin")


def spanning_regions(points: DataFrame, width: int = WIDTH, most: int = 10_000) -> list[tuple[object, int, int]]:
    """Regions that hold all points (contig, pos) of a small table, one for each bin with points: for a scan of just these places.

    More than ``most`` bins are an error: such a table is joined instead (``ranges.point_join``)."""
    bins = points.groupBy("contig", F.floor(F.col("pos") / width)).agg(F.min("pos").alias("a"), (F.max("pos") + 1).alias("b")).limit(most + 1).collect()
    if len(bins) > most:
        raise ValueError(f"points in more than {most} bins: join them instead")
    return sorted((r["contig"], r["a"], r["b"]) for r in bins)
