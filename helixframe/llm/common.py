"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and blanks of every word-based operator here: only ASCII blanks separate words.
BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null text is empty), whatever else the table holds."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int, pick: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is pick; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == pick, F.lit(False))


#: Shared folders handed out by this process, oldest first.
_FOLDERS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Only a local session may do without that
    setting (a temporary folder then stands in for it); on a cluster executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(base)
    _FOLDERS.append(f"{base.rstrip('/')}/helixframe-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a shared folder whose tables are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes the shared folders that were handed out inside, at the end: for callers that have written their result by then."""
    begin = len(_FOLDERS)
    yield
    for folder in _FOLDERS[begin:]:
        dropped(spark, folder)
    del _FOLDERS[begin:]


def small(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in slices of a few rows, so that a worker never holds more than these as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def batches_of(rows: Iterator, most_bytes: int, size) -> Iterator[list]:
    """Rows in lists of at most ``most_bytes`` (one row may be larger)."""
    held: list = []
    total = 0
    for row in rows:
        n = size(row)
        if held and total + n > most_bytes:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held
