"""Exact duplicates: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Only 16-byte hashes and ids are shuffled for all rows, pre-aggregated on the map side. Bytes are compared as the least and
greatest text of each hash that occurs more than once, pre-aggregated too: a task sends two texts a hash at most, so a
group with a third of all rows is no hot task.

Defined results: null text counts as empty; all empty texts are one group. A null id never wins while the group has
another id; where ids repeat, all rows with the winning id carry it, so a caller that needs one row a group takes
``distinct_documents``. An empty table gives an empty table. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, written
from .filters import bit_of, bit_table, may_hold

#: Bits (a power of two) of the table that picks the texts worth comparing: by the number of shared hashes, at most 32 MB.
LEAST_BITS, MOST_BITS = 16, 28


def content_hash(text: Column) -> Column:
    """128 bits of content as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=ascii_lower, prefix: str = "") -> DataFrame:
    """``docs`` with keep_id, group_size and kept (prefixed; columns of these names are replaced).

    keep: "min" or "max" id of a group stays. normalise: the column function under which texts count as equal.
    """
    made = [prefix + x for x in ("keep_id", "group_size", "kept")]
    docs = docs.drop(*made)
    best = F.min if keep == "min" else F.max
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    folder = shared_dir(docs.sparkSession)
    groups = docs.select(F.col(id_col).alias("_id"), content_hash(norm).alias("_h")).groupBy("_h")
    groups = written(groups.agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep")), folder, "groups")
    mixed = _mixed(docs.select(F.col(id_col).alias("_id"), content_hash(norm).alias("_h"), norm.alias("_norm")), groups, folder, best)
    out = docs.withColumn("_h", content_hash(norm))
    keep_id, size = F.col("_keep"), F.col("_n")
    if mixed is None:
        out = out.join(groups, "_h", "left")
    else:  # a text that merely shares the hash of another takes the row of its own bytes
        out = out.withColumn("_norm", norm).join(groups, "_h", "left").join(mixed, ["_h", "_norm"], "left")
        keep_id, size = F.when(F.col("_own_n").isNotNull(), F.col("_own_keep")).otherwise(keep_id), F.coalesce("_own_n", "_n")
    kept = F.coalesce(F.col(id_col).eqNullSafe(keep_id), F.lit(False))
    return out.select(*[F.col(c) for c in docs.columns], *(c.alias(n) for c, n in zip((keep_id, size, kept), made, strict=True)))


def _mixed(base: DataFrame, groups: DataFrame, folder: str, best) -> DataFrame | None:
    """The bytes of all members of a group of two or more are compared by their least and greatest.

    None, but if different bytes meet under a hash: then what each text of such hashes has (_h, _norm, _own_n, _own_keep).
    """
    shared = groups.where("_n > 1")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * shared.count()).bit_length()))
    table = base.sparkSession.sparkContext.broadcast(bit_table(shared, "_h", bits))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(table.value, batch.column(3).to_numpy()))).select([0, 1, 2])

    kind = dict(base.dtypes)["_id"]
    some = base.select("_id", "_h", "_norm", bit_of(F.col("_h"), bits).alias("_bit")).mapInArrow(members, f"_id {kind}, _h binary, _norm string")
    ends = some.groupBy("_h").agg(F.min("_norm").alias("least"), F.max("_norm").alias("most"))
    differ = written(ends.where("least != most").select("_h"), folder, "differ")
    if differ.isEmpty():
        return None
    per_text = some.join(differ, "_h", "left_semi").groupBy("_h", "_norm")
    return written(per_text.agg(F.count(F.lit(1)).alias("_own_n"), best("_id").alias("_own_keep")), folder, "mixed")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of ``docs`` for each text: that of the winning id, and if several rows have this id (or none has an id) any of
    those."""
    kept = exact_groups(docs, id_col, text_col, keep, prefix="_exact_").where("_exact_kept").select(*docs.columns)
    ids = docs.groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again")
    if ids.isEmpty():
        return kept
    again = F.col(id_col).eqNullSafe(F.col("_again"))
    rows = kept.join(ids, again, "left_semi").withColumn("_h", content_hash(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))))
    return kept.join(ids, again, "left_anti").unionByName(rows.dropDuplicates([id_col, "_h"]).select(*docs.columns))
