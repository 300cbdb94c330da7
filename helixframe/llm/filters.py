"""A fixed-size bit table that tells which keys may be in a set: built by Spark, held by each executor.

Its size is a parameter and doesn't grow with the data; a full table only lets more rows through, and what it lets
through is always checked by an exact join later.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_of(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bit_table(keys: DataFrame, column: str, bits: int, hashed: bool = False) -> np.ndarray:
    """The table of 2**bits bits for the keys of a column; at most that much is collected.

    hashed: the column is an evenly spread long, whose low bits are the bit's number.
    """
    at = F.col(column).bitwiseAND((1 << bits) - 1) if hashed else bit_of(F.col(column), bits)
    words = keys.select(F.shiftright(at, 6).alias("w"), at.alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    rows = words.toArrow()
    if rows.num_rows:
        table[rows.column("w").to_numpy()] = rows.column("v").to_numpy().astype(np.int64).view(np.uint64)
    return table


def may_hold(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For bit numbers (int64): whether the table has them."""
    return (table[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1
