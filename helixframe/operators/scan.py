"""Running sums, running maxima and neighbours in a long order, without a task that holds the whole order.

Rows are dealt into blocks of the order. Each block's totals, greatest values and end rows come first (pre-aggregated, a row for
each block); a window over blocks carries them on, and they join the rows, whose own windows stay inside a block. So a
chromosome, or a whole table, is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block along a contig.
WIDTH = 1 << 18


def position_block(at: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(at) / width)


def scanned(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None = None, sums: Sequence[str] = (), maxima: Sequence[str] = (), lags: Sequence[str] = (), leads: Sequence[str] = ()) -> DataFrame:
    """``df`` with, for columns named: sum_c up to and with the row (nulls count 0), max_c over all rows before it, lag_c and lead_c of the
    neighbouring rows; in ``order`` (columns, the first a position) within ``keys``.

    block: grows with the order and never parts rows that it doesn't part; by default of ``WIDTH`` positions. Keys aren't null.
    """
    by = [*keys, "_block"]
    # One exchange serves both the totals and the rows, if both read the same columns; a checksum makes the totals do so.
    # Without that, each scan of a chain would compute all scans before it twice. Rows that the join would drop for a null go
    # first, or its inferred filters would be pushed below the exchange on one side only and make two of it.
    rows = df.withColumn("_block", position_block(order[0]) if block is None else block)
    rows = rows.where(reduce(and_, [F.col(c).isNotNull() for c in by])).repartition(*by)
    hashed = [c for c, kind in df.dtypes if "map<" not in kind]
    place = F.struct(*order)
    totals = rows.groupBy(*by).agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in sums], *[F.max(c).alias(f"_max_{c}") for c in maxima],
        *[F.max_by(F.struct(c), place).alias(f"_last_{c}") for c in lags], *[F.min_by(F.struct(c), place).alias(f"_first_{c}") for c in leads], F.bit_xor(F.xxhash64(*hashed)).alias("_check"))
    over = Window.partitionBy(*keys).orderBy("_block")  # a row for each block
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.where(F.col("_check").isNotNull()).select(
        *by, *[F.sum(f"_sum_{c}").over(before).alias(f"_sum_{c}") for c in sums], *[F.max(f"_max_{c}").over(before).alias(f"_max_{c}") for c in maxima],
        *[F.lag(f"_last_{c}").over(over).alias(f"_last_{c}") for c in lags], *[F.lead(f"_first_{c}").over(over).alias(f"_first_{c}") for c in leads])
    inside = Window.partitionBy(*by).orderBy(*order)
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.lag(F.lit(1)).over(inside).isNull(), F.lead(F.lit(1)).over(inside).isNull()
    out = rows.join(carried, by)
    made = {f"sum_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.coalesce(F.col(f"_sum_{c}"), F.lit(0)) for c in sums}
    made |= {f"max_{c}": F.greatest(F.max(c).over(earlier), F.col(f"_max_{c}")) for c in maxima}
    made |= {f"lag_{c}": F.when(first, F.col(f"_last_{c}")[c]).otherwise(F.lag(c).over(inside)) for c in lags}
    made |= {f"lead_{c}": F.when(last, F.col(f"_first_{c}")[c]).otherwise(F.lead(c).over(inside)) for c in leads}
    return out.select(*df.columns, *[v.alias(k) for k, v in made.items()])


def value_block(df: DataFrame, column: str, blocks: int = 200, descending: bool = False) -> tuple[DataFrame, Column]:
    """``df`` and a block number for ``scanned`` in the order of any number column: bounds are approximate quantiles, one row of
    statistics that joins all rows as _bounds."""
    bounds = df.agg(F.percentile_approx(column, [k / blocks for k in range(1, blocks)], 1000).alias("_bounds"))
    number = F.size(F.filter("_bounds", lambda b: b < F.col(column)))
    return df.crossJoin(F.broadcast(bounds)), -number if descending else number
