"""Registered queries: each module maps names to (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> dict[str, tuple[Query, str | None]]:
    from . import calls, fields, intervals, joint, models, more, reads, somatic, tables

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (reads, intervals, calls, joint, fields, tables, models, somatic, more):
        out |= module.QUERIES
    return out
