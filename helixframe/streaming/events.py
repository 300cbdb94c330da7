"""Streaming forms: tumbling counts, interval merge by sessions, duplicates within a watermark. Same rows as in batch once the
stream has ended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events per window and key."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n")


def session_islands(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Runs of events of a key with less than ``gap`` between them: the streaming form of interval merging."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: tuple[str, ...] = ("event_id",), late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def stitched_blocks(blocks: DataFrame, idle: str = "1 minute") -> DataFrame:
    """Blocks (key, start, end, band, gq) that arrive in order within a key, as a stream: touching ones of one band become one
    (key, start, end, band, min_gq, n_blocks). The open block of a key is its state; it is given out when a block comes that
    doesn't touch it, or when the key has been idle for ``idle``."""

    def stitch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns, out = ["key", "start", "end", "band", "min_gq", "n_blocks"], []
        held = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *held)], columns=columns)
            return
        rows = pd.concat(list(parts)).sort_values(["start", "end"])
        for r in rows.itertuples(index=False):
            if held and held[1] == r.start and held[2] == r.band:
                held = [held[0], int(r.end), held[2], min(held[3], int(r.gq)), held[4] + 1]
                continue
            if held:
                out.append((key[0], *held))
            held = [int(r.start), int(r.end), int(r.band), int(r.gq), 1]
        state.update(tuple(held))
        state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=columns)

    kind = dict(blocks.dtypes)["key"]
    result = f"key {kind}, start long, end long, band int, min_gq int, n_blocks long"
    grouped = blocks.select("key", F.col("start").cast("long"), F.col("end").cast("long"), F.col("band").cast("int"), F.col("gq").cast("int")).groupBy("key")
    return grouped.applyInPandasWithState(stitch, result, "start long, end long, band int, min_gq int, n_blocks long", "append", GroupStateTimeout.ProcessingTimeTimeout)
