"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased, so punctuation and junk signs between words
don't hide a passage. Documents and benchmark items are joined on shared seeds (``min_match`` tokens in a row, as one
64-bit hash); for each pair that shares a seed, running-Karp-Rabin greedy string tiling marks the longest
non-overlapping matches again and again until none of ``min_match`` tokens is left. Whatever the order of the passages in the
document, the tiles' tokens sum up to the coverage of the item; from ``threshold`` on the document counts as
contaminated by it.

The benchmark side travels to the executors only if it is at most ``most_bytes`` of text; beyond that the seeds are joined
by Spark (a seed that very many documents share is split by adaptive execution), and texts of pairs meet by joins on the
ids. Both ways give the same rows.

Defined results: null texts count as empty; an item of fewer than ``min_match`` tokens must occur whole, one without
tokens matches nothing; of equal coverages the smallest item_id is named; repeated rows are judged each; without
documents or items nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import shared_dir, small, written

MIN_MATCH, THRESHOLD, MOST_BYTES = 5, 0.5, 8 << 20
_SIGNS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(_SIGNS).split()


_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


class Rolling:
    """Karp-Rabin values (mod 2**64) of windows of any length, each length in one pass over prefix sums."""

    def __init__(self, ids: np.ndarray):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        powers = np.full(len(x) + 1, _PRIME, np.uint64)
        powers[0] = 1
        self.sums = np.r_[np.uint64(0), np.cumsum(x * np.cumprod(powers)[:-1], dtype=np.uint64)]
        powers[1:] = _INVERSE
        self.scale = np.cumprod(powers)

    def windows(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """The values of all windows of n ids, or of those that start at ``at``."""
        if at is None:
            at = np.arange(max(0, len(self.sums) - n))
        h = (self.sums[at + n] - self.sums[at]) * self.scale[at]
        return h ^ (h >> np.uint64(29))


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    return Rolling(ids).windows(n)


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length): longest first, no token of either side in two tiles.

    Search lengths shrink: for a length, hashes of the free windows of both sides meet, each hit is checked token by token;
    all that are still free are marked in order of the document, then of the item. Work per length is linear in both, also
    for texts that repeat one word: hits aren't listed, and a window of the item that is taken is not looked at again.
    """
    tiles: list[tuple[int, int, int]] = []
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    sums_d, sums_i = Rolling(doc), Rolling(item)
    d, i = doc.tolist(), item.tolist()
    size = min(len(doc), len(item))
    while size >= min_match:
        size = _longest(sums_d, sums_i, free_d, free_i, size, min_match)
        if not size:
            break
        marked = False
        at_i, at_d = np.flatnonzero(_windows_free(free_i, size)), np.flatnonzero(_windows_free(free_d, size))
        table: dict[int, list[int]] = {}
        for k, h in zip(at_i[::-1].tolist(), sums_i.windows(size, at_i)[::-1].tolist(), strict=True):
            table.setdefault(h, []).append(k)  # the first window is the last of its list
        hashes = sums_d.windows(size, at_d)
        some = np.isin(hashes, np.fromiter(table, np.uint64, len(table)))
        stop = 0
        for b, h in zip(at_d[some].tolist(), hashes[some].tolist(), strict=True):
            starts = table[h]
            while starts and not free_i[starts[-1] : starts[-1] + size].all():
                starts.pop()
            if b < stop or not starts:
                continue
            a = starts[-1]
            if i[a : a + size] != d[b : b + size]:
                # Equal hashes of unequal windows: look on among the others.
                a = next((x for x in reversed(starts) if i[x : x + size] == d[b : b + size] and free_i[x : x + size].all()), -1)
                if a < 0:
                    continue
            tiles.append((a, b, size))
            free_i[a : a + size] = False
            free_d[b : b + size] = False
            stop, marked = b + size, True
        if not marked:  # collisions only
            size -= 1
    return tiles


def _windows_free(free: np.ndarray, size: int) -> np.ndarray:
    sums = np.r_[0, np.cumsum(free)]
    return sums[size:] - sums[:-size] == size


def _longest(sums_d: Rolling, sums_i: Rolling, free_d: np.ndarray, free_i: np.ndarray, most: int, least: int) -> int:
    """The greatest length at which free windows match (a match of n tokens holds ones of all shorter lengths), or 0."""

    def some(size: int) -> bool:
        at_i, at_d = np.flatnonzero(_windows_free(free_i, size)), np.flatnonzero(_windows_free(free_d, size))
        return bool(len(at_i) and len(at_d) and np.isin(sums_i.windows(size, at_i), sums_d.windows(size, at_d)).any())

    if most < least or not some(least):
        return 0
    low, high = least, most
    while low < high:
        mid = (low + high + 1) // 2
        if some(mid):
            low = mid
        else:
            high = mid - 1
    return low


class Benchmark:
    """Items by token ids, and their seeds."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH):
        self.min_match = min_match
        self.ids: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        self.seeds: dict[tuple[int, int], list[int]] = {}
        for item_id, text in sorted(items, key=lambda x: x[0]):
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in tokens_of(text)]
            if not words:
                continue
            n = min(min_match, len(words))
            k = len(self.items)
            self.items.append((item_id, np.array(words, np.int64), n))
            for h in set(window_hashes(self.items[k][1], n).tolist()):
                self.seeds.setdefault((n, h), []).append(k)
        self.lengths = sorted({n for n, _ in self.seeds})
        self.tables = {n: np.sort(np.array([h for m, h in self.seeds if m == n], np.uint64)) for n in self.lengths}

    def judge(self, text: str) -> tuple[int | None, float, int, int]:
        """(item, coverage, tiles, items that share a seed) of the item with the highest coverage."""
        words = tokens_of(text)
        doc = np.fromiter(map(self.ids.get, words, (0 for _ in words)), np.int64, len(words)) if words else np.zeros(0, np.int64)
        found: set[int] = set()
        known = doc > 0
        rolling = Rolling(doc) if known.any() else None
        for n in self.lengths:
            if len(doc) < n or rolling is None:
                continue
            at = np.flatnonzero(_windows_free(known, n))
            if len(at):
                h = rolling.windows(n, at)
                table = self.tables[n]
                hit = table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h
                for x in set(h[hit].tolist()):
                    found.update(self.seeds[(n, x)])
        best: tuple[int | None, float, int, int] = (None, 0.0, 0, len(found))
        for k in sorted(found):
            item_id, item, n = self.items[k]
            near = _near(doc, item, known)
            tiles = tile(near, item, n)
            coverage = sum(t[2] for t in tiles) / len(item)
            if coverage > best[1]:
                best = (item_id, coverage, len(tiles), len(found))
        return best


def _near(doc: np.ndarray, item: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The document without runs of tokens that the item doesn't have: one stands for each run, so no match joins over it."""
    has = np.isin(doc, item) & known
    keep = has | np.r_[True, has[:-1]]
    return np.where(has, doc, 0)[keep]


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, most_bytes: int = MOST_BYTES, prefix: str = "") -> DataFrame:
    """``docs`` with item_id, coverage, n_tiles, n_seeded (items that share a seed) and contaminated (prefixed; columns of
    these names are replaced)."""
    names = [prefix + x for x in ("item_id", "coverage", "n_tiles", "n_seeded", "contaminated")]
    docs = docs.drop(*names)
    items = benchmark.where("item_id is not null").select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    if size > most_bytes:
        return _joined(docs, items, min_match, threshold, names)
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in items.collect()], min_match))
    kinds = (LongType(), DoubleType(), IntegerType(), IntegerType(), BooleanType())
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in small(batches):
            done = [bench.judge(t or "") for t in batch.column(at).to_pylist()]
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            cols = [pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)]
            cols.append(pa.array([x[0] is not None and x[1] >= threshold for x in done], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _joined(docs: DataFrame, items: DataFrame, min_match: int, threshold: float, names: list[str]) -> DataFrame:
    """The same for a benchmark of any size: seeds of both sides meet in a join, then texts of the pairs."""
    folder = shared_dir(docs.sparkSession)
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), folder, "rows")
    items = items.select(F.col("item_id").alias("_item"), F.col("text").alias("_item_text"))

    def seeds(sizes_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, size, hashes = [], [], []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = tokens_of(t or "")
                    ids = np.array([hash_of(w) for w in words], np.uint64)
                    for n in sizes_of(len(words)):
                        h = np.unique(window_hashes(ids, n)).view(np.int64).tolist()
                        key += [k] * len(h)
                        size += [n] * len(h)
                        hashes += h
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(size, pa.int32()), pa.array(hashes, pa.int64())], ["k", "n", "h"])

        return run

    item_seeds = items.mapInArrow(seeds(lambda m: [min(min_match, m)] if m else []), "k long, n int, h long").select(F.col("k").alias("_item"), "n", "h")
    item_seeds = written(item_seeds, folder, "item_seeds")
    sizes = [r["n"] for r in item_seeds.select("n").distinct().collect()]  # at most min_match
    doc_seeds = rows.select("_row", "text").mapInArrow(seeds(lambda m: [n for n in sizes if n <= m]), "k long, n int, h long").select(F.col("k").alias("_row"), "n", "h")
    pairs = written(doc_seeds.join(item_seeds, ["n", "h"]).select("_row", "_item").distinct(), folder, "pairs")
    texts = pairs.join(rows.select("_row", F.col("text").alias("_doc_text")), "_row").join(items, "_item").select("_row", "_item", "_doc_text", "_item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)
            done = [Benchmark([(k, item)], min_match).judge(text or "") for k, text, item in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[1] for x in done], pa.float64()), pa.array([x[2] for x in done], pa.int32())], ["_row", "_item", "c", "t"])

    judged = texts.mapInArrow(run, "_row long, _item long, c double, t int")
    best = judged.groupBy("_row").agg(F.max(F.struct("c", (-F.col("_item")).alias("m"), "t")).alias("_b"), F.count(F.lit(1)).cast("int").alias("_n"))
    coverage = F.coalesce(F.col("_b.c"), F.lit(0.0))
    made = (F.when(coverage > 0, -F.col("_b.m")), coverage, F.when(coverage > 0, F.col("_b.t")).otherwise(0), F.coalesce("_n", F.lit(0)), coverage >= threshold)
    return rows.join(best, "_row", "left").select(*docs.columns, *(c.alias(n) for c, n in zip(made, names, strict=True)))


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)
