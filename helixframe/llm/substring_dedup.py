"""Repeated substrings across documents, found by sorting suffixes with a difference cover.

A byte goes if some ``length``-byte string that covers it also starts earlier (smaller document, or earlier in the same
document). Sorting all suffixes of the corpus would shuffle many times the input, so the text is reduced first, without
loss:

* Every ``length``-byte window has one anchor, the smallest hash of its 32-byte strings (leftmost of equals), which
  depends on the window's bytes alone. Windows with the same anchor form a run; equal windows have equal anchors.
* A window can only be repeated if its anchor is. A first pass counts anchors (pre-aggregated in each task, then by
  Spark); a fixed-size bit table of repeated ones filters the second pass, whose rows are joined exactly afterwards.
* Runs that are equal as a whole need no sorting: all but the first are repeated. What is left is one copy of each distinct
  run whose anchor also has other runs.
* Those runs are dealt out by anchor, and each task sorts the suffixes of its runs with a difference cover modulo 3
  (``suffix_order``): triples at sampled positions are sorted and named, the names are sorted recursively, the remaining
  suffixes are merged in by their first byte and the rank of the next suffix. Neighbours in that order with ``length``
  equal bytes are one class of windows; all but the first of a class are repeated.
* Anchors with more than ``HOT`` distinct runs would make a task large. Their windows are dealt out by 128-bit content hash
  instead, in blocks of eight at fixed distances from the anchor: equal blocks are repeated as a whole, and single
  windows are compared only in blocks whose common bytes other blocks share. Firsts are pre-aggregated minima: same result,
  any skew.

Defined results: null text counts as empty; texts shorter than ``length`` keep all bytes; rows whose id is null are left
whole (they have no place in the order); of rows with equal ids and different texts the text's hash orders them; rows that
repeat id and text share one place, so all of them get the same result and none is a repeat of another; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small, written
from .filters import bit_table, may_hold

LENGTH, GRAM, HOT, BITS = 100, 32, 256, 27
#: Window starts of a text that are worked on at a time.
PIECE = 4 << 20
#: Bytes of texts that are worked on together.
TOGETHER = 64 << 10
#: Bytes of runs whose suffixes are sorted together (an anchor has at most HOT short runs).
TOGETHER_SORTED = 3 << 20
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.uint64(0xFFFFFF)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M1 + b) * _M2
    x ^= x >> np.uint64(29)
    return x


def runs_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, of texts in order: (number of the text, anchor hash, content hash, first window,
    number of windows, the anchor's distance from the first)."""
    parts: list[tuple] = []
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def work() -> None:
        nonlocal held, total
        if held:
            parts.append(_runs(held, length))
        held, total = [], 0

    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = text[at : at + PIECE + length - 1]
            if total + len(piece) > TOGETHER:
                work()
            held.append((number, at, piece))
            total += len(piece)
    work()
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    size = np.array([len(t) for _, _, t in pieces])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    h = (np.frombuffer(b"".join(t for _, _, t in pieces), np.uint8).astype(np.uint64) + np.uint64(1)) * _M1
    for s in (1, 2, 4, 8, 16):
        h = _mix(h[:-s], h[s:])
    # The smallest of length - GRAM + 1 hashes, leftmost of equals: 40 bits of hash, then the place.
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if span > width:
        key = np.minimum(key[: -(span - width)], key[span - width :])
    # Windows that lie in one piece, and where their anchors change.
    count = size - length + 1
    window = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    place = (key[window] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])
    first, count = window[new], np.diff(np.r_[new, len(window)])
    # The run's bytes, first .. first + count - 1 + length, are covered by three 64-byte hashes (two spans overlap or meet).
    h64 = _mix(h[:-GRAM], h[GRAM:])
    stop = first + count - 1 + length
    whole = _mix(_mix(h64[first], h64[(first + stop - 64) // 2]), h64[stop - 64] + (stop - first).astype(np.uint64) * _M3)
    anchor = place[new]
    piece = np.searchsorted(begin, first, "right") - 1
    number, offset = np.array([x[0] for x in pieces]), np.array([x[1] for x in pieces])
    # The place of the anchor in the run belongs to what must be equal.
    return number[piece], h[anchor], whole ^ ((anchor - first).astype(np.uint64) * _M2), first - begin[piece] + offset[piece], count, anchor - first


def suffix_order(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of a sequence of positive integers by difference cover (0 stands for the end).

    depth: how many leading symbols of the order are needed; recursion ends when names cover them.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.asarray(s, np.int64)
    z = np.r_[s, 0, 0, 0]
    # Sampled positions 1 and 2 mod 3 (position n too if n % 3 == 1, so that the two halves are kept apart).
    p1, p2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    p = np.r_[p1, p2]
    order, new = _triple_order(z[p], z[p + 1], z[p + 2])
    t, names = p[order], np.cumsum(new)
    if names[-1] == len(p) or (depth is not None and depth <= 3):
        sampled = t
    else:
        name = np.empty(len(p), np.int64)
        name[order] = names
        sampled = p[suffix_order(name, None if depth is None else (depth + 2) // 3)]
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(z[rest] * (len(sampled) + 2) + rank[rest + 1])]
    return _merged(z, rank, sampled[sampled < n], rest)


def _triple_order(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of triples, and where in it a triple differs from the one before; one packed key if 63 bits hold it."""
    bits = int(max(a.max(), b.max(), c.max())).bit_length()
    if 3 * bits <= 63:
        key = (a << (2 * bits)) | (b << bits) | c
        order = np.argsort(key)
        key = key[order]
        return order, np.r_[True, key[1:] != key[:-1]]
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    return order, np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]


def _merged(z: np.ndarray, rank: np.ndarray, sampled: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Merge of the two sorted parts: how many sampled suffixes stand before each of ``rest``.

    A suffix at 0 mod 3 is compared with one at 1 mod 3 by a symbol and the next suffix's rank, with one at 2 mod 3 by
    two symbols and a rank; both comparisons are look-ups of packed keys in sorted ones.
    """
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    low = np.zeros(len(rest), np.int64)
    for part, symbols in ((one, 1), (two, 2)):
        if len(part) and len(rest):
            keys = [[z[at + k] for k in range(symbols)] + [rank[at + symbols]] for at in (part, rest)]
            ours, theirs = _packed(keys)
            low += np.searchsorted(np.sort(ours), theirs)
    low = np.maximum.accumulate(low)  # suffixes that are equal as far as names reach stand in any order
    out = np.empty(len(sampled) + len(rest), np.int64)
    at = low + np.arange(len(rest))
    out[at] = rest
    free = np.ones(len(out), bool)
    free[at] = False
    out[free] = sampled
    return out


def _packed(keys: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One number per tuple, in the tuples' order, for several lists of columns alike."""
    bits = [max(int(k[c].max()) for k in keys).bit_length() for c in range(len(keys[0]))]
    if sum(bits) > 63:  # names the tuples instead
        rows = [np.concatenate([k[c] for k in keys]) for c in range(len(bits))]
        order = np.lexsort(rows[::-1])
        new = np.r_[False, np.logical_or.reduce([r[order][1:] != r[order][:-1] for r in rows])]
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(new)
        cut = np.cumsum([len(k[0]) for k in keys])[:-1]
        return np.split(name, cut)
    out = []
    for k in keys:
        x = k[0].astype(np.int64)
        for c in range(1, len(bits)):
            x = (x << bits[c]) | k[c]
        out.append(x)
    return out


def repeated_windows(runs: list[bytes], first: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For texts of runs, in order of their place in the corpus: for each window (run after run) whether an equal one
    stands earlier. first: per run, where its windows start in the result."""
    # Texts are joined with an end sign between them, so an equal stretch never crosses one.
    sizes = np.array([len(r) for r in runs])
    joined = np.concatenate([np.r_[np.frombuffer(r, np.uint8).astype(np.int64) + 2, 1] for r in runs])
    base = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    order = suffix_order(joined, length)
    count = sizes - length + 1
    number = np.full(len(joined), -1, np.int64)  # of the window that starts at a place
    at = np.repeat(base, count) + np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    number[at] = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    order = order[number[order] >= 0]
    # Neighbours with equal prefixes: compared eight bytes at a time.
    same = np.ones(max(0, len(order) - 1), bool)
    raw = joined.astype(np.uint8)
    words = np.zeros(len(raw), np.uint64)
    for k in range(8):
        words[: len(raw) - k] |= raw[k:].astype(np.uint64) << np.uint64(8 * k)
    for k in [*range(0, length - 8, 8), length - 8]:
        some = np.flatnonzero(same)
        same[some] = words[order[some] + k] == words[order[some + 1] + k]
    group = np.cumsum(np.r_[True, ~same])[: len(order)] if len(order) else np.zeros(0, np.int64)
    out = np.zeros(int(count.sum()), bool)
    if len(order):
        least = np.minimum.reduceat(number[order], np.flatnonzero(np.r_[True, ~same]))
        out[number[order]] = number[order] != least[group - 1]
    return out


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of True."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    a = np.flatnonzero(edge == 1)
    return a, np.flatnonzero(edge == -1) - a


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay)."""
    folder = shared_dir(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # Rows of one id are told apart by the order of their bytes' hash.
    src = src.withColumn("sub", F.xxhash64("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            # As Spark's signed numbers, so that least and greatest mean the same here and there.
            a, w = (np.concatenate(x).view(np.int64) for x in zip(*held, strict=True))
            by = np.lexsort((w, a))
            a, w = a[by], w[by]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            n, last = np.diff(np.r_[first, len(a)]), np.r_[first[1:], len(a)] - 1
            for k in range(0, len(first), 50_000):
                f, g = first[k : k + 50_000], last[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(a[f]), pa.array(n[k : k + 50_000]), pa.array(w[f]), pa.array(w[g])], ["a", "n", "low", "high"])

        held, total = [], 0
        for batch in small(batches):
            batch = batch.filter(batch.column(0).is_valid())
            _, a, w, *_ = runs_of(batch.column(1).to_pylist(), length)
            held.append((a, w))
            total += len(a)
            if total > 1_000_000:
                yield from out(held)
                held, total = [], 0
        if total:
            yield from out(held)

    counted = src.select("doc", "text").mapInArrow(anchors, "a long, n long, low long, high long").groupBy("a")
    counted = counted.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1")
    counted = written(counted.select("a", (F.col("low") != F.col("high")).alias("mixed")), folder, "anchors")
    tables = context.broadcast((bit_table(counted, "a", BITS, True), bit_table(counted.where("mixed"), "a", BITS, True)))

    # Second pass: runs with a repeated anchor; their bytes only where runs differ.
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "w", "doc", "sub", "at", "n", "lead", "bytes"]
        repeated, mixed = tables.value
        for batch in small(batches):
            batch = batch.filter(batch.column(0).is_valid())
            texts = batch.column(2).to_pylist()
            row, a, w, at, n, lead = runs_of(texts, length)
            bit = a.view(np.int64) & ((1 << BITS) - 1)
            some = np.flatnonzero(may_hold(repeated, bit))
            row, a, w, at, n, lead = (x[some] for x in (row, a, w, at, n, lead))
            show = may_hold(mixed, bit[some]).tolist()
            cut = [texts[r][p : p + c - 1 + length] if x else None for r, p, c, x in zip(row.tolist(), at.tolist(), n.tolist(), show, strict=True)]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(w), batch.column(0).take(take), batch.column(1).take(take), pa.array(at), pa.array(n), pa.array(lead), pa.array(cut, pa.binary())], names)

    runs = written(src.select("doc", "sub", "text").mapInArrow(_gathered(found), "a long, w long, doc long, sub long, at long, n long, lead long, bytes binary"), folder, "runs")
    place = F.struct("doc", "sub", "at")
    classes = runs.groupBy("a", "w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    classes = written(classes, folder, "classes")
    # Equal runs: all windows of all but the first are repeated.
    equal = runs.select("a", "w", "doc", "sub", "at", "n").join(classes.where("times > 1").select("a", "w", "first"), ["a", "w"])
    equal = equal.where(place != F.col("first")).select("doc", "sub", "at", "n")
    # One copy of each run whose anchor has several.
    several = classes.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    lone = classes.join(several, "a").select("a", "w", "first.doc", "first.sub", "first.at", "kinds")
    texts = runs.where("bytes is not null").select("a", "w", "doc", "sub", "at", "lead", "bytes")
    # Repeated rows (one id, one text) have one place in the order, so their runs count once.
    lone = lone.join(texts, ["a", "w", "doc", "sub", "at"]).dropDuplicates(["a", "w", "doc", "sub", "at"])
    lone = written(lone.select("a", "doc", "sub", "at", "lead", "bytes", "kinds"), folder, "lone")
    parts = equal.unionByName(_sorted_repeats(lone.where(F.col("kinds") <= HOT), length)).unionByName(_hot_repeats(lone.where(F.col("kinds") > HOT), length, folder))
    spans = written(parts.groupBy("doc", "sub").agg(F.collect_list(F.struct("at", "n")).alias("x")), folder, "spans")
    kept = src.join(spans, ["doc", "sub"], "left").select("doc", "text", F.col("x.at").alias("at"), F.col("x.n").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, at, n in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                text = t.as_py()
                if not at.is_valid:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                    continue
                a, m = np.array(at.as_py(), np.int64), np.array(n.as_py(), np.int64)
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + m - 1 + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(rest).hexdigest(), rest))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = kept.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.col("doc").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _gathered(f, least: int = 20_000):
    """Joins the small batches that f yields."""

    def run(batches):
        held, rows = [], 0
        for b in f(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= least:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _sorted_repeats(lone: DataFrame, length: int) -> DataFrame:
    """Repeated windows (doc, sub, at, n windows from there) among runs, all runs of an anchor in one task."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.filter(pa.array(_may_share(table, length)))
        if table.num_rows:
            yield from _block(table, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of their anchors; whole anchors of about TOGETHER_SORTED bytes are sorted at a time.
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            if held.nbytes < TOGETHER_SORTED:
                continue
            a = held.column("a").to_numpy()
            edge = len(a) - int(np.argmin(a[::-1] == a[-1])) if a[0] != a[-1] else 0
            if edge:
                yield from work(held.slice(0, edge).combine_chunks())
                held = held.slice(edge)
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks())

    dealt = lone.select("a", "doc", "sub", "at", "lead", "bytes").repartition("a").sortWithinPartitions("a", "doc", "sub", "at")
    return dealt.mapInArrow(run, "doc long, sub long, at long, n long")


def _may_share(table: pa.Table, length: int) -> np.ndarray:
    """Whether a run (rows in order of their anchor) can have a window that another run of the anchor has too.

    A shared window lies in what both have in common around the anchor, so the longest common stretches to the right of
    the anchor's start and to its left, each over all other runs, must add up to a window. They show between neighbours
    of the sorted contexts.
    """
    a, lead = table.column("a").to_numpy(), table.column("lead").to_numpy()
    texts = table.column("bytes").to_pylist()
    total = np.zeros(len(a), np.int64)
    for side in (1, -1):
        parts = [t[k : k + length] if side > 0 else t[:k][::-1] for t, k in zip(texts, lead.tolist(), strict=True)]
        size = np.array([len(p) for p in parts])
        width = max(1, int(size.max()))
        rows = np.zeros((len(a), width), np.uint8)
        for k, p in enumerate(parts):
            rows[k, : len(p)] = np.frombuffer(p, np.uint8) + np.uint8(1)  # UTF-8 has no byte 255, and 0 is the end now
        order = np.lexsort((rows.view(f"S{width}").ravel(), a))
        i, j = order[:-1], order[1:]
        equal = rows[i] == rows[j]
        common = np.where(equal.all(1), width, equal.argmin(1))
        common = np.where(a[i] == a[j], np.minimum(common, np.minimum(size[i], size[j])), 0)
        best = np.zeros(len(a), np.int64)
        best[j] = common
        best[i] = np.maximum(best[i], common)
        total += best
    return total >= length


def _block(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    # Places order equal windows, so runs are put in order of their place, whatever their anchor.
    table = table.sort_by([("doc", "ascending"), ("sub", "ascending"), ("at", "ascending")])
    texts = table.column("bytes").to_pylist()
    count = np.array([len(t) - length + 1 for t in texts])
    first = np.r_[0, np.cumsum(count)[:-1]]
    flags = repeated_windows(texts, first, length)
    out = []
    doc, sub, at = (table.column(c).to_numpy() for c in ("doc", "sub", "at"))
    for k, (f, c) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        a, n = _spans(flags[f : f + c])
        out += [(doc[k], sub[k], at[k] + x, y) for x, y in zip(a.tolist(), n.tolist(), strict=True)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc", "sub", "at", "n"])


def _hot_repeats(lone: DataFrame, length: int, folder: str) -> DataFrame:
    """The same for anchors with very many runs: by blocks of windows, then windows one by one."""
    place, kinds = F.struct("doc", "sub", "at"), "h binary, core binary, doc long, sub long, at long, n long, bytes binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, d, s, p, lead, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, k = len(text) - length + 1, 0
                while k < m:
                    # The block of window k holds distances low .. low + 7 of windows from the anchor (at text[lead]).
                    low = (k - lead) // 8 * 8
                    stop = min(m, lead + low + 8)
                    shared = hashlib.md5(b"%d %d " % (a, low) + text[lead + low + 7 : lead + low + length]).digest()
                    piece = text[k : stop - 1 + length]
                    rows.append((hashlib.md5(b"%d " % (k - lead - low) + shared + piece).digest(), shared, d, s, p + k, stop - k, piece))
                    k = stop
            if rows:
                types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in kinds.split(", ")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at, row = [], [], []
            for k, (p, n, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                h += [hashlib.md5(text[x : x + length]).digest() for x in range(n)]
                at += range(p, p + n)
                row += [k] * n
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int64())], ["h", "doc", "sub", "at"])

    def later(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """First place of each hash that occurs again, and the other rows of such hashes."""
        firsts = rows.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
        return firsts, rows.join(firsts.where("times > 1").select("h", "first"), "h").where(place != F.col("first"))

    cut = written(lone.select("a", "doc", "sub", "at", "lead", "bytes").mapInArrow(_gathered(blocks), kinds), folder, "hot")
    firsts, equal = later(cut.select("h", "doc", "sub", "at", "n"))
    single = cut.join(firsts.select("h", "first"), "h").where(place == F.col("first"))
    shared = single.groupBy("core").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("core")
    left = single.join(shared, "core").select("doc", "sub", "at", "n", "bytes")
    each = written(left.mapInArrow(_gathered(windows), "h binary, doc long, sub long, at long"), folder, "hot_windows")
    _, repeated = later(each)
    return equal.select("doc", "sub", "at", "n").unionByName(repeated.select("doc", "sub", "at", F.lit(1).cast("long").alias("n")))
