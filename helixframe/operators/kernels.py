"""Numeric kernels behind pandas functions: pair-HMM, Smith-Waterman, assembly graphs, mixtures, activity, orientation EM."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- pair-HMM -------------------------------------------------------------------------------------------------

GAP_OPEN, GAP_EXTEND = 45, 10


#: Bytes of one matrix row of a batch, so that a sweep's rows stay in the cache.
ROW_BYTES = 1 << 18


def _by_lengths(one: list[str], two: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs in batches of equal lengths: (their numbers, letters of the first as (length, batch), of the second alike)."""
    lengths = np.array([(len(x), len(y)) for x, y in zip(one, two, strict=True)], np.int64).reshape(-1, 2)
    order = np.lexsort((lengths[:, 1], lengths[:, 0]))
    cuts = np.flatnonzero(np.r_[True, (np.diff(lengths[order], axis=0) != 0).any(1), True]) if len(order) else []
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        n, m = lengths[order[begin]]
        if not n or not m:
            continue
        most = max(16, ROW_BYTES // (width * int(max(n, m) + 1)))
        for k in range(begin, end, most):
            at = order[k : min(end, k + most)]
            letters = [np.frombuffer("".join(x[i] for i in at).encode("latin-1"), np.uint8).reshape(len(at), -1).T.copy() for x in (one, two)]
            yield at, *letters


def pair_hmm_scores(reads: list[str], quals: list[np.ndarray], haps: list[str], gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> np.ndarray:
    """log10 P(read | haplotype) of pairs: match, insertion and deletion states; free start and end on the haplotype.

    N matches anything; a mismatch has probability error / 3. Pairs of equal lengths are swept together, a read's base at a
    time, the deletion state by doubling sums along the haplotype; rows are scaled, so long reads don't underflow.
    """
    out = np.array([0.0 if not r else -np.inf for r in reads])
    go, ge = 10 ** (-gap_open / 10), 10 ** (-gap_extend / 10)
    mm, mi, im, ii = 1 - 2 * go, go, 1 - ge, ge
    for at, read, hap in _by_lengths(reads, haps, 8):
        n, b = hap.shape
        error = 10 ** (np.array([quals[k] for k in at], float).T / -10)
        m, i, d = np.zeros((n + 1, b)), np.zeros((n + 1, b)), np.full((n + 1, b), 1.0 / n)
        scale, any_base = np.zeros(b), hap == 78
        for base, e in zip(read, error, strict=True):
            prior = np.where((hap == base) | any_base | (base == 78), 1 - e, e / 3)
            new_m = np.zeros((n + 1, b))
            new_m[1:] = prior * (m[:-1] * mm + (i[:-1] + d[:-1]) * im)
            i = m * mi + i * ii
            i[0] = 0.0
            d = np.zeros((n + 1, b))
            d[1:] = new_m[:-1] * mi
            step, weight = 1, ii
            while step <= n and weight > 1e-320:  # d[j] = sum of ii ** k * opened[j - k]
                d[step + 1 :] += weight * d[1:-step].copy()
                step, weight = 2 * step, weight * weight
            m = new_m
            top = np.maximum(np.maximum(m.max(0), i.max(0)), np.maximum(d.max(0), 1e-300))
            m, i, d = m / top, i / top, d / top
            scale += np.log10(top)
        out[at] = np.log10(np.maximum((m + i)[1:].sum(0), 1e-300)) + scale
    return out


def pair_hmm(read: str, quals: list[int], hap: str, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> float:
    """One pair of ``pair_hmm_scores``."""
    return float(pair_hmm_scores([read], [np.asarray(quals)], [hap], gap_open, gap_extend)[0])


def score_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (read, quals array<int>, hap) with log10_likelihood."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["log10_likelihood"] = pair_hmm_scores(b["read"].tolist(), b["quals"].tolist(), b["hap"].tolist())
            yield b

    kinds = ", ".join(f"`{n}` {k}" for n, k in pairs.dtypes)
    return pairs.mapInPandas(run, f"{kinds}, log10_likelihood double")


#: Parts that the reads of a form are dealt into against their haplotypes.
DEALT = 32


def score_matrix(reads: DataFrame, haplotypes: DataFrame, region: str = "region") -> DataFrame:
    """Every read (region, read_id, read, quals) against every haplotype (region, hap_id, hap) of its region.

    Different texts are scored once; reads and haplotypes then join their texts' scores. The rows are all pairs, many for a
    small input, so the last join is dealt into as many tasks as a shuffle has, reads by parts of which each meets all haplotypes.
    """
    spark = reads.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = reads.select(region, "read", "quals").distinct().join(haplotypes.select(region, "hap").distinct(), region)
    scores = met.join(score_pairs(met.select("read", "quals", "hap").distinct()), ["read", "quals", "hap"])
    key = [region, "hap", "_part"]
    one = reads.join(scores, [region, "read", "quals"]).drop("read", "quals").withColumn("_part", F.pmod(F.xxhash64("read_id"), F.lit(DEALT)).cast("int")).repartition(tasks, *key)
    two = haplotypes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).repartition(tasks, *key)
    return one.join(two, key).select(*[c for c in reads.columns if c not in ("read", "quals")], *[c for c in haplotypes.columns if c not in (region, "hap")], "log10_likelihood")


def normalise_likelihoods(df: DataFrame, read: str = "read_id", value: str = "log10_likelihood", cap: float = 4.5) -> DataFrame:
    """No haplotype of a read is more than ``cap`` below its best one."""
    from pyspark.sql import Window

    best = F.max(value).over(Window.partitionBy(read))
    return df.withColumn(value, F.greatest(F.col(value), best - cap))


def marginalise(df: DataFrame, read: str = "read_id", allele: str = "allele", value: str = "log10_likelihood") -> DataFrame:
    """Best haplotype's likelihood per read and allele."""
    return df.groupBy(read, allele).agg(F.max(value).alias(value))


def best_allele(df: DataFrame, margin: float = 0.2, read: str = "read_id", allele: str = "allele", order: str = "allele_order", value: str = "log10_likelihood") -> DataFrame:
    """Per read: its best allele (the first in ``order`` of equals), the distance to the next, and whether that is enough."""
    top = F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o"), F.col(allele).alias("a"))), asc=False)
    g = df.groupBy(read).agg(top.alias("t"))  # alleles of a site: a bounded list
    gap = F.when(F.size("t") > 1, F.col("t")[0]["v"] - F.col("t")[1]["v"]).otherwise(F.lit(float("inf")))
    return g.select(read, F.col("t")[0]["a"].alias("best"), gap.alias("confidence")).withColumn("informative", F.col("confidence") > margin)


# ---- Smith-Waterman -------------------------------------------------------------------------------------------

MATCH, MISMATCH, OPEN, EXTEND = 10, -15, -30, -5


#: Scores don't fall below this.
LOWEST = -(10**8)


def smith_waterman_batch(refs: list[str], alts: list[str], overhang: str = "softclip", match: int = MATCH, mismatch: int = MISMATCH, gap_open: int = OPEN, gap_extend: int = EXTEND) -> list[tuple[int, str, int]]:
    """(score, CIGAR, offset on the reference) of affine alignments. overhang: softclip, indel, leading_indel or ignore.

    Ties prefer the diagonal, then an insertion, then a deletion, and a longer gap to a new one. With softclip and ignore, an
    alternate that occurs whole in the reference aligns to its last occurrence. Pairs of equal lengths are swept together by
    anti-diagonals, so every step is one of whole arrays.
    """
    if overhang not in ("softclip", "indel", "leading_indel", "ignore"):
        raise ValueError(f"unknown overhang {overhang}")
    out: list[tuple[int, str, int]] = [(0, f"{len(a)}S" if a else "", 0) for a in alts]
    left = []
    for k, (r, a) in enumerate(zip(refs, alts, strict=True)):
        whole = r.rfind(a) if r and a and overhang in ("softclip", "ignore") else -1
        if whole >= 0:
            out[k] = (len(a) * match, f"{len(a)}M", whole)
        elif r and a:
            left.append(k)
    edge = gap_open if overhang in ("indel", "leading_indel") else 0
    step = gap_extend if overhang in ("indel", "leading_indel") else 0
    for at, ref, alt in _by_lengths([refs[k] for k in left], [alts[k] for k in left], 32):
        (n, b), m = ref.shape, len(alt)
        gaps, last_column, last_row = np.zeros((n + 1, m + 1, b), np.int16 if max(n, m) < 1 << 15 else np.int32), np.zeros((n + 1, b), np.int64), np.zeros((m + 1, b), np.int64)
        # By row: best scores of the last two anti-diagonals, deletions and insertions (score and length) of the last one.
        before, best = np.zeros((n + 1, b), np.int64), np.zeros((n + 1, b), np.int64)
        best[:2] = edge
        deletion, insertion = np.full((n + 1, b), 2 * LOWEST), np.full((n + 1, b), 2 * LOWEST)
        deleted, inserted = np.zeros((n + 1, b), np.int64), np.zeros((n + 1, b), np.int64)
        for d in range(2, n + m + 1):
            lo, hi = max(1, d - m), min(n, d - 1)
            rows = np.arange(lo, hi + 1)
            diagonal = before[lo - 1 : hi] + np.where(ref[lo - 1 : hi] == alt[d - 1 - rows], match, mismatch)
            opened, longer = best[lo - 1 : hi] + gap_open, deletion[lo - 1 : hi] + gap_extend
            down, down_n = np.maximum(opened, longer), np.where(opened > longer, 1, deleted[lo - 1 : hi] + 1)
            opened, longer = best[lo : hi + 1] + gap_open, insertion[lo : hi + 1] + gap_extend
            right, right_n = np.maximum(opened, longer), np.where(opened > longer, 1, inserted[lo : hi + 1] + 1)
            is_match, is_right = (diagonal >= down) & (diagonal >= right), right >= down
            now = np.full((n + 1, b), edge + step * (d - 1))  # the edges, as far as they lie on this anti-diagonal
            now[lo : hi + 1] = np.maximum(LOWEST, np.where(is_match, diagonal, np.maximum(right, down)))
            gaps[rows, d - rows] = np.where(is_match, 0, np.where(is_right, -right_n, down_n))
            before, best = best, now
            # A column's first cell and a row's first cell open no gap of their own.
            deletion, deleted, insertion, inserted = (np.full((n + 1, b), 2 * LOWEST), np.zeros((n + 1, b), np.int64), np.full((n + 1, b), 2 * LOWEST), np.zeros((n + 1, b), np.int64))
            deletion[lo : hi + 1], deleted[lo : hi + 1], insertion[lo : hi + 1], inserted[lo : hi + 1] = down, down_n, right, right_n
            if d > m:
                last_column[d - m] = now[d - m]
            if d > n:
                last_row[d - n] = now[n]
        done = _traced(gaps, last_column, last_row, overhang)
        for k, x in zip(at, done, strict=True):
            out[left[k]] = x
    return out


def _traced(gaps: np.ndarray, last_column: np.ndarray, last_row: np.ndarray, overhang: str) -> list[tuple[int, str, int]]:
    """The alignments of a batch from the gaps of its cells (0 for the diagonal, -n for an insertion, n for a deletion)."""
    n, m, b = gaps.shape[0] - 1, gaps.shape[1] - 1, gaps.shape[2]
    each = np.arange(b)
    row, column = np.full(b, n), np.full(b, m)
    if overhang != "indel":
        row = n - last_column[:0:-1].argmax(0)  # the last of equals
    score = last_column[row, each]
    if overhang in ("softclip", "ignore"):
        for k in range(1, m + 1):
            better = (last_row[k] > score) | (last_row[k] == score) & (abs(n - k) < abs(row - column))
            row, column, score = np.where(better, n, row), np.where(better, k, column), np.where(better, last_row[k], score)
    # Steps back from there: an operation (M, I, D, S by number) and a length for each pair.
    ops, sizes = [np.full(b, 3 if overhang == "softclip" else 0)], [m - column]
    row, column = row.copy(), column.copy()
    while len(going := np.flatnonzero((row > 0) & (column > 0))):
        gap = gaps[row[going], column[going], going].astype(np.int64)
        op, size = np.zeros(b, np.int64), np.zeros(b, np.int64)
        op[going], size[going] = np.where(gap == 0, 0, np.where(gap < 0, 1, 2)), np.where(gap == 0, 1, abs(gap))
        row[going] -= np.where(gap < 0, 0, size[going])
        column[going] -= np.where(gap > 0, 0, size[going])
        ops.append(op)
        sizes.append(size)
    if overhang in ("indel", "leading_indel"):
        ops += [np.full(b, 2), np.full(b, 1)]
        sizes += [row, np.where(row > 0, 0, column)]
        offset = np.zeros(b, np.int64)
    elif overhang == "softclip":
        ops, sizes, offset = [*ops, np.full(b, 3)], [*sizes, column], row
    else:
        offset = row - column
    ops, sizes = np.array(ops).T[:, ::-1], np.array(sizes).T[:, ::-1]
    out = []
    for k in range(b):
        some = sizes[k] > 0
        op, size = ops[k][some], sizes[k][some]
        first = np.flatnonzero(np.r_[True, op[1:] != op[:-1]]) if len(op) else np.zeros(0, int)
        size = np.add.reduceat(size, first).tolist() if len(op) else []
        if overhang == "ignore" and size:  # what lies before the reference joins the first stretch
            size[0] += int(column[k])
        out.append((int(score[k]), "".join(f"{x}{'MIDS'[o]}" for x, o in zip(size, op[first].tolist(), strict=True)), int(offset[k])))
    return out


def smith_waterman(ref: str, alt: str, overhang: str = "softclip", **weights: int) -> tuple[int, str, int]:
    """One pair of ``smith_waterman_batch``."""
    return smith_waterman_batch([ref], [alt], overhang, **weights)[0]


def align_pairs(pairs: DataFrame, overhang: str = "softclip") -> DataFrame:
    """``pairs`` (ref, alt) with score, cigar and offset."""
    kinds = ", ".join(f"`{n}` {k}" for n, k in pairs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = smith_waterman_batch(b["ref"].tolist(), b["alt"].tolist(), overhang)
            b["score"], b["cigar"], b["offset"] = ([x[k] for x in done] for k in range(3))
            yield b

    return pairs.mapInPandas(run, f"{kinds}, score long, cigar string, offset long")


# ---- assembly graph -------------------------------------------------------------------------------------------


def assemble(sequences: list[tuple[str, bool]], k: int = 21, min_weight: int = 1, most: int = 64, most_steps: int = 100_000) -> list[tuple[str, float]]:
    """At most ``most`` haplotypes (sequence, log10 score) through the k-mer graph of (sequence, is the reference) pairs, best first.

    Edges lighter than ``min_weight`` go unless the reference uses them; paths run from the reference's first to its
    last k-mer; a path scores the share of each of its edges among the edges that leave the same k-mer. A graph whose search
    isn't done after ``most_steps`` steps is an error.
    """
    weight: Counter = Counter()
    reference = next((s for s, r in sequences if r), "")
    if len(reference) < k:
        return []
    kept: set[tuple[str, str]] = set()
    for s, is_ref in sequences:
        for i in range(len(s) - k):
            edge = (s[i : i + k], s[i + 1 : i + 1 + k])
            weight[edge] += 1
            if is_ref:
                kept.add(edge)
    out: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for (a, b), w in sorted(weight.items()):
        if w >= min_weight or (a, b) in kept:
            out[a].append((b, w))
    start, end = reference[:k], reference[-k:]
    heap: list[tuple[float, str, str, frozenset]] = [(0.0, start, start, frozenset([start]))]
    done: list[tuple[str, float]] = []
    steps = 0
    while heap and len(done) < most:
        cost, seq, node, seen = heappop(heap)
        steps += 1
        if steps > most_steps:
            raise ValueError(f"the k-mer graph has too many paths for {most_steps} steps: use longer k-mers or prune edges")
        if node == end:
            done.append((seq, -cost))
            continue
        total = sum(w for _, w in out[node])
        for b, w in out[node]:
            if b not in seen:
                heappush(heap, (cost - math.log10(w / total), seq + b[-1], b, seen | {b}))
    return done


def assemble_regions(reads: DataFrame, k: int = 21, min_weight: int = 1, most: int = 64) -> DataFrame:
    """Haplotypes per region of (region, seq, is_ref): a region's reads are bounded by its depth limit."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = assemble(sorted(zip(pdf["seq"], pdf["is_ref"].astype(bool), strict=True)), k, min_weight, most)
        return pd.DataFrame([(pdf["region"].iloc[0], n, s, z) for n, (s, z) in enumerate(found)], columns=["region", "rank", "haplotype", "score"])

    kind = dict(reads.dtypes)["region"]
    return reads.groupBy("region").applyInPandas(run, f"region {kind}, rank int, haplotype string, score double")


# ---- Gaussian mixture -----------------------------------------------------------------------------------------


def fit_mixture(x: np.ndarray, k: int = 4, rounds: int = 50, seed: int = 47, shrink: float = 1e-3, weight: np.ndarray | None = None):
    """(weights, means, covariances) by EM from k-means++-like starts; covariances are kept away from singular.

    weight: how often each point counts (once if not given).
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    each = np.ones(n) if weight is None else weight
    k = max(1, min(k, n))
    means = x[rng.choice(n, 1, p=each / each.sum())]
    while len(means) < k:
        far = ((x[:, None] - means[None]) ** 2).sum(2).min(1) * each
        means = np.r_[means, x[[rng.choice(n, p=far / far.sum())] if far.sum() > 0 else [rng.integers(n)]]]
    cov = np.repeat((np.cov(x.T, fweights=each.astype(int)).reshape(d, d) + shrink * np.eye(d))[None], k, 0) if each.sum() > 1 else np.repeat(np.eye(d)[None], k, 0)
    w = np.full(k, 1 / k)
    for _ in range(rounds):
        z = log_densities(x, w, means, cov)
        r = np.exp(z - z.max(1, keepdims=True))
        r *= (each / r.sum(1))[:, None]
        total = r.sum(0) + 1e-9
        w, means = total / total.sum(), (r.T @ x) / total[:, None]
        for c in range(k):
            y = x - means[c]
            cov[c] = (r[:, c, None] * y).T @ y / total[c] + shrink * np.eye(d)
    return w, means, cov


def log_densities(x: np.ndarray, w: np.ndarray, means: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(w)))
    for c in range(len(w)):
        y = x - means[c]
        inv = np.linalg.inv(cov[c])
        out[:, c] = math.log(w[c]) - 0.5 * (np.einsum("ni,ij,nj->n", y, inv, y) + np.linalg.slogdet(2 * math.pi * cov[c])[1])
    return out


def mixture_scores(df: DataFrame, columns: list[str], good, bad, name: str = "lod") -> DataFrame:
    """log10 density under the good mixture less that under the bad one; the models' parameters are small."""
    kinds = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[columns].to_numpy(float)
            z = [np.logaddexp.reduce(log_densities(x, *m), axis=1) for m in (good, bad)]
            b[name] = (z[0] - z[1]) / math.log(10)
            yield b

    return df.mapInPandas(run, f"{kinds}, {name} double")


# ---- activity profile -----------------------------------------------------------------------------------------


def band_pass(values: np.ndarray, sigma: float = 17.0, most: int = 50, least: float = 1e-5) -> np.ndarray:
    """Smoothing by a Gaussian of at most ``most`` to either side, its light tails trimmed, renormalised."""
    at = np.arange(-most, most + 1)
    w = np.exp(-(at**2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))
    w = w[w >= least]
    w /= w.sum()
    return np.convolve(values, w, mode="same") if len(values) >= len(w) else np.convolve(values, w, mode="full")[len(w) // 2 : len(w) // 2 + len(values)]


def active_regions(profile: DataFrame, threshold: float = 0.002, smallest: int = 50, largest: int = 300, tile: int = 1 << 16, halo: int = 50) -> DataFrame:
    """Regions of each contig's smoothed activity (contig, pos, activity) above the threshold: (contig, start, end).

    Positions that are missing count 0. Regions are at least ``smallest`` long, as far as the contig's positions go, and cut
    into equal parts of at most ``largest``. Contigs are smoothed in tiles, each with the positions of ``halo`` to its sides (the
    smoothing's reach); stretches that meet at a tile's edge become one.
    """
    from .ranges import merge

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["_tile"].iloc[0]) * tile
        dense = np.zeros(tile + 2 * halo)
        dense[pdf["pos"].to_numpy() - (first - halo)] = pdf["activity"]
        on = band_pass(dense, most=halo)[halo:-halo] > threshold
        edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(int)))
        return pd.DataFrame([(pdf["contig"].iloc[0], first + int(x), first + int(y)) for x, y in zip(edge[::2], edge[1::2], strict=True)], columns=["contig", "start", "end"])

    kind = dict(profile.dtypes)["contig"]
    dealt = profile.select("contig", F.col("pos").cast("long").alias("pos"), F.col("activity").cast("double").alias("activity"))
    dealt = dealt.withColumn("_tile", F.explode(F.sequence(F.floor((F.col("pos") - halo) / tile), F.floor((F.col("pos") + halo) / tile))))
    found = merge(dealt.groupBy("contig", "_tile").applyInPandas(run, f"contig {kind}, start long, end long"))
    ends = profile.groupBy("contig").agg(F.min("pos").alias("_low"), (F.max("pos") + 1).alias("_high"))
    clipped = found.join(ends, "contig").select("contig", F.greatest("start", "_low").alias("a"), F.least("end", "_high").alias("b"), "_high").where("a < b")
    stop = F.when(F.col("b") - F.col("a") < smallest, F.least(F.col("_high"), F.col("a") + smallest)).otherwise(F.col("b"))
    sized = clipped.select("contig", "a", stop.alias("b")).withColumn("k", F.ceil((F.col("b") - F.col("a")) / largest))
    cut = lambda k: (F.col("a") + F.bround((F.col("b") - F.col("a")) * k / F.col("k"), 0)).cast("long")
    return sized.select("contig", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda k: F.struct(cut(k).alias("start"), cut(k + 1).alias("end")))).alias("r")).select("contig", "r.start", "r.end")


# ---- read-orientation EM --------------------------------------------------------------------------------------


def orientation_em(counts: np.ndarray, rounds: int = 100, tolerance: float = 1e-6, weight: np.ndarray | None = None) -> np.ndarray:
    """Prior over 4 states (no artifact, F1R2 artifact, F2R1 artifact, germline het) from rows (depth, alt, alt F1R2), each as
    often as its weight says.

    An artifact puts nearly all alternate reads on one orientation; states differ in allele fraction and F1R2 share.
    """
    fraction, share = np.array([0.01, 0.1, 0.1, 0.5]), np.array([0.5, 0.99, 0.01, 0.5])
    depth, alt, f1r2 = (counts[:, k, None].astype(float) for k in range(3))
    log_p = alt * np.log(fraction) + (depth - alt) * np.log1p(-fraction) + f1r2 * np.log(share) + (alt - f1r2) * np.log1p(-share)
    weight = np.ones(len(counts)) if weight is None else weight
    prior = np.full(4, 0.25)
    for _ in range(rounds):
        z = log_p + np.log(prior)
        r = np.exp(z - z.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        new = (weight @ r + 0.25) / (weight.sum() + 1)
        if np.linalg.norm(new - prior) <= tolerance:
            return new
        prior = new
    return prior


def orientation_priors(rows: DataFrame) -> DataFrame:
    """Priors per context of (context, depth, alt, alt_f1r2, n): equal rows come counted, so a context's list is bounded."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prior = orientation_em(pdf[["depth", "alt", "alt_f1r2"]].to_numpy(), weight=pdf["n"].to_numpy(float))
        return pd.DataFrame([(pdf["context"].iloc[0], *prior.tolist(), int(pdf["n"].sum()))], columns=["context", "none", "f1r2", "f2r1", "het", "n"])

    return rows.groupBy("context").applyInPandas(run, "context string, none double, f1r2 double, f2r1 double, het double, n long")


# ---- contamination --------------------------------------------------------------------------------------------


def contamination(alt: np.ndarray, depth: np.ndarray, frequency: np.ndarray, error: float = 0.001, weight: np.ndarray | None = None) -> float:
    """Share of foreign reads that best explains alternate counts at sites the sample is homozygous for (bisection of the slope);
    a site counts as often as its weight says."""
    hom_alt = alt >= 0.8 * depth
    foreign = np.where(hom_alt, depth - alt, alt)
    rate = np.where(hom_alt, 1 - frequency, frequency)
    keep = np.minimum(foreign, depth - foreign) <= 0.3 * depth
    weight = np.ones(len(depth)) if weight is None else weight
    foreign, depth, rate, weight = foreign[keep], depth[keep], rate[keep], weight[keep]
    if not len(depth):
        return 0.0

    def slope(c: float) -> float:
        p = np.clip((1 - c) * error + c * rate, 1e-9, 1 - 1e-9)
        return float((((foreign / p) - (depth - foreign) / (1 - p)) * (rate - error)) @ weight)

    low, high = 0.0, 0.5
    if slope(low) <= 0:
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return (low + high) / 2


def contamination_by_sample(sites: DataFrame) -> DataFrame:
    """(sample, alt, depth, frequency, n) -> contamination per sample; equal rows come counted."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, n = pdf[["alt", "depth", "frequency"]].to_numpy(float), pdf["n"].to_numpy(float)
        return pd.DataFrame([(pdf["sample"].iloc[0], contamination(r[:, 0], r[:, 1], r[:, 2], weight=n), int(n.sum()))], columns=["sample", "contamination", "sites"])

    kind = dict(sites.dtypes)["sample"]
    return sites.groupBy("sample").applyInPandas(run, f"sample {kind}, contamination double, sites long")


def combined_error(columns: list) -> object:
    """1 - product of (1 - p), each p clamped to [0, 1]; nulls count as 0, -1 if all are null."""
    left = F.lit(1.0)
    for c in columns:
        left = left * (1.0 - F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return F.when(F.coalesce(*columns).isNull(), F.lit(-1.0)).otherwise(1.0 - left)
