"""Copy number: interval filters, standardisation, denoising, segments and calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import quantile_n_plus_one


def annotation_filter(intervals: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Intervals whose annotations (gc_content, mappability, segmental_duplication, ...) lie within their bounds, ends included; a
    missing annotation passes."""
    kept = intervals
    for name, (low, high) in bounds.items():
        kept = kept.where(F.coalesce(F.col(name).between(low, high), F.lit(True)))
    return kept


def extreme_count_filter(counts: DataFrame, low: float = 1.0, high: float = 99.0, share: float = 90.0) -> DataFrame:
    """Intervals (sample, interval, count) whose count is below the ``low`` or above the ``high`` percentile of its sample in at
    most ``share`` percent of the samples: interval and bad_share."""
    w = counts.groupBy("sample").agg(F.percentile("count", low / 100).alias("_low"), F.percentile("count", high / 100).alias("_high"))
    bad = (F.col("count") < F.col("_low")) | (F.col("count") > F.col("_high"))
    per = counts.join(w, "sample").groupBy("interval").agg((100.0 * F.count_if(bad) / F.count(F.lit(1))).alias("bad_share"))
    return per.where(F.col("bad_share") <= share)


def low_count_filter(counts: DataFrame, least: int = 5, percent: float = 90.0) -> DataFrame:
    """Intervals of (sample, interval, count) that at most ``percent`` of the samples see with fewer than ``least`` reads."""
    samples = counts.agg(F.countDistinct("sample").alias("_s"))
    low = counts.groupBy("interval").agg(F.count_if(F.col("count") < least).alias("_low"))
    return low.crossJoin(F.broadcast(samples)).where(~(F.col("_low") > percent * F.col("_s") / 100.0)).select("interval")


def extreme_filter(counts: DataFrame, low: float = 1.0, high: float = 99.0, percent: float = 90.0) -> DataFrame:
    """Intervals that at most ``percent`` of the samples have outside their own percentiles (n + 1 rule; 0 asks for no bound)."""
    values = F.sort_array(F.collect_list(F.col("count").cast("double")))
    bounds = counts.groupBy("sample").agg(values.alias("_v")).select("sample", (quantile_n_plus_one(F.col("_v"), low) if low else F.lit(0.0)).alias("_lo"), quantile_n_plus_one(F.col("_v"), high).alias("_hi"))
    samples = bounds.agg(F.count(F.lit(1)).alias("_s"))
    out = counts.join(bounds, "sample").groupBy("interval").agg(F.count_if((F.col("count") < F.col("_lo")) | (F.col("count") > F.col("_hi"))).alias("_out"))
    return out.crossJoin(F.broadcast(samples)).where(~(F.col("_out") > percent * F.col("_s") / 100.0)).select("interval")


def standardise(counts: DataFrame, floor: float = 1e-10, panel: str | None = None) -> DataFrame:
    """(sample, interval, count) with log2_ratio: share of the sample's reads (by the panel's share), by the sample's median,
    log2 with a floor, less the sample's median."""
    share = F.try_divide(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy("sample")))
    c = counts.withColumn("_f", share if panel is None else share / F.greatest(F.col(panel), F.lit(floor)))
    medians = c.groupBy("sample").agg(F.median("_f").alias("_m"))
    c = c.join(medians, "sample").withColumn("_l", F.log2(F.greatest(F.try_divide(F.col("_f"), F.col("_m")), F.lit(floor))))
    again = c.groupBy("sample").agg(F.median("_l").alias("_m2"))
    return c.join(again, "sample").withColumn("log2_ratio", F.col("_l") - F.col("_m2")).drop("_f", "_m", "_l", "_m2")


def gc_correct(df: DataFrame, value: str = "value", gc: str = "gc", bins: int = 101, decay: float | None = None) -> DataFrame:
    """Values by the smoothed median of their GC bin: exp(-|distance| decay) times bin size weighs the bins' medians."""
    decay = 1 / (0.02 * bins) if decay is None else decay
    b = df.withColumn("_bin", F.floor(F.col(gc) * (bins - 1) + 0.5).cast("int"))
    med = b.groupBy("_bin").agg(F.median(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    other = med.select(F.col("_bin").alias("_o"), F.col("_m").alias("_om"), F.col("_n").alias("_on"))
    w = F.exp(-F.abs(F.col("_bin") - F.col("_o")) * decay) * F.col("_on")
    smooth = med.select("_bin").crossJoin(F.broadcast(other)).groupBy("_bin").agg((F.sum(w * F.col("_om")) / F.sum(w)).alias("_s"))  # at most bins x bins rows
    return b.join(F.broadcast(smooth), "_bin").withColumn("corrected", F.try_divide(F.col(value), F.col("_s"))).drop("_bin", "_s")


def denoise(standardised: DataFrame, panel: DataFrame, rank: int = 20) -> DataFrame:
    """Log ratios less their projection on the panel's leading eigenvectors.

    The panel's Gram matrix is samples x samples: tasks add up the products of their own intervals' vectors, Spark adds the
    tasks' matrices, and the driver solves the sum; the projection back over intervals is a join.
    """
    p = panel.select(F.col("sample").alias("s"), "interval", F.col("log2_ratio").alias("x"))
    names = sorted(r["s"] for r in p.select("s").distinct().collect())  # the panel's samples
    number = {s: k for k, s in enumerate(names)}

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(names)))
        for b in batches:
            x = np.zeros((len(b), len(names)))
            for row, (samples, values) in enumerate(zip(b["s"], b["x"], strict=True)):
                x[row, [number[s] for s in samples]] = values
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pd.DataFrame({"s": i, "t": j, "g": total[i, j]})

    vectors = p.groupBy("interval").agg(F.collect_list(F.struct("s", "x")).alias("v")).select(F.col("v.s").alias("s"), F.col("v.x").alias("x"))
    gram = vectors.mapInPandas(products, "s int, t int, g double").groupBy("s", "t").agg(F.sum("g").alias("g")).collect()
    gram = [{"s": names[r["s"]], "t": names[r["t"]], "g": r["g"]} for r in gram]
    at = {s: k for k, s in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in gram:
        g[at[r["s"]], at[r["t"]]] = r["g"]
    values, vectors = np.linalg.eigh(g)
    keep = [k for k in np.argsort(values)[::-1][:rank] if values[k] > 1e-12 * max(values.max(), 1e-300)]
    spark = panel.sparkSession
    rows = [(names[i], n, float(vectors[i, k] / np.sqrt(values[k]))) for n, k in enumerate(keep) for i in range(len(names))]
    coef = spark.createDataFrame(rows, f"s {dict(panel.dtypes)['sample']}, k int, c double")
    basis = p.join(F.broadcast(coef), "s").groupBy("interval", "k").agg(F.sum(F.col("x") * F.col("c")).alias("u"))
    load = standardised.join(basis, "interval").groupBy("sample", "k").agg(F.sum(F.col("log2_ratio") * F.col("u")).alias("w"))
    part = load.join(basis, "k").groupBy("sample", "interval").agg(F.sum(F.col("w") * F.col("u")).alias("_noise"))
    return standardised.join(part, ["sample", "interval"], "left").withColumn("denoised", F.col("log2_ratio") - F.coalesce("_noise", F.lit(0.0))).drop("_noise")


def change_points(df: DataFrame, threshold: float, value: str = "log2_ratio") -> DataFrame:
    """Simple rule: a new segment at a gap or a jump of more than ``threshold``; adds segment."""
    w = Window.partitionBy("contig").orderBy("start")
    new = F.lag("start").over(w).isNull() | (F.col("start") > F.lag("end").over(w)) | (F.abs(F.col(value) - F.lag(value).over(w)) > threshold)
    return df.withColumn("_n", new.cast("int")).withColumn("segment", F.sum("_n").over(w).cast("int")).drop("_n")


def segment(df: DataFrame, threshold: float, min_points: int = 1, value: str = "log2_ratio") -> DataFrame:
    """Greedy segments per contig: a break at a gap, a jump from the previous point or from the segment's running mean;
    segments of fewer than ``min_points`` take the next point too. Summaries: n, mean, population sd."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"])
        out, held = [], []
        for r in pdf.itertuples(index=False):
            x = getattr(r, value)
            if held:
                gap = r.start > held[-1][1]
                jump = abs(x - held[-1][2]) > threshold or abs(x - sum(h[2] for h in held) / len(held)) > threshold
                if gap or jump and len(held) >= min_points:
                    out.append(held)
                    held = []
            held.append((r.start, r.end, x))
        if held:
            out.append(held)
        rows = []
        for h in out:
            v = np.array([x[2] for x in h])
            rows.append((pdf["contig"].iloc[0], h[0][0], h[-1][1], len(h), v.mean(), float(np.sqrt(max(0.0, (v * v).mean() - v.mean() ** 2)))))
        return pd.DataFrame(rows, columns=["contig", "start", "end", "n_points", "mean", "sd"])

    kind = dict(df.dtypes)["contig"]
    return df.select("contig", "start", "end", value).groupBy("contig").applyInPandas(run, f"contig {kind}, start long, end long, n_points long, mean double, sd double")


def call_segments(segments: DataFrame, low: float = 0.9, high: float = 1.1, outlier_z: float = 2.0, call_z: float = 2.0, ratio: str = "ratio", length: str = "n_points") -> DataFrame:
    """+, - or 0 per segment: neutral ones are 0; the others by their distance, in deviations of the neutral ones without outliers."""
    neutral = F.col(ratio).between(low, high)
    x, n = F.col(ratio), F.col(length)

    def stats(df: DataFrame, suffix: str) -> DataFrame:
        mean = df.agg((F.try_divide(F.sum(n * x), F.sum(n))).alias("m" + suffix))
        both = df.crossJoin(F.broadcast(mean))
        k = F.count(F.lit(1))
        sd = F.when(k > 1, F.sqrt(F.sum(n * F.pow(x - F.col("m" + suffix), 2)) / ((k - 1) / k.cast("double") * F.sum(n)))).otherwise(F.lit(float("nan")))
        return both.agg(F.first("m" + suffix).alias("m" + suffix), sd.alias("s" + suffix))

    first = stats(segments.where(neutral), "1")
    inner = segments.where(neutral).crossJoin(F.broadcast(first)).where(F.when(F.col("s1") == 0, F.abs(x - F.col("m1")) <= 1e-12).otherwise(F.abs(x - F.col("m1")) <= F.col("s1") * outlier_z))
    second = stats(inner.drop("m1", "s1"), "2")
    far = F.col("s2") * call_z
    call = F.when(neutral | F.isnan(far) | far.isNull(), "0").when(x - F.col("m2") < -far, "-").when(x - F.col("m2") > far, "+").otherwise("0")
    return segments.crossJoin(F.broadcast(second)).withColumn("call", call).drop("m2", "s2")


WINDOWS = (8, 16, 32, 64, 128, 256)


def kernel_changepoints(x: np.ndarray, most: int = 1000, windows: tuple[int, ...] = WINDOWS, penalty: float = 1.0, width: float = 1.0) -> list[int]:
    """Change points of a series: the local cost of a Gaussian kernel says, for each window size, where two windows differ most;
    of all these, the least useful are left out until each lowers the cost of its neighbourhood by more than the penalty."""
    n = len(x)

    def cost(a: int, b: int) -> float:
        return (b - a) - sum(np.exp(-((x[k : min(k + 256, b), None] - x[None, a:b]) ** 2) / (2 * width * width)).sum() for k in range(a, b, 256)) / (b - a)

    def costs(size: int) -> np.ndarray:
        """cost(a, a + size) for each a, from running sums along the diagonals of the kernel matrix."""
        total = np.full(n - size + 1, float(size))
        for d in range(1, size):
            c = np.r_[0.0, np.cumsum(np.exp(-((x[d:] - x[:-d]) ** 2) / (2 * width * width)))]
            total += 2 * (c[size - d :] - c[: n - size + 1])
        return size - total / size

    kept: set[int] = set()
    for w in windows:
        if n < 2 * w:
            continue
        one = costs(w)
        gain = np.zeros(n + 1)
        gain[w : n - w + 1] = costs(2 * w) - one[: n - 2 * w + 1] - one[w:]
        kept.update(k for k in range(w, n - w + 1) if gain[k] > 0 and gain[k] == gain[max(0, k - w) : k + w + 1].max())
    edges = [0, *sorted(kept), n]
    held = [cost(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    joined = [cost(a, b) for a, b in zip(edges, edges[2:], strict=False)]
    while joined:
        rises = [joined[k] - held[k] - held[k + 1] for k in range(len(joined))]
        k = int(np.argmin(rises))
        if rises[k] > penalty * np.log(n) and len(joined) <= most:
            break
        held[k : k + 2] = [joined.pop(k)]
        del edges[k + 1]
        for q in (k - 1, k):
            if 0 <= q < len(joined):
                joined[q] = cost(edges[q], edges[q + 2])
    return edges[1:-1]


def kernel_segments(df: DataFrame, value: str = "log2_ratio", penalty: float = 1.0, width: float = 1.0, most: int = 1000) -> DataFrame:
    """Segments of each contig's points by at most ``most`` kernel change points: (contig, start, end, n_points, mean)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"])
        x = pdf[value].to_numpy(float)
        edges = [0, *kernel_changepoints(x, most, penalty=penalty, width=width), len(x)]
        rows = [(pdf["contig"].iloc[0], int(pdf["start"].iloc[a]), int(pdf["end"].iloc[b - 1]), b - a, float(x[a:b].mean())) for a, b in zip(edges, edges[1:], strict=False)]
        return pd.DataFrame(rows, columns=["contig", "start", "end", "n_points", "mean"])

    kind = dict(df.dtypes)["contig"]
    return df.select("contig", "start", "end", value).groupBy("contig").applyInPandas(run, f"contig {kind}, start long, end long, n_points long, mean double")


def smooth_segments(segments: list[tuple[int, float, float]], overlap: float = 2.0) -> list[tuple[int, float, float]]:
    """Neighbours (n, mean, sd) whose means lie within ``overlap`` standard errors are merged, the closest first, until none are."""
    held = list(segments)
    while len(held) > 1:
        gaps = [(abs(a[1] - b[1]) / max(1e-12, np.hypot(a[2] / np.sqrt(a[0]), b[2] / np.sqrt(b[0]))), k) for k, (a, b) in enumerate(zip(held, held[1:], strict=False))]
        gap, k = min(gaps)
        if gap > overlap:
            break
        a, b = held[k], held[k + 1]
        n = a[0] + b[0]
        mean = (a[0] * a[1] + b[0] * b[1]) / n
        var = (a[0] * (a[2] ** 2 + a[1] ** 2) + b[0] * (b[2] ** 2 + b[1] ** 2)) / n - mean**2
        held[k : k + 2] = [(n, mean, float(np.sqrt(max(0.0, var))))]
    return held


def smooth(segments: DataFrame, overlap: float = 2.0) -> DataFrame:
    """``smooth_segments`` of each contig's segments (contig, start, end, n_points, mean, sd): a row for each that is left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        left = smooth_segments(list(pdf[["n_points", "mean", "sd"]].itertuples(index=False, name=None)), overlap)
        stop = np.searchsorted(np.cumsum(pdf["n_points"].to_numpy()), np.cumsum([x[0] for x in left]))
        first = np.r_[0, stop[:-1] + 1]
        rows = [(pdf["contig"].iloc[0], pdf["start"].iloc[a], pdf["end"].iloc[b], *x) for a, b, x in zip(first, stop, left, strict=True)]
        return pd.DataFrame(rows, columns=["contig", "start", "end", "n_points", "mean", "sd"])

    kind = dict(segments.dtypes)["contig"]
    return segments.select("contig", "start", "end", "n_points", "mean", "sd").groupBy("contig").applyInPandas(run, f"contig {kind}, start long, end long, n_points long, mean double, sd double")


def sample_posterior(x: np.ndarray, samples: int = 200, burn: int = 50, seed: int = 47, low: float = -10.0, high: float = 10.0) -> np.ndarray:
    """Posterior deciles of a segment's mean (bounded, flat prior; variance by its conditional): a Gibbs chain."""
    rng = np.random.default_rng(seed)
    n = len(x)
    if not n:
        return np.full(9, np.nan)
    mean, out = float(x.mean()), []
    for k in range(samples + burn):
        var = max(1e-12, ((x - mean) ** 2).sum() / 2) / rng.gamma(max(0.5, n / 2))
        mean = float(np.clip(rng.normal(x.mean(), np.sqrt(var / n)), low, high))
        if k >= burn:
            out.append(mean)
    return np.quantile(out, np.arange(1, 10) / 10)


def segment_posteriors(df: DataFrame, keys: list[str], value: str = "log2_ratio") -> DataFrame:
    """Deciles of the posterior of each segment's mean."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = sample_posterior(np.sort(pdf[value].to_numpy(float)))
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], len(pdf), float(q[0]), float(q[4]), float(q[8]))], columns=[*keys, "n_points", "p10", "p50", "p90"])

    kinds = dict(df.dtypes)
    return df.select(*keys, value).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_points long, p10 double, p50 double, p90 double")
