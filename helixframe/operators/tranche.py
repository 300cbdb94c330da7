"""Score tranches, normalisation, thresholds over posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scanned, value_block


def resource_flags(variants: DataFrame, resources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """``variants`` with one Boolean per resource: all resources meet in one union and one join."""
    marks = None
    for name, df in resources.items():
        part = df.select(*key, *[F.lit(n == name).alias(n) for n in resources])
        marks = part if marks is None else marks.unionByName(part)
    flags = marks.groupBy(*key).agg(*[F.max(n).alias(n) for n in resources])
    out = variants.join(flags, key, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in resources})


def normalise(df: DataFrame, columns: list[str], training: Column) -> DataFrame:
    """Columns less their mean, by their population standard deviation, both over training rows; a deviation under 1e-5 is an error."""
    stats = df.where(training).agg(*[F.avg(c).alias(c + "_m") for c in columns], *[F.stddev_pop(c).alias(c + "_s") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        checked = F.when(F.col(c + "_s") < 1e-5, F.raise_error(F.lit(f"{c} has no variance"))).otherwise(F.col(c + "_s"))
        out = out.withColumn(c, (F.col(c) - F.col(c + "_m")) / checked)
    return out.drop(*[c + x for c in columns for x in ("_m", "_s")])


def tranche_table(scores: DataFrame, targets: tuple[float, ...], score: str = "score", truth: str = "truth") -> DataFrame:
    """Per target share (percent) of truth rows: the least score that keeps it, and the counts at or above that score.

    Equal scores are counted once per value first, so the ranked table has a row per score, not per variant.
    """
    by = scores.groupBy(score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(truth).cast("long")).alias("_t"))
    by, block = value_block(by.withColumn("_down", -F.col(score)), score, descending=True)
    ranked = scanned(by.select(score, "_down", "_n", "_t", "_bounds"), [], ["_down"], block, sums=["_n", "_t"]).select(score, F.col("sum__n").alias("calls"), F.col("sum__t").alias("truth_calls"))
    total = F.broadcast(scores.agg(F.sum(F.col(truth).cast("long")).alias("truth_sites")))
    want = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    need = F.ceil(F.col("target") * F.col("truth_sites") / 100.0)
    picked = ranked.crossJoin(total).select("*", want).where(F.col("truth_calls") >= need)
    best = F.max_by(F.struct("calls", "truth_calls"), score)
    return picked.groupBy("target", "truth_sites").agg(F.max(score).alias("min_score"), best.alias("b")).select("target", "truth_sites", "min_score", "b.calls", "b.truth_calls")


def tranche_label(score: Column, bounds: list[tuple[str, float]]) -> Column:
    """Label of the first (best) tranche whose bound the score reaches; below all it is the last label with a plus."""
    ordered = sorted(bounds, key=lambda b: -b[1])
    out = F.lit(ordered[-1][0] + "+")
    for name, bound in reversed(ordered):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def merge_tranches(tables: DataFrame) -> DataFrame:
    """Shards' tranches of one score bound added up; transition ratios are weighted by their novel counts."""
    return tables.groupBy("min_score").agg(F.sum("n_known").alias("n_known"), F.sum("n_novel").alias("n_novel"), F.try_divide(F.sum(F.col("novel_titv") * F.col("n_novel")), F.sum("n_novel").cast("double")).alias("novel_titv"))


def cumulative_errors(posteriors: DataFrame, p: str = "p") -> DataFrame:
    """Distinct error posteriors in order, with rows, expected errors and expected truths up to each; ends with totals."""
    by = posteriors.groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    by, block = value_block(by.withColumn("_e", F.col("_n") * F.col(p)).withColumn("_t", F.col("_n") * (1 - F.col(p))), p)
    return scanned(by, [], [p], block, sums=["_n", "_e", "_t"]).select(p, F.col("sum__n").alias("n"), F.col("sum__e").alias("errors"), F.col("sum__t").alias("truths"))


def f_score_threshold(posteriors: DataFrame, beta: float = 1.0, p: str = "p") -> DataFrame:
    """The error posterior up to which calls give the best expected F score; of equal scores the last, 1.0 if all are taken."""
    c = cumulative_errors(posteriors, p)
    ends = F.broadcast(c.agg(F.max("truths").alias("_all"), F.max(p).alias("_last")))
    b2 = beta * beta
    f = F.try_divide((1 + b2) * F.col("truths"), (1 + b2) * F.col("truths") + b2 * (F.col("_all") - F.col("truths")) + F.col("errors"))
    scored = c.crossJoin(ends).select(p, F.round(f, 12).alias("f"), (F.col(p) == F.col("_last")).alias("last"))
    best = scored.agg(F.max(F.struct("f", p, "last")).alias("b"))
    return best.select(F.when(F.col("b.last"), 1.0).otherwise(F.col(f"b.{p}")).alias("threshold"), F.col("b.f").alias("f_score"))


def fdr_threshold(posteriors: DataFrame, target: float, p: str = "p") -> DataFrame:
    """The last posterior before the mean error of the calls so far exceeds ``target``: 0 if the first does, 1 if none does."""
    c = cumulative_errors(posteriors, p).select(p, (F.col("errors") / F.col("n") > target).alias("over"))
    first_over = F.min(F.when(F.col("over"), F.col(p)))
    stop = c.agg(first_over.alias("stop"))
    kept = c.crossJoin(F.broadcast(stop)).agg(F.max("stop").alias("stop"), F.max(F.when(F.col(p) < F.col("stop"), F.col(p))).alias("before"))
    return kept.select(F.when(F.col("stop").isNull(), 1.0).otherwise(F.coalesce("before", F.lit(0.0))).alias("threshold"))


def weighted_median(df: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """The first value, in order, at which twice the running weight reaches the total."""
    by = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = by.withColumn("_up", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    return run.where("2 * _up >= _all").groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def worst(df: DataFrame, score: str, cutoff: float, least: int, tie: str) -> DataFrame:
    """All rows under the cutoff, and at any rate the ``least`` lowest by (score, tie)."""
    low = df.orderBy(score, tie).limit(least).select(tie).withColumn("_low", F.lit(True))
    return df.join(F.broadcast(low), tie, "left").where((F.col(score) < cutoff) | F.coalesce("_low", F.lit(False))).drop("_low")


def decode_annotation(name: str, value: Column, jitter: Column, mq_cap: int = 0) -> Column:
    """An annotation as the mixture model takes it: values that pile up at a bound (0 of FS, HaplotypeScore and InbreedingCoeff,
    ln 2 of SOR) are spread by 0.01 times ``jitter``, a standard normal; MQ is taken to the logit of its cap, if there is one."""
    near = lambda x, y: F.abs(x - y) <= 0.01
    key = name.upper()
    if key in ("HAPLOTYPESCORE", "FS", "AS_FS", "AS_FILTERSTATUS", "INBREEDINGCOEFF"):
        return F.when(near(value, F.lit(0.0)), value + 0.01 * jitter).otherwise(value)
    if key in ("SOR", "AS_SOR", "AS_STRANDODDSRATIO"):
        return F.when(near(value, F.lit(0.6931472)), value + 0.01 * jitter).otherwise(value)
    if key == "MQ" and mq_cap > 0:
        logit = F.log((value + 0.01) / (mq_cap + 0.01 - value))
        top = F.log(F.lit((mq_cap + 0.01) / 0.01))
        return F.when(near(logit, top), logit + 0.05 * jitter).otherwise(logit)
    if key in ("AS_MQ", "AS_RMS_MAPPING_QUALITY"):
        return value + 0.05 * jitter
    return value


def impute_missing(df: DataFrame, columns: list[str], draw: Column | None = None) -> DataFrame:
    """Missing annotations (null or not finite) take ``draw``, a standard normal; columns are normalised already."""
    draw = F.randn(7) if draw is None else draw
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(bad(c), draw).otherwise(F.col(c)) for c in columns})


def target_walk(rows: list[tuple[float, ...]], targets: list[float], sensitivity: int = 0) -> list[tuple[float, ...]]:
    """Rows of a merged tranche table (best score bound first, a bounded list) picked for targets in percent, by one walk.

    The walk goes on while the distance of the next row's sensitivity (a share, at that place of a row) to the target doesn't
    grow; where it grows, the row before is taken, and the next target starts at the row that was too far. At the end of the
    table the last row is taken once for each target that is left. Picked rows carry their target in percent.
    """
    out: list[tuple[float, ...]] = []
    if len(rows) < 2:
        return out
    far = lambda k, target: abs(target - 100.0 * rows[k][sensitivity])
    at, last = 0, len(rows) - 1
    for number, target in enumerate(sorted(targets)):
        best = far(at, target) if number else 100.0
        while at < last and (ahead := far(at + 1, target)) <= best:
            at, best = at + 1, ahead
        row = rows[at]
        out.append((*row[:sensitivity], target, *row[sensitivity + 1 :]))
        at = min(at + 1, last)
    return out
