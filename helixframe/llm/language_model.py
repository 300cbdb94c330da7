"""LM scoring with a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The model predicts the class of the next token from the two classes before it; a class is one of the most frequent
tokens or a bucket of the other words (by their last two bytes). Inside a bucket a word has its add-one-smoothed share of
the bucket's tokens, and all unseen words of a bucket share one count. The class scores are normalised exactly: batched
matrix products give the log normaliser of every pair of context classes once, so a token's log-probability is a few table
look-ups.

Corpus statistics cover every training text: token counts are aggregated by Spark and written as a table. The
``hot`` most frequent tokens (a bound, not a share) travel to the executors; counts of all other words reach the documents
by a join on the word, so no step needs the vocabulary on one machine. The class model's parameters (about
``classes`` * ``dim`` numbers) are fitted on the counts of class trigrams, which Spark sums over every training text: at most
``classes`` ** 3 numbers, whatever the size of the corpus. NCE needs no more than these counts.

Tokens: A-Z lower-cased, words are runs of other than ASCII blanks, then one end. Defined results: null text counts as
empty and is its end alone; without training texts the counts are 0 and all scores 0; repeated rows are scored each;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small, written

END = b""  # no word is empty


def tokens_of(text: str) -> list[bytes]:
    """bytes.split() splits at exactly the ASCII blanks, bytes.lower() changes exactly A-Z."""
    return text.encode().lower().split()


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of a table with one column, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            for k in range(0, len(items), 50_000):
                w, c = zip(*items[k : k + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(c, pa.int64())], ["word", "c"])

        for batch in small(batches):
            for t in batch.column(0).to_pylist():
                seen.update(tokens_of(t))
                seen[END] += 1
                if len(seen) > 500_000:
                    yield from out()
                    seen.clear()
        yield from out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Tables of the class model and the hot words."""

    n: int  # training tokens
    v: int  # distinct training tokens
    buckets: int
    word_class: dict[bytes, int]
    hot: dict[bytes, int]
    hot_class: np.ndarray
    hot_log: np.ndarray  # log10(c + 1)
    own: np.ndarray  # per class: whether it is one word
    inside: np.ndarray  # per class: log10 of the bucket's tokens + its distinct words + 1
    first: np.ndarray  # [class, class before]: its part of the class score
    second: np.ndarray  # [class, class two before]
    bias: np.ndarray
    log_z: np.ndarray  # [class before, class two before]

    def class_of(self, word: bytes) -> int:
        k = self.word_class.get(word)
        return len(self.word_class) + zlib.crc32(word[-2:]) % self.buckets if k is None else k

    def class_scores(self, classes: np.ndarray) -> float:
        """Sum of log10 probabilities of a text's classes (its end included)."""
        start = self.word_class.get(END, 0)
        one = np.empty_like(classes)
        one[0], one[1:] = start, classes[:-1]
        two = np.empty_like(classes)
        two[:2], two[2:] = start, classes[:-2]
        return float((self.first[classes, one] + self.second[classes, two] + self.bias[classes] - self.log_z[one, two]).sum()) / math.log(10)


def train_nce(sequences: list[np.ndarray], n_classes: int, counts: np.ndarray, start: int, dim: int = 24, noise: int = 12, epochs: int = 3, batch: int = 2048, rate: float = 0.1, seed: int = 1):
    """Log-bilinear parameters: word vectors r, output vectors q, context matrices c1 and c2 (diagonal), biases."""
    rng = np.random.default_rng(seed)
    p = (counts + 1.0) / (counts + 1.0).sum()
    r, q = rng.normal(0, 0.1, (n_classes, dim)), rng.normal(0, 0.1, (n_classes, dim))
    c1, c2, bias = np.ones(dim), np.full(dim, 0.5), np.log(p)
    if sequences:
        w = np.concatenate(sequences)
        one = np.concatenate([np.r_[start, s[:-1]] for s in sequences])
        two = np.concatenate([np.r_[start, start, s[:-2]][: len(s)] for s in sequences])
        params = [r, q, c1, c2, bias]
        sums = [np.full_like(x, 1e-6) for x in params]
        log_kp = np.log(noise * p)
        cdf = np.cumsum(p)
        for _ in range(epochs):
            order = rng.permutation(len(w))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                m = len(at)
                other = np.minimum(np.searchsorted(cdf, rng.random((m, noise))), n_classes - 1)
                out = np.c_[w[at], other]  # the true class first
                h = r[one[at]] * c1 + r[two[at]] * c2
                # The scores of all classes are one product; d is kept as a (batch, class) matrix, so its gradients are too.
                cell = np.arange(m)[:, None] * n_classes + out
                s = np.take(h @ q.T + bias - log_kp, cell)
                d = -1 / (1 + np.exp(-np.clip(s, -30, 30)))
                d[:, 0] += 1
                d = np.bincount(cell.ravel(), d.ravel(), m * n_classes).reshape(m, n_classes)
                g_h = d @ q
                grads = [np.zeros_like(r), d.T @ h, None, None, d.sum(0)]
                np.add.at(grads[0], one[at], g_h * c1)
                np.add.at(grads[0], two[at], g_h * c2)
                grads[2], grads[3] = (g_h * r[one[at]]).sum(0), (g_h * r[two[at]]).sum(0)
                for x, g, total in zip(params, grads, sums, strict=True):
                    g = g / m
                    total += g * g
                    x += rate * g / np.sqrt(total)
    return r, q, c1, c2, bias


def train_counts(trigrams: np.ndarray, counts: np.ndarray, dim: int = 24, noise: int = 12, steps: int = 900, batch: int = 2048, rate: float = 0.1, seed: int = 1):
    """The parameters of ``train_nce`` from the counts [class before, class two before, class] of a whole corpus.

    A step draws context pairs by their share of the corpus; for each, the true classes and the noise enter with their exact
    expectations instead of single draws.
    """
    n = len(counts)
    rng = np.random.default_rng(seed)
    p = (counts + 1.0) / (counts + 1.0).sum()
    params = [rng.normal(0, 0.1, (n, dim)), rng.normal(0, 0.1, (n, dim)), np.ones(dim), np.full(dim, 0.5), np.log(p)]
    each = trigrams.sum(2, dtype=np.float64).ravel()
    if each.sum() > 0:
        r, q, c1, c2, bias = params
        sums = [np.full_like(x, 1e-6) for x in params]
        kp = noise * p
        log_kp, cdf = np.log(kp), np.cumsum(each / each.sum())
        flat = trigrams.reshape(n * n, n)
        for _ in range(steps):
            drawn, times = np.unique(np.minimum(np.searchsorted(cdf, rng.random(batch), "right"), int(np.flatnonzero(each)[-1])), return_counts=True)
            one, two = np.divmod(drawn, n)
            true = flat[drawn] / each[drawn][:, None]
            h = r[one] * c1 + r[two] * c2
            z = 1 / (1 + np.exp(-np.clip(h @ q.T + bias - log_kp, -30, 30)))
            d = (true * (1 - z) - kp * z) * times[:, None]
            g_h = d @ q
            grads = [np.zeros_like(r), d.T @ h, (g_h * r[one]).sum(0), (g_h * r[two]).sum(0), d.sum(0)]
            np.add.at(grads[0], one, g_h * c1)
            np.add.at(grads[0], two, g_h * c2)
            for x, g, total in zip(params, grads, sums, strict=True):
                g = g / batch
                total += g * g
                x += rate * g / np.sqrt(total)
    return params


def class_trigrams(training: DataFrame, model: Model, size: int) -> np.ndarray:
    """How often each class follows each pair of classes, [class before, class two before, class], over all rows of ``training``."""
    shared = training.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        start = m.word_class.get(END, 0)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            codes, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(c.astype(np.int64))], ["code", "c"])

        tokens = 0
        for batch in small(batches):
            for t in batch.column(0).to_pylist():
                words = [*tokens_of(t), END]
                at = np.fromiter(map(m.hot.get, words, repeat(-1)), np.int64, len(words))
                w = m.hot_class[at].astype(np.int64)
                for k in np.flatnonzero(at < 0).tolist():
                    w[k] = m.class_of(words[k])
                before = np.r_[start, start, w]
                held.append((before[1:-1] * size + before[:-2]) * size + w)
                tokens += len(w)
                if tokens > 4_000_000:
                    yield out()
                    held.clear()
                    tokens = 0
        if held:
            yield out()

    found = training.select("text").mapInArrow(run, "code int, c long").groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    shared.unpersist()
    counts = np.zeros(size**3)
    counts[found.column("code").to_numpy()] = found.column("c").to_numpy()
    return counts.reshape(size, size, size)


def normalised(r, q, c1, c2, bias):
    """(first, second, log normaliser of every context pair), by matrix products in batches."""
    first, second = q @ (r * c1).T, q @ (r * c2).T
    n = len(q)
    log_z = np.empty((n, n))
    for one in range(n):
        s = first[:, one][:, None] + second + bias[:, None]
        top = s.max(0)
        log_z[one] = top + np.log(np.exp(s - top).sum(0))
    return first.astype(np.float32), second.astype(np.float32), log_z.astype(np.float32)


def fit(training: DataFrame, counts: DataFrame, hot: int = 1 << 17, top: int = 192, buckets: int = 48, sample_docs: int | None = None, longest: int = 64) -> Model:
    """training: doc_id, text of the training rows; counts: their token counts, as a table that can be read again.

    The class model learns from all training texts, unless ``sample_docs`` asks for so many of them, taken by hash.
    """
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    words, c = _hot_words(counts.where(F.length("word") <= longest), hot, top)
    word_class = {w: k for k, w in enumerate(words[:top])}
    model = Model(n, v, buckets, word_class, {w: k for k, w in enumerate(words)}, np.zeros(0), np.log10(c + 1), np.zeros(0), np.zeros(0), *[np.zeros(0)] * 4)
    model.hot_class = np.array([model.class_of(w) for w in words], np.int32)
    size = len(word_class) + buckets
    in_class = np.zeros(size)
    in_class[: len(word_class)] = c[: len(word_class)]
    distinct = np.zeros(size)
    for k, tokens, kinds in _bucket_sums(counts, model):
        in_class[k], distinct[k] = tokens, kinds
    model.own = np.arange(size) < len(word_class)
    model.inside = np.where(model.own, 0.0, np.log10(in_class + distinct + 1))
    if sample_docs is not None:
        # The sample's ids are picked first, so that no more texts than its own travel.
        ids = training.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        training = training.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    params = train_counts(class_trigrams(training, model, size) if n else np.zeros((size,) * 3), in_class)
    model.first, model.second, model.log_z = normalised(*params)
    model.bias = params[4].astype(np.float32)
    return model


def _hot_words(counts: DataFrame, hot: int, top: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``hot`` of the most frequent words (``top`` of them at least), most frequent first, and their counts.

    A histogram of counts (16 steps a doubling) gives the least count, so only the words themselves come to the driver.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r["k"], r["n"]) for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = None, 0
    for k, n in sizes:
        if total + n > max(hot, top):
            break
        least, total = k, total + n
    if total < top:
        few = counts.orderBy(F.desc("c"), "word").limit(top).toArrow()
    else:
        few = counts.where(step >= least).toArrow()
    pairs = sorted(zip(few.column("word").to_pylist(), few.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [w for w, _ in pairs], np.array([k for _, k in pairs], float)


def _bucket_sums(counts: DataFrame, model: Model) -> list[tuple[int, int, int]]:
    own, buckets = frozenset(model.word_class), model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = Counter(), Counter()
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w not in own:
                    k = len(own) + zlib.crc32(w[-2:]) % buckets
                    tokens[k] += c
                    kinds[k] += 1
        columns = [pa.array(list(tokens), pa.int32()), pa.array(list(tokens.values()), pa.int64()), pa.array([kinds[k] for k in tokens], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["k", "n", "v"])

    sums = counts.select("word", "c").mapInArrow(run, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return [(x["k"], x["n"], x["v"]) for x in sums.collect()]


def score(docs: DataFrame, learn: Column, **parameters) -> DataFrame:
    """Each row of ``docs`` (doc_id, text and what else it has) scored by a model of its rows for which ``learn`` holds.

    Returns doc_id, learned, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (the model).
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    src = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    counts = written(count_tokens(src.where("learned").select("text")), folder, "counts")
    model = fit(src.where("learned").select("doc_id", "text"), counts, **parameters)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(src.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        get, row = m.hot.get, TaskContext.get().partitionId() << 40
        for batch in small(batches):
            out: list[tuple] = []
            for t in batch.column(1).to_pylist():
                words = [*tokens_of(t), END]
                at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                classes = m.hot_class[at] if len(m.hot_class) else np.zeros(len(words), np.int32)
                rare: Counter = Counter()
                for k in np.flatnonzero(at < 0).tolist():
                    w = words[k]
                    classes[k] = m.class_of(w)
                    rare[w] += 1
                known = at[at >= 0]
                logs = m.hot_log[known]
                z = m.class_scores(classes) if m.n else 0.0
                z += float(logs[~m.own[m.hot_class[known]]].sum()) - float(m.inside[classes].sum()) if m.n else 0.0
                out.append((row, len(words), len(known), float(logs.sum()), z, list(rare), list(rare.values())))
                row += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", "learned", "row", "n_tokens", "hot_known", "hot_log", "z", "rare", "times"]
    schema = f"doc_id {kind}, learned boolean, row long, n_tokens long, hot_known long, hot_log double, z double, rare array<binary>, times array<int>"
    part = written(src.mapInArrow(run, schema), folder, "scored")
    rare = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    # Counted words beyond the hot ones; words that are in no training text simply don't join and add log10(0 + 1) = 0.
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("log"))
    base_each = math.log10(model.n + model.v + 1)
    known, log = F.coalesce("known", F.lit(0)), F.coalesce("log", F.lit(0.0))
    return part.join(found, "row", "left").select(
        "doc_id", "learned", "n_tokens", (F.col("hot_known") + known).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("hot_log") + log - F.col("n_tokens") * F.lit(base_each)).alias("base_score"), (F.col("z") + log).alias("score"),
    )
