"""MinHash near-duplicates with an LSH forest and exact confirmation.

Documents are sets of ``width``-word shingles. Equal sets form one class, and only classes go on, so a group of copies of
any size is one row. ``TREES * DEPTH`` MinHash values of a class give the forest: each tree is one sorted order of the
classes, by its own ``DEPTH`` values and then by those of the trees after it. Classes that share a tree's own values form a
region; inside a region the order goes deeper, so the nearest rows of the order have the longest common prefixes.

1. The trees' orders are sorted over all tasks (a large region is spread over many of them). Each class is paired with its
   ``NEIGHBOURS`` predecessors of the same region, which share the longest prefix with it, however deep that is.
2. In regions of more than ``SMALL`` classes, each class is also paired with the class that most likely links lead to (the
   text that many versions were made from).
3. A pair's equal values estimate its similarity; pairs that are far apart go, the rest is confirmed on the full shingle sets.
4. Only regions that hold several components can hide further links, and they are compared whole: regions of at most
   ``SMALL`` classes yield their pairs, in larger ones the classes outside the region's largest component are compared with
   all others, block against block (at most about ``BLOCK`` classes each): by MinHash values first, where a pair counts
   only in the first tree that has it, then the classes of such pairs on their full sets; a task gives back the links that
   join components, not pairs.

No region is left out, whatever its size, so a link is found unless its pair shares no region or fails the estimate. Trees
use disjoint values and are independent: at a similarity of exactly 0.75 the first has a probability of 1.1e-6, the second
of 5e-8; at 0.80 both are below 2e-8. Steps 1 to 3 are linear in the number of classes. Step 4 is quadratic only
in a large region of classes that the former steps didn't link.

Defined results: null text counts as empty; a document without words has an empty set and links with nothing; fewer
words than ``width`` are one shingle. component_id is the smallest doc_id reachable; a row whose id is null is linked but
never names a component that has another id. Repeated rows are judged each; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shared_dir, small, written
from .components import min_label_components
from .filters import bit_of, bit_table, may_hold

WIDTH, TREES, DEPTH, NEIGHBOURS, SMALL, BLOCK, BITS = 5, 36, 4, 2, 16, 512, 26
VALUES = TREES * DEPTH
#: Of 144 values, pairs at a similarity of 0.75 share 108 on average.
LEAST_EQUAL, LIKELY_EQUAL = 79, 104
_M1 = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 31, VALUES, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_TREE = _RNG.integers(0, 1 << 63, TREES, np.int64).astype(np.uint64)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    s = np.zeros(n, np.uint64)
    for k in range(width):
        s = (s ^ h[k : k + n]) * _M1
        s ^= s >> np.uint64(32)
    return np.unique(s)


def set_key(s: np.ndarray) -> bytes:
    """128 bits for a set of hashes."""
    return xxhash.xxh3_128_digest(s.tobytes())


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of VALUES permutations of the 32-bit numbers."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        out = np.minimum(out, np.multiply.outer(_A, x[k : k + 4096]).min(1))
    return out


def region_keys(sig: np.ndarray) -> np.ndarray:
    """64 bits for each tree and its own values, (classes, TREES)."""
    own = sig.reshape(-1, TREES, DEPTH).astype(np.uint64)
    key = np.broadcast_to(_TREE, own.shape[:2]).copy()
    for k in range(DEPTH):
        key = (key ^ own[:, :, k]) * _M1
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def value_bytes(sig: np.ndarray) -> np.ndarray:
    """One byte of each value: enough to count equal values (one in 256 unequal ones counts too)."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n, h (the set's key), keys (one for each tree) and mini (a byte of each value) of every row; null for an empty set."""
    src = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = dict(src.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
            full = np.array([len(s) > 0 for s in sets], bool)
            sig = np.array([signature(s) for s in sets], np.uint32).reshape(-1, VALUES)
            keys, mini = region_keys(sig), value_bytes(sig)
            columns = [
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())), pa.array([m.tobytes() if f else None for m, f in zip(mini, full, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h", "keys", "mini"])

    return src.mapInArrow(run, f"doc_id {kind}, n long, h binary, keys array<long>, mini binary")


def forest(classes: DataFrame, folder: str) -> DataFrame:
    """(c, tree, key, before) for each place of a class in a region of several classes: the region and the nearest classes
    before it in the tree's order. Places at the ends of a task's share are kept too, as their region may go on."""
    deeper = F.expr(f"substring(concat(mini, mini), {DEPTH} * (tree + 1) + 1, 8)")
    places = classes.select("c", "mini", F.posexplode("keys").alias("tree", "key")).select("c", "tree", "key", deeper.alias("deeper"))
    # Ranges of the whole order, not of regions: a large region is cut where its deeper values differ.
    ordered = places.repartitionByRange("key", "deeper", "c").sortWithinPartitions("key", "deeper", "c").select("c", "tree", "key")

    def rows(c, tree, key, begin, end, first, last) -> pa.RecordBatch:
        same = np.r_[False, key[1:] == key[:-1]]
        keep = same | np.r_[same[1:], False]
        keep[0] |= first
        keep[-1] |= last
        before: list[list[int]] = [[] for _ in range(len(c))]
        for back in range(1, NEIGHBOURS + 1):
            for k in np.flatnonzero(key[back:] == key[:-back]) + back:
                before[k].append(int(c[k - back]))
        at = np.flatnonzero(keep[begin:end]) + begin
        return pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(tree[at]), pa.array(key[at]), pa.array([before[k] for k in at], pa.list_(pa.int64()))], ["c", "tree", "key", "before"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [x.to_numpy() for x in batch.columns]
            begin = 0
            if held is not None:
                begin = len(held[0]) - 1
                now = [np.r_[x, y] for x, y in zip(held, now, strict=True)]
            yield rows(*now, begin, len(now[0]) - 1, first, False)
            first = first and len(now[0]) == 1
            # The last row waits for its successor; those before it are its neighbours.
            held = [x[-1 - NEIGHBOURS :] for x in now]
        if held is not None:
            yield rows(*held, len(held[0]) - 1, len(held[0]), first, True)

    return written(ordered.mapInArrow(run, "c long, tree int, key long, before array<long>"), folder, "forest")


def _picked(classes: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """c and columns of the classes that a bit table over the c of ``wanted`` lets through: all wanted ones and few others.

    A join with ``wanted`` would shuffle every class's values for the few that are asked for. An exact join has to follow."""
    table = classes.sparkSession.sparkContext.broadcast(bit_table(wanted, "c", BITS))
    src = classes.select("c", *columns, bit_of(F.col("c"), BITS).alias("bit"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(table.value, batch.column(batch.num_columns - 1).to_numpy()))).select(["c", *columns])

    return src.mapInArrow(pick, classes.select("c", *columns).schema)


def _equal_values(pairs: DataFrame, classes: DataFrame, folder: str, round_: int) -> DataFrame:
    """(a, b, equal) of those pairs (a, b) of classes that have LEAST_EQUAL equal values, as a table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, VALUES) for k in (2, 3))
            equal = (one == two).sum(1).astype(np.int32)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal)], ["a", "b", "equal"])
            yield out.filter(pa.array(equal >= LEAST_EQUAL))

    # Written first: a distinct right below the join would keep all pairs of one class in one task.
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, f"candidates{round_}")
    some = written(_picked(classes, _ends(pairs), "mini"), folder, f"mini{round_}")
    both = pairs.join(some.select(F.col("c").alias("a"), F.col("mini").alias("ma")), "a").join(some.select(F.col("c").alias("b"), F.col("mini").alias("mb")), "b")
    return written(both.select("a", "b", "ma", "mb").mapInArrow(count, "a long, b long, equal int"), folder, f"near{round_}")


def _full_sets(wanted: DataFrame, docs: DataFrame, folder: str, name: str, width: int) -> DataFrame:
    """(c, s) for the classes of ``wanted`` (c, h, rep), as a table: made again from the texts, which a bit table picks.

    Past some 10^8 classes the table lets nearly every text through to the exact join, which then shuffles them once."""
    wanted = written(wanted, folder, f"wanted_{name}")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "rep", BITS))
    src = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), bit_of(F.col("doc_id"), BITS).alias("bit"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(table.value, batch.column(2).to_numpy())))
            for k in range(0, batch.num_rows, 100):
                some = [shingle_hashes(t, width) for t in batch.column(1)[k : k + 100].to_pylist()]
                some = [s for s in some if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in some], pa.binary()), pa.array([s.view(np.int64) for s in some], pa.list_(pa.int64()))], ["h", "s"])

    found = src.mapInArrow(sets, "h binary, s array<long>").join(wanted.select("c", "h"), "h")
    # One row a key and so a class: by the key, as the join has dealt the sets by it already.
    return written(found.dropDuplicates(["h"]).select("c", "s"), folder, name)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()


def _confirmed(near: DataFrame, sets: DataFrame, folder: str, name: str, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes: those whose full sets are similar enough, as a table."""
    # Both sides named anew: only alike projections share one exchange of the sets.
    both = near.select("a", "b").join(sets.select(F.col("c").alias("b"), F.col("s").alias("t")), "b").join(sets.select(F.col("c").alias("a"), F.col("s").alias("r")), "a")
    # Row by row in the JVM: batches of pairs of long texts' sets would be large.
    common = F.size(F.array_intersect("r", "t"))
    both = both.where(100 * common >= percent * (F.size("r") + F.size("t") - common)).select("a", "b")
    return written(both, folder, name)


def _components(links: DataFrame, folder: str, round_: int, labels: DataFrame | None = None) -> DataFrame:
    """(c, label) of all linked classes, as a table; labels: those of former links, which stand for them."""
    if labels is not None:
        links = links.select("a", "b").unionByName(labels.select(F.col("c").alias("a"), F.col("label").alias("b")).where("a != b"))
    return written(min_label_components(links, f"{folder}/cc{round_}").select(F.col("id").alias("c"), "label"), folder, f"labels{round_}")


def _hub_pairs(places: DataFrame, near: DataFrame) -> DataFrame:
    """Each class of a region of more than SMALL classes with that region's class of most likely links."""
    likely = near.where(F.col("equal") >= LIKELY_EQUAL)
    degree = likely.select(F.col("a").alias("c")).union(likely.select(F.col("b").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("degree"))
    sizes = places.join(degree, "c", "left").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "c")).alias("hub"))
    large = sizes.where((F.col("n") > SMALL) & (F.col("hub.degree") > 0)).select("key", F.col("hub.c").alias("hub"))
    return places.join(large, "key").where("c != hub").select(F.col("c").alias("a"), F.col("hub").alias("b"))


def _open_regions(marked: DataFrame, folder: str) -> DataFrame:
    """(key, n) of the regions with several components, as a table; marked: (key, tree, c, label)."""
    regions = marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return written(regions.where("n > 1 and low != high").select("key", "n"), folder, "regions")


def _cross_pairs(marked: DataFrame, regions: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of one small region and different components, and (key, tree, c, label) of the large regions, if any."""
    listed = marked.join(regions.where(F.col("n") <= SMALL).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("label", "c")).alias("x"))
    one = listed.select("x", F.explode("x").alias("p"))
    pairs = one.select("p", F.explode("x").alias("q")).where("p.c < q.c and p.label != q.label").select(F.col("p.c").alias("a"), F.col("q.c").alias("b"))
    large = regions.where(F.col("n") > SMALL).select("key")
    if large.isEmpty():
        return pairs, None
    return pairs, written(marked.join(large, "key").select("key", "tree", "c", "label"), folder, "large")


def _dealt(large: DataFrame) -> DataFrame:
    """(key, tree, c, label, own, i, j): each class of a large region in all pairs of blocks (i, j) that its block, own, is in."""
    sizes = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    regions = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).select("key", "n", F.col("main.n").alias("n_main"), F.col("main.label").alias("main"))
    # Blocks of the main component (negative numbers) and of the others; pairs of two main blocks aren't compared.
    m, o = F.ceil(F.col("n_main") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int")
    spread = large.join(regions, "key").withColumn("is_main", F.col("label") == F.col("main"))
    own = F.when(F.col("is_main"), -1 - F.pmod(F.xxhash64("c"), m)).otherwise(F.pmod(F.xxhash64("c"), o)).cast("int")
    spread = spread.withColumn("own", own)
    others = F.sequence(F.lit(0), o - 1)
    pairs = F.when(F.col("is_main"), F.transform(others, lambda k: F.struct(k.alias("i"), F.col("own").alias("j")))).otherwise(
        F.concat(F.transform(others, lambda k: F.struct(F.greatest(k, F.col("own")).alias("i"), F.least(k, F.col("own")).alias("j"))), F.transform(F.sequence(F.lit(1), m), lambda k: F.struct(F.col("own").alias("i"), (-k).alias("j")))))
    return spread.select("key", "tree", "c", "label", "own", F.explode(pairs).alias("p")).select("key", "tree", "c", "label", "own", "p.i", "p.j")


def _close_classes(large: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """(key, i, j, c, label) of the classes that have, in another component and in this pair of blocks, one with enough equal
    values, as a table. A pair counts in the first tree whose region it shares."""
    dealt = _dealt(large).join(_picked(classes, large, "keys", "mini"), "c").select("key", "i", "j", "tree", "own", "c", "label", "keys", "mini")

    def screen(table: pa.Table) -> pa.Table:
        i, j, tree = (table.column(x)[0].as_py() for x in ("i", "j", "tree"))
        own, label = table.column("own").to_numpy(), table.column("label").to_numpy()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, TREES)
        mini = np.frombuffer(b"".join(table.column("mini").to_pylist()), np.uint8).reshape(-1, VALUES)
        close = np.zeros(len(own), bool)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for n, k in enumerate(left.tolist()):
            others = right[n + 1 :] if i == j else right
            others = others[label[others] != label[k]]
            others = others[(mini[others] == mini[k]).sum(1) >= LEAST_EQUAL]
            hit = others[~(keys[others, :tree] == keys[k, :tree]).any(1)]
            if len(hit):
                close[k] = close[hit] = True
        return table.select(["key", "i", "j", "c", "label"]).filter(pa.array(close))

    return written(dealt.groupBy("key", "i", "j").applyInArrow(screen, "key long, i int, j int, c long, label long"), folder, "close")


def _block_links(close: DataFrame, sets: DataFrame, folder: str, percent: int) -> DataFrame:
    """Links that join components of the same large region, as a table (a, b)."""
    dealt = close.join(sets, "c").select("key", "i", "j", "c", "label", "s")

    def compare(table: pa.Table) -> pa.Table:
        c, label = table.column("c").to_pylist(), table.column("label").to_pylist()
        lists = table.column("s").combine_chunks()
        joined, size = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().astype(np.int64)
        begin = np.r_[0, np.cumsum(size)[:-1]]
        sets = np.split(joined, begin[1:])
        top = {x: x for x in label}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        a, b = [], []
        for k in range(len(c) - 1):
            rest = joined[begin[k + 1] :]
            hit = sets[k][np.minimum(np.searchsorted(sets[k], rest), size[k] - 1)] == rest
            common = np.add.reduceat(hit.astype(np.int64), begin[k + 1 :] - begin[k + 1])
            for q in np.flatnonzero(100 * common >= percent * (size[k] + size[k + 1 :] - common)) + k + 1:
                x, y = find(label[k]), find(label[q])
                if x != y:
                    top[max(x, y)] = min(x, y)
                    a.append(c[k])
                    b.append(c[q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return written(dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), folder, "links_large")


def _labels(classes: DataFrame, docs: DataFrame, folder: str, percent: int, width: int) -> DataFrame:
    """(c, label) of all linked classes; label: the least class of the component."""
    places = forest(classes, folder)
    ids = classes.select("c", "h", "rep")
    near = _equal_values(places.select(F.col("c").alias("a"), F.explode("before").alias("b")), classes, folder, 1)
    near = near.unionByName(_equal_values(_hub_pairs(places, near), classes, folder, 2))
    sets = _full_sets(ids.join(_ends(near), "c"), docs, folder, "sets1", width)
    links = _confirmed(near.select("a", "b").distinct(), sets, folder, "links1", percent)
    dropped(docs.sparkSession, f"{folder}/sets1")
    labels = _components(links, folder, 1)
    # All that is left.
    marked = places.join(labels, "c", "left").select("key", "tree", "c", F.coalesce("label", "c").alias("label"))
    marked = written(marked, folder, "marked")
    pairs, large = _cross_pairs(marked, _open_regions(marked, folder), folder)
    near = _equal_values(pairs, classes, folder, 3)
    wanted, close = _ends(near), None
    if large is not None:
        close = _close_classes(large, classes, folder)
        wanted = wanted.union(close.select("c")).distinct()
    sets = _full_sets(ids.join(wanted, "c"), docs, folder, "sets2", width)
    more = _confirmed(near, sets, folder, "links2", percent)
    if close is not None:
        more = more.union(_block_links(close, sets, folder, percent))
    dropped(docs.sparkSession, f"{folder}/sets2")
    return labels if more.isEmpty() else _components(more, folder, 2, labels)


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (it names its component), class_size (equal sets)."""
    folder = shared_dir(docs.sparkSession)
    rows = written(sketches(docs, width), folder, "sketches")
    grouped = rows.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"), F.any_value("keys").alias("keys"), F.any_value("mini").alias("mini"))
    # Numbered as they are written: every later step reads the same numbers.
    classes = written(grouped.withColumn("c", F.monotonically_increasing_id()), folder, "classes")
    labels = _labels(classes, docs, folder, percent, width)
    named = classes.select("c", "h", "rep", "class_size").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("h", "component_id", "class_size")
    out = rows.select("doc_id", "n", "h").join(named, "h", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
