import hashlib
import random
import time

import numpy as np
import pytest

from helixframe.llm import decontamination, near_dedup, substring_dedup

from .common import edge_documents, empty_documents


def near_copies(n=120, seed=5):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(90)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(1, 8)):
            t[r.randrange(len(t))] = f"x{r.randrange(9999)}"
        out.append(" ".join(t))
    return out


def brute_components(rows):
    sets = [set(near_dedup.shingle_hashes(t or "").tolist()) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    docs = edge_documents(spark, near_copies())
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert near_dedup.near_duplicates(empty_documents(spark)).count() == 0


def versions(n=300, seed=11):
    """A text and versions edited apart: similar to the text at 0.75 to 0.80, to each other at about 0.6."""
    r = random.Random(seed)
    hub = [f"h{k}" for k in range(404)]
    out = [" ".join(hub)]
    while len(out) <= n:
        t, apart = list(hub), r.randrange(9, 12)
        for k in r.sample(range(8, 396), apart):
            t[k] = f"x{r.randrange(10**9)}"
        one, two = (set(near_dedup.shingle_hashes(" ".join(x)).tolist()) for x in (hub, t))
        if 0.75 <= len(one & two) / len(one | two) <= 0.80:
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("seed", "n"), [(11, 300), (12, 640)])
def test_versions_of_one_text_are_all_linked(spark, seed, n):
    rows = list(enumerate(versions(n, seed=seed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == brute_components(rows)
    assert {c for *_, c in got} == {0}


def test_families_near_the_threshold(spark):
    """Production parameters: a family of versions, each pair near 0.75, comes out as brute force has it."""
    r = random.Random(21)
    base = [f"v{k}" for k in range(600)]
    texts = []
    for _ in range(600):
        t = list(base)
        for k in r.sample(range(600), r.randrange(8, 15)):
            t[k] = f"y{r.randrange(10**9)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("hubs", [True, False])
def test_large_regions_are_compared_whole(spark, monkeypatch, hubs):
    """Many texts that share most of a form and are linked in pairs only: what is left to blocks is complete too."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    r = random.Random(23)
    form = [f"f{k}" for k in range(200)]
    texts = []
    for k in range(60):
        own = [f"o{k}x{j}" for j in range(90)]
        texts += [" ".join(form + own), " ".join(form + own[:70] + [f"p{k}x{j}" for j in range(20)])]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if not hubs:  # nothing but the last step may find links
        monkeypatch.setattr(near_dedup, "NEIGHBOURS", 0)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == brute_components(rows)


def test_planted_pairs_are_linked(spark):
    """Recall of single pairs at a similarity of 0.75 to 0.80: all of 2000."""
    r = random.Random(29)
    rows, least = [], []
    while len(rows) < 4000:
        base = [f"q{r.randrange(10**9)}" for _ in range(204)]
        t = list(base)
        for k in r.sample(range(8, 196), r.randrange(4, 7)):
            t[k] = f"z{r.randrange(10**9)}"
        one, two = (set(near_dedup.shingle_hashes(" ".join(x)).tolist()) for x in (base, t))
        if 75 * len(one | two) <= 100 * len(one & two) <= 80 * len(one | two):
            least += [len(rows)] * 2
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(t))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[k] for k in range(4000)] == least


@pytest.fixture
def shuffled(spark):
    """Plans as for large tables, in their first form."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_full_sets_are_dealt_once(shuffled, monkeypatch, tmp_path):
    texts = near_copies(40)
    docs = shuffled.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:5])], "doc_id long, text string").repartition(3)
    near_dedup.sketches(docs).where("doc_id < 40").selectExpr("doc_id as c", "h", "doc_id as rep", "mini").write.parquet(f"{tmp_path}/classes")
    classes = shuffled.read.parquet(f"{tmp_path}/classes")
    wanted = classes.where("c % 2 = 0").select("c", "h", "rep")
    plans = {}

    def written(df, folder, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    monkeypatch.setattr(near_dedup, "written", written)
    sets = near_dedup._full_sets(wanted, docs, str(tmp_path), "sets", 5)
    assert sorted((r.c, list(r.s)) for r in sets.collect()) == [(k, near_dedup.shingle_hashes(texts[k]).view(np.int64).tolist()) for k in range(0, 40, 2)]
    assert plans["sets"].count("Exchange hashpartitioning(h") == plans["sets"].count("Exchange hashpartitioning") == 2
    pairs = shuffled.createDataFrame([(a, b) for b in range(0, 40, 2) for a in range(0, b, 2)], "a long, b long")
    near_dedup._confirmed(pairs, sets, str(tmp_path), "links", 75)
    assert plans["links"].count("ReusedExchange") == 1
    # Values of all wanted classes, and of few others, leave the table.
    got = {r.c: bytes(r.mini) for r in near_dedup._picked(classes, wanted, "mini").collect()}
    assert got == {r.c: bytes(r.mini) for r in classes.join(wanted, "c", "left_semi").collect()}


def brute_removed(rows, n=100):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            w = b[k : k + n]
            if w in seen:
                gone[k : k + n] = True
            seen.add(w)
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [256, 2])
def test_remove_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "PIECE", 512)
    r = random.Random(1)
    passage = "".join(r.choice("abcdefgh ") for _ in range(260))
    texts = [f"{r.random()} {passage} {r.random()}" for _ in range(12)] + ["ab" * 300, "a" * 450, "x" * 99, "", None, passage[:150], passage[80:], "é" * 120, "é" * 120]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(tuple(x)[:5] for x in substring_dedup.remove_repeats(docs).collect())
    assert got == brute_removed(list(enumerate(texts)))


def test_remove_repeats_edges(spark):
    got = substring_dedup.remove_repeats(edge_documents(spark)).collect()
    assert len(got) == 12 and {r["doc_id"] for r in got if r["n_removed"]} == {7, 8}
    assert substring_dedup.remove_repeats(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("hot", [256, 2])
def test_repeated_rows_share_one_place(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "TOGETHER_SORTED", 4096)
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    distinct = [(k, f"{r.random()} {passage[r.randrange(60):]} {r.random()}") for k in range(1, 40)]
    long = (40, " ".join(str(r.random()) for _ in range(60_000)) + passage)
    rows = [*distinct, distinct[0], distinct[0], distinct[3], long, long, (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(x)[:5] for x in substring_dedup.remove_repeats(docs).collect()]
    want = {x[0]: x for x in brute_removed([*distinct, long])}
    assert len(got) == len(rows)
    assert all(x == want[x[0]] for x in got if x[0] is not None)
    assert [x[2] for x in got if x[0] is None] == [0]


def test_suffix_order():
    r = random.Random(3)
    for _ in range(200):
        s = [r.randrange(1, 4) for _ in range(r.randrange(0, 50))]
        assert substring_dedup.suffix_order(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_tiles(doc, item, least):
    """Greedy string tiling as published: again and again the longest matches of unmarked tokens."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        found = []
        for b in range(len(doc)):
            for a in range(len(item)):
                n = 0
                while b + n < len(doc) and a + n < len(item) and doc[b + n] == item[a + n] and b + n not in used_d and a + n not in used_i:
                    n += 1
                if n >= least:
                    found.append((n, b, a))
        if not found:
            return sorted(tiles)
        longest = max(n for n, _, _ in found)
        for n, b, a in found:
            if n == longest and not used_d & set(range(b, b + n)) and not used_i & set(range(a, a + n)):
                tiles.append((a, b, n))
                used_d |= set(range(b, b + n))
                used_i |= set(range(a, a + n))


def test_tiles():
    code = lambda s: np.array([ord(c) for c in s], np.int64)
    tiles = decontamination.tile(code("xxABCDEFyyGHIJKzz"), code("GHIJKABCDEF"), 5)
    assert sorted((a, n) for a, _, n in tiles) == [(0, 5), (5, 6)]
    assert decontamination.tile(code("ABCD"), code("ABCD"), 5) == []
    r = random.Random(9)
    for k in range(300):
        letters = "ab" if k % 3 else "abcdefgh"
        item = "".join(r.choice(letters) for _ in range(r.randrange(0, 30)))
        doc = "".join(r.choice([item[r.randrange(len(item)) :] if item else "", r.choice(letters), item[:7]]) for _ in range(r.randrange(0, 9)))
        assert sorted(decontamination.tile(code(doc), code(item), 3)) == brute_tiles(doc, item, 3), (doc, item)


def test_tiles_of_long_periodic_texts_are_linear():
    one = np.ones(1_000_000, np.int64)
    began = time.monotonic()
    assert sorted(decontamination.tile(one, one[:300], 5)) == [(0, 0, 300)]
    two = np.tile(np.arange(1, 8), 100_000)
    assert sum(n for *_, n in decontamination.tile(two, np.r_[two[3:200], 99, two[:150]], 5)) == 347
    assert time.monotonic() - began < 20


def test_tiles_survive_hash_collisions(monkeypatch):
    monkeypatch.setattr(decontamination.Rolling, "windows", lambda self, n, at=None: np.zeros(len(self.sums) - n if at is None else len(at), np.uint64))
    r = random.Random(3)
    for _ in range(40):
        item, doc = (np.array([r.randrange(3) for _ in range(12)]) for _ in range(2))
        tiles = decontamination.tile(doc, item, 3)
        assert all((item[a : a + n] == doc[b : b + n]).all() for a, b, n in tiles)
        assert bool(tiles) == bool(brute_tiles(doc.tolist(), item.tolist(), 3))


def test_decontamination_equals_brute_force(spark, sf):
    """The registered query's operator over a corpus with planted passages, against published tiling of every pair."""
    r = random.Random(12)
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    texts = [x["text"] or "" for x in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = []
    for k, t in enumerate(texts):
        w, passage = t.split(), r.choice(items)[1].split()
        cut, at = r.randrange(len(passage)), r.randrange(len(w) + 1)
        rows.append((k, " ".join([*w[:at], *passage[cut:], *w[at : at + 3], *passage[: cut if k % 2 else 0], *w[at + 3 :]])[:4000]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["item_id"], x["coverage"], x["n_tiles"]) for x in decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, t in rows:
        best = (None, 0.0, 0)
        for item_id, text in items:
            doc, item = decontamination.tokens_of(t), decontamination.tokens_of(text)
            tiles = brute_tiles(doc, item, min(5, len(item)))
            coverage = sum(n for *_, n in tiles) / len(item)
            if coverage > best[1]:
                best = (item_id, coverage, len(tiles))
        assert got[k] == best


def test_decontaminate_both_ways(spark):
    r = random.Random(4)
    words = [f"t{k}" for k in range(500)]
    items = [(k, " ".join(r.choice(words) for _ in range(30))) for k in range(20)] + [(90, "tiny item"), (91, ""), (92, None)]
    w = items[3][1].split()
    texts = [" ".join(["intro", *w[15:], "middle", *w[:15], "end"]), ", ".join(w).upper(), " ".join(w[:14]), " ".join(w[:16]), "this is a TINY-item here", "clean text", "", None, " ".join(x for p in zip(w, words, strict=False) for x in p)]
    docs = edge_documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    a = decontamination.decontaminate(docs, bench, prefix="_d_").collect()
    b = decontamination.decontaminate(docs, bench, prefix="_d_", most_bytes=0).collect()
    pick = lambda rows: sorted((str(x["doc_id"]), x["_d_item_id"], x["_d_coverage"], x["_d_n_tiles"], x["_d_contaminated"]) for x in rows)
    assert pick(a) == pick(b)
    assert {x["doc_id"]: x["_d_item_id"] for x in a if x["_d_contaminated"]} == {10: 3, 11: 3, 13: 3, 14: 90}
    assert decontamination.decontaminate(empty_documents(spark), bench, prefix="_d_").count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0), prefix="_d_").where("_d_contaminated").count() == 0
