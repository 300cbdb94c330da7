import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import packing, queries, token_counts

from .common import edge_documents, empty_documents

PIECES = queries.tokenizer_path("piece_bpe_32k.model")
WORDS = queries.tokenizer_path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from([*"abThe .,!'’é\n\t▁　́ßİΣ12<|>"]), max_size=30)


@given(TEXT | st.text(max_size=20))
@settings(max_examples=400, deadline=None)
def test_counts_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    c = token_counts.counter(PIECES)
    assert c.count([text])[0] == len(c.model.encode(text))


@given(TEXT | st.text(max_size=20) | st.just("a<|endoftext|>b <|ENDOFTEXT|>"))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    e = packing.encoder(WORDS)
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_count_tokens(spark):
    docs = edge_documents(spark)
    model = token_counts.counter(PIECES).model
    got = sorted((str(r[0]), *r[1:]) for r in token_counts.count_tokens(docs, PIECES).collect())
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in docs.collect())
    assert got == want
    assert token_counts.count_tokens(empty_documents(spark), PIECES).count() == 0


@given(st.lists(st.integers(1, 5000), max_size=60))
@settings(max_examples=200, deadline=None)
def test_pack_is_whole_and_tight(lengths):
    rows = packing.pack(lengths)
    seen = {d: [] for d in range(len(lengths))}
    for row in rows:
        total = sum(n for _, _, n in row)
        assert total == 2048 or total & (total - 1) == 0 and total < 2048
        for d, s, n in row:
            assert n > 0
            seen[d].append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
        assert at == n


def test_pack_documents(spark):
    docs = edge_documents(spark)
    tokenizer = packing.encoder(WORDS).tokenizer
    rows = packing.pack_documents(docs.where("doc_id <> 3"), WORDS).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    for d, parts in by_doc.items():
        ids = [*tokenizer.encode(text[d], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack_documents(empty_documents(spark), WORDS).count() == 0


def test_tiers_are_packed_to_their_own_size():
    r = random.Random(5)
    lengths = [r.choice([r.randrange(1, 200), r.randrange(200, 1100), r.randrange(1100, 9000)]) for _ in range(3000)]
    rows = packing.pack(lengths)
    sizes = [sum(n for _, _, n in row) for row in rows]
    odd = [k for k, x in enumerate(sizes) if x not in packing.TIERS]
    assert len(odd) <= 11 and all(k > len(rows) - 12 for k in odd)  # only what the last window is cut into
    assert {256, 512, 1024, 2048} <= set(sizes)
    for row, size in zip(rows, sizes, strict=True):
        if size in packing.TIERS[1:] and max(n for _, _, n in row) < size and row != rows[-1]:
            assert row[0][2] > size // 2  # the tier's own piece leads, gaps are filled from shorter ones
    short = [x for row, size in zip(rows, sizes, strict=True) if size == 2048 for x in row[1:] if x[2] <= 256]
    assert short


def test_step_groups_are_balanced(spark, sf):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet").repartition(2), WORDS).toPandas()
    loads = rows.assign(task=rows.sequence_id.map(lambda s: s >> 36)).groupby(["task", "step_group"]).length.sum()
    for task in loads.index.levels[0]:
        x = loads[task].reindex(range(packing.STEP), fill_value=0)
        assert x.max() - x.min() <= 2048
    assert rows.groupby("sequence_id").step_group.nunique().max() == 1 and rows.groupby("sequence_id").tier.nunique().max() == 1


def test_repeated_rows_and_rows_without_id_are_packed_each(spark):
    docs = edge_documents(spark)
    rows = packing.pack_documents(docs, WORDS).toPandas()
    want = {}
    for r in docs.collect():
        key = -1 if r["doc_id"] is None else r["doc_id"]
        want[key] = want.get(key, 0) + len(packing.encoder(WORDS).encode([r["text"] or ""])[0]) // 4 + 1
    assert rows.assign(doc_id=rows.doc_id.fillna(-1)).groupby("doc_id").length.sum().to_dict() == want
    assert (rows[rows.doc_id == 3].groupby("start").length.count() == 2).all()
