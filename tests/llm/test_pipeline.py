import numpy as np
import pytest

from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from helixframe.llm import toxicity  # noqa: E402
from helixframe.llm.common import fold  # noqa: E402
from helixframe.llm.decontamination import Benchmark  # noqa: E402
from helixframe.llm.packing import encoder, pack  # noqa: E402
from helixframe.llm.queries import tokenizer_path  # noqa: E402

from .test_similarity import brute_components  # noqa: E402
from .test_exact_and_url import lower  # noqa: E402


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grammar = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), usable=~fold(F.col("doc_id"), 5, 0))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    rows = [(d, t) for d, t in rows if grammar.score(t)[0] < 0.5]
    first = {}
    for d, t in rows:
        first.setdefault(lower(t), d)
    rows = [(d, t) for d, t in rows if first[lower(t)] == d]
    keep = {d for d, _, c in brute_components(rows) if d == str(c)}
    rows = [(d, t) for d, t in rows if str(d) in keep]
    bench = Benchmark([(r["item_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = [(d, t) for d, t in rows if bench.judge(t)[1] < 0.5]
    want = {d: len(x) // 4 + 1 for (d, _), x in zip(rows, encoder(tokenizer_path("word_bpe_49k.json")).encode([t for _, t in rows]), strict=True)}
    got = pipeline.run(spark, sf).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want
    sizes = got.groupby("sequence_id").length.sum()
    assert ((sizes == 2048) | (sizes & (sizes - 1) == 0)).all()
    assert len(pack(list(want.values()))) > 0 and np.all(got.offset + got.length <= 2048)


def test_run_of_edge_cases(spark, tmp_path, sf):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table through all stages."""
    from .common import edge_documents, empty_documents

    for name, docs in (("edge", edge_documents(spark)), ("empty", empty_documents(spark))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            rows = spark.read.parquet(f"{sf}/{table}.parquet")
            (rows if name == "edge" else rows.limit(0)).write.parquet(f"{folder}/{table}.parquet")
        got = pipeline.run(spark, folder).toPandas()
        if name == "empty":
            assert len(got) == 0
            continue
        # "", null and " " are two texts; 3 and 4 are copies (3 twice, and once without id); 6 to 8 are near copies.
        assert sorted(got.groupby("doc_id").length.sum().index) == [0, 2, 3, 5, 6, 9] and got[got.doc_id == 0].length.sum() == 1
        for stage_name, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns, stage_name


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
