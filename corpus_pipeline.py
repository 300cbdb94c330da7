"""Corpus pipeline: toxicity, exact dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared folder
and rereads it as the next stage's docs. All stages but the last return the columns of ``documents``, whatever they are.

Defined results, in every stage: a null text counts as empty; empty texts are no toxic and no contaminated documents, are one
group of exact copies, have no near-duplicates and pack as their end id; a row without an id can stay, but is never what a
group of others is kept by; repeated rows (one id, one text) become one row in the exact stage; where one id has several
texts, the near-duplicate stage keeps all of its rows if it keeps one; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontamination, near_dedup, packing, toxicity
from helixframe.llm.common import fold, read_table, shared_dir, swept, written
from helixframe.llm.exact_dedup import distinct_documents
from helixframe.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. The grammar learns from labelled rows of its input."""
    grammar = toxicity.train(docs, read_table(spark, sf_dir, "labels"), usable=~fold(F.col("doc_id"), 5, 0))
    return toxicity.score_documents(docs, grammar, prefix="_tox_").where("_tox_predicted = 0").select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for the case of A-Z) one row stays, with the smallest doc_id."""
    return distinct_documents(docs, keep="min")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    kept = near_dedup.near_duplicates(docs).where("kept or doc_id is null").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more, in any order of its passages, go."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), prefix="_leak_").where("not _leak_contaminated").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained grammar and a tokenizer decide rows, which SQL can't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table. A stage's own tables go once its result is written, which the next stage reads."""
    folder = shared_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with swept(spark):
            docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
