"""The registered queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_model, license_scan, near_dedup, packing, substring_dedup, token_counts, toxicity, url_filter
from .common import ascii_lower, doc_columns, fold, read_table
from .exact_dedup import exact_groups

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; on a machine without the package, HELIXFRAME_TOKENIZERS names the folder."""
    import os

    folder = os.environ.get("HELIXFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 5, 0)
    grammar = toxicity.train(docs, read_table(spark, sf_dir, "labels"), usable=~held)
    return toxicity.score_documents(docs, grammar).select("doc_id", held.alias("held_out"), "score", "predicted", "n_clauses")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_columns(read_table(spark, sf_dir, "documents"))
    sha = F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)
    return exact_groups(docs.withColumn("text_sha256", sha), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
from n join g on n.t = g.t
"""


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_model.score(docs, ~fold(F.col("doc_id"), 7, 2))
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "coverage", "n_tiles", "n_seeded", "contaminated")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["family"])))
    best = F.coalesce(F.round(F.array_max(F.transform("findings", lambda x: x["probability"])), 6), F.lit(0.0))
    return found.select("doc_id", families.alias("families"), F.size("findings").alias("n_notices"), best.alias("probability"), (F.size("findings") > 0).alias("licensed"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_toxicity, op2_exact_dedup, op3_language_model, op4_url_filter, op5_decontamination, op6_suffix_array_dedup, op7_license_scan, op8_near_dedup, op9_token_counts, op10_packing)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL}
