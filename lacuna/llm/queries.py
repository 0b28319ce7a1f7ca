"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, importance, line_spread, mixing, quality_rules, repeats, simhash, token_counts, tokenbin, toxicity
from .common import documents, scratch_dir


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).select("doc_id", "log_weight", "gumbel_key", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_boilerplate(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(documents(spark, sf_dir), shingle_words=3, max_bits=2)
    return groups.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _third(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels").where(~_third()))
    return toxicity.score(docs, model).select("doc_id", _third().alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    automaton = token_counts.Automaton(token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return token_counts.count_tokens(documents(spark, sf_dir), automaton)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenbin.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenbin.read_tokens(spark, path, digest=True)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).drop("n_lines", "first_failed")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, sf_dir), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), width=10)
    ids = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


#: Names and queries, in the order of the operators.
QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_token_output": op6_token_output,
    "op7_source_mixing": op7_source_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op3_benchmark_decontamination": decontaminate.CONTAMINATION_SQL,
        "op7_source_mixing": f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.oracle()}) t",
        "op9_line_dedup": line_spread.SQL,
    }
