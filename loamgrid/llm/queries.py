"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, html_extract, language_id, language_model, minhash_dedup, packing, phrases, quality_pu, quality_rules, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP3_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_exclamations", "n_bullet_lines", "n_ellipsis_lines"]


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(*OP3_COLUMNS)


def op4_language_id(spark, sf_dir):
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "rejected")


def op5_quality_pu(spark, sf_dir):
    found = quality_pu.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), "predicted")


def op6_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontamination(spark, sf_dir):
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op9_html_extract(spark, sf_dir):
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op10_warc_index(spark, sf_dir):
    merged = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_toxicity(spark, sf_dir):
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", F.col("toxicity").alias("score"), "predicted")


QUERIES = {
    "op1_language_model": op1_language_model,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_quality_pu": op5_quality_pu,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_html_extract": op9_html_extract,
    "op10_warc_index": op10_warc_index,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.oracle(OP3_COLUMNS),
    "op6_minhash_dedup": minhash_dedup.oracle(4, 80),
    "op8_decontamination": decontamination.oracle(),
    "op10_warc_index": warc.oracle(),
    "op11_hard_negatives": hard_negatives.oracle(),
    "op12_collocations": phrases.oracle(),
}
