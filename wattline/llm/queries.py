"""One query for each operator, over its whole table, with the columns of its contract; and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import (
    alignment, chat, divergence, minhash_dedup, mixing, nearest, oracles, packing, quality_classifier, quality_rules, simhash_dedup,
    substring_dedup, suffix_dedup, warc,
)
from wattline.llm.common import table


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(tricky).alias("text"))
    formatted = chat.format_records(chat.records_of_rows(rows.unionByName(more)), "record")
    turns = chat.read_turns(F.col("formatted"))
    read = formatted.select("conv_id", "layout", "formatted", turns.alias("back"),
                            chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    done = warc.warc_round(table(spark, folder, "pages"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = substring_dedup.substring_dedup(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    done = simhash_dedup.simhash_groups(table(spark, folder, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.byte_report(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.minhash_groups(table(spark, folder, "documents"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment(table(spark, folder, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_nearest": op5_nearest,
    "op6_warc": op6_warc,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash": op9_simhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_minhash": op12_minhash,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {
    "op1_quality_rules": oracles.op1(),
    "op2_chat_formatting": oracles.op2(),
    "op4_mixing": oracles.op4(),
    "op6_warc": oracles.op6(),
    "op11_source_divergence": oracles.op11(),
}
