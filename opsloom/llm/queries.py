"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, chat, decontam, jaccard, langid, linededup, mixing, phrases, pii, quality, sharding, suffixdedup, tokencount, twins
from .common import benchmark, documents, new_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", F.size("langs").alias("n_langs"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.find_repeats(documents(spark, sf_dir)).drop("spans")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.size("runs").cast("bigint").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"))


def op3_long_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op3_line_dedup, but a single line of LONG_LINE words is a run too."""
    out = linededup.drop_repeated_lines(documents(spark, sf_dir), min_words=linededup.LONG_LINE)
    return out.select("doc_id", "n_lines", "n_removed", F.size("runs").cast("bigint").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(documents(spark, sf_dir), key=pii.session_key(spark))
    return out.select("doc_id", F.size("findings").alias("n_found"), F.transform("findings", lambda f: f["kind"]).alias("kinds"), "text")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), tokencount.default_vocabulary())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_once(documents(spark, sf_dir), new_path(spark, "shards"), target_bytes=128 << 20)
    return out.select("doc_id", "source", "n_chars", F.col("shard.id").alias("shard_id"), F.col("shard.rows").alias("shard_rows"), F.col("shard.bytes").alias("shard_bytes"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as chains of replies, formatted, and read back from the formatted texts."""
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, chat.SPOKEN, control)], "conv_id bigint, turn bigint, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    out = chat.format_trees(chat.thread(rows), unique=True)
    read = out.select(F.col("tree").alias("conv_id"), chat.read_turns(F.col("text")).alias("turns"), chat.read_loss(F.col("text"), F.col("loss")).alias("said"), F.length("text").cast("bigint").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("said").cast("bigint").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars",
    )


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best(phrases.mine(documents(spark, sf_dir)))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summary(*centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


_ALL = (
    op1_language_id, op2_suffix_dedup, op3_line_dedup, op3_long_line_dedup, op4_pii_pseudonyms, op5_jaccard_join, op6_token_counts,
    op7_quality_rules, op8_decontamination, op9_sharding, op10_mixing, op11_chat_formatting, op12_phrase_mining, op13_centroid_clustering,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op3_line_dedup": linededup.oracle(),
    "op3_long_line_dedup": linededup.oracle_long(),
    "op5_jaccard_join": twins.jaccard(),
    "op7_quality_rules": twins.quality_rules(),
    "op8_decontamination": twins.decontamination(),
    "op10_mixing": mixing.oracle(),
    "op11_chat_formatting": chat.oracle(),
    "op12_phrase_mining": phrases.oracle(),
    "op13_centroid_clustering": centroids.oracle(),
}
