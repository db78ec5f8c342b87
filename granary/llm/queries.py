"""The ``opN_`` queries: thin applications of the operators to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import chat, decontaminate, minhash_dedup, packing, quality, secrets, substring_dedup, token_counts, token_store, vector_dedup
from granary.llm.common import shared_dir, table
from granary.llm.tokens import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "markov")
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        sha256(secrets.joined(base)).alias("base_sha256"), secrets.joined(spans).alias("spans"), count("markov").alias("n_markov"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(packing.TOKENIZER))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_chats(rows.unionByName(extra)).select("conv_id", "valid", "formatted", chat.read_back(F.col("formatted")).alias("turns"))
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        sha256(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), sha256(learned).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path(token_store.TOKENIZER))
    return token_store.read_store(spark, path)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_documents(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(token_counts.MODEL))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_secret_scan, op2_packing, op3_quality, op4_chat_format, op5_token_store, op6_decontaminate, op7_vector_dedup, op8_substring_dedup, op9_minhash_dedup, op10_token_counts)}
