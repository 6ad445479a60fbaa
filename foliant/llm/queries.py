"""The queries of this subpackage: one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, chat, embed_dedup, exact_dedup, minhash, mixing, quality, secrets, suffix_dedup, url_filter
from foliant.runtime import ship, table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
VOCABULARY = "word_bpe_49k.json"


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file's content, by default of the public tokenizer of that name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return bpe.load(path)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, forest).select("doc_id", quality.held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    forest, suffixes = url_filter.train(url_filter.labelled(pages, URL_RULES))
    return url_filter.judge(pages, URL_RULES, forest, suffixes)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op6_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op 6, what the counts say of each span; a query of its own, since op6_secrets has fixed columns."""
    ship(spark)
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "spans", "verdicts")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(rows.unionByName(more))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Where SQL can express a query.
ORACLE_SQL: dict[str, str] = {"op4_exact": exact_dedup.ORACLE}
