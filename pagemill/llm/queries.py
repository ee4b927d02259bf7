"""The registered queries of the llm operators, with production parameters, and the SQL that some can be held to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, conversation_trie, embedding_dedup, fill_in_middle, host_reputation, mixing, secrets, sharding, simhash, token_counts, token_files, toxicity, winnowing
from .common import table

#: Vocabulary files of the queries; the operators take paths.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file. Only the queries that need one need its package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "top_sentence", "top_score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.token_files(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge(table(spark, sf_dir, "pages")).withColumns({c: F.round(c, 6) for c in ("rate", "low")})


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), ["doc_id"])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.withColumn("first_slot", F.get("slots", F.lit(0))).drop("slots", "copies")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), ["doc_id"])


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs), ["doc_id"]), ["doc_id"])


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    sha = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_token_files, op3_host_reputation, op4_bpe_codec, op5_mixing, op6_token_counts, op7_embedding_dedup, op8_simhash,
        op9_winnowing, op10_secrets, op11_conversation_trie, op12_fill_in_middle, op13_sharding,
    )
}
ORACLE_SQL = {
    "op3_host_reputation": host_reputation.ORACLE, "op5_mixing": mixing.ORACLE, "op11_conversation_trie": conversation_trie.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE,
}
