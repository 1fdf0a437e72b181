"""The registered queries of the corpus operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import oracles
from loomwork.llm.ann import nearest_neighbours
from loomwork.llm.bpe import encode_documents
from loomwork.llm.chat import chat_conversations
from loomwork.llm.contamination import decontaminate
from loomwork.llm.impact import search
from loomwork.llm.langid import fit, held_out, predict
from loomwork.llm.minhash import near_duplicates
from loomwork.llm.mixing import mix
from loomwork.llm.quality import distribution_quality
from loomwork.llm.sharding import histogram_shards
from loomwork.llm.text import n_words
from loomwork.llm.tokenbin import word_token_file
from loomwork.llm.vafile import vector_codes
from loomwork.llm.warc import warc_archive

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Python workers get this repository on their path."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{paths}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distribution_quality(table(spark, sf_dir, "documents"))
    return out.drop("char_distance", "word_distance")


def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"))
    pred = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs.where(~held)))
    return pred.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_token_file(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    return chat_conversations(rows.unionByName(more))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), "text")
    placed = histogram_shards(docs, "doc_id", "size")
    return placed.select(
        "doc_id", "size", F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vafile_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_distribution_quality, op2_warc_dictionary, op3_language_id, op4_token_shards, op5_byte_bpe,
            op6_chat_reply_trees, op7_minhash_neardup, op8_graph_ann, op9_pivotal_mix, op10_histogram_shards,
            op11_prefix_decontamination, op12_vafile_codes, op13_impact_search,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_distribution_quality": oracles.OP1, "op2_warc_dictionary": oracles.OP2,
        "op6_chat_reply_trees": oracles.OP6, "op7_minhash_neardup": oracles.OP7,
        "op11_prefix_decontamination": oracles.OP11, "op12_vafile_codes": oracles.OP12, "op13_impact_search": oracles.OP13,
    }
