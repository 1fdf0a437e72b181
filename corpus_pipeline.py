"""The corpus pipeline: language ID, quality rules, near-dedup, mixing, byte-level BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, written as Parquet and read again as the next stage's docs.  All but
the last return the columns of documents.

Decisions are made for rows, not for ids: a null doc_id is a row like any other,
and rows that repeat a doc_id are each judged by their own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.bpe import encode_documents
from loomwork.llm.langid import UNKNOWN, fit, held_out, predict
from loomwork.llm.minhash import NearDup, near_duplicates
from loomwork.llm.mixing import MixPlan, round_groups
from loomwork.llm.quality import distribution_quality
from loomwork.llm.queries import table, vocabulary
from loomwork.llm.text import n_words
from loomwork.workspace import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Five words a shingle, similarity 0.8 or more.  At 80 % a link misses every band with
#: probability (1 - 0.8**4)**40, 7e-10; the slack is six standard deviations there.
NEAR = NearDup(width=5, percent=80, bands=40, rows=4, slack=0.21)


#: A prediction of this score or more corrects a document's language.
SURE = 0.95


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, sure: float = SURE) -> DataFrame:
    """Drops documents without a letter, for no language can be told: null and empty texts
    among them, and every row of a table from which nothing can be learned.  The others get
    the predicted language where theirs is null or the prediction's score is ``sure`` or
    more (over 1: never), so later stages judge them by the language they are written in."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    told = predict(docs, model, carry=COLUMNS).where(F.col("lang_pred") != UNKNOWN)
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= sure), F.col("lang_pred")).otherwise(F.col("lang"))
    return told.withColumn("lang", lang).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules (null, empty and very short texts do) or
    diverge from their language; a null lang is not judged by divergence."""
    return distribution_quality(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def row_hash(seed: int) -> Column:
    """64 bits of all columns, nulls told from their absence."""
    return F.xxhash64(F.lit(seed), *(x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, ``_key``, that only rows equal in every column share.

    It is one 64-bit hash, and where two different rows have the same, as their second
    hashes tell (a few pairs in 10**10 rows), that second hash.  So no row is mistaken for
    another unless all 128 bits agree."""
    keyed = docs.select(row_hash(1).alias("_key"), row_hash(2).alias("_other"), *COLUMNS)
    clash = keyed.groupBy("_key").agg(F.min("_other").alias("lo"), F.max("_other").alias("hi")).where("lo <> hi").select("_key")
    clash = Workspace(docs.sparkSession, "clash").save(clash, "keys")
    if clash.count() == 0:
        return keyed.drop("_other")
    told = keyed.join(clash.withColumn("_clash", F.lit(True)), "_key", "left")
    return told.withColumn("_key", F.when(F.col("_clash"), F.col("_other")).otherwise(F.col("_key"))).drop("_clash", "_other")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies, by five-word shingles at 80 %: that with
    the smallest doc_id, null last.  Rows equal in every column are one.  Texts without
    words are linked with nothing and stay.  Rows are told apart by hashes of all their
    columns (``keyed_rows``), so no copy of the texts is written."""
    keyed = keyed_rows(docs)
    classes = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), NEAR)
    told = classes.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(keyed.select("_key", "doc_id").distinct(), "_key")
    first = told.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_key"))
    first = Workspace(spark, "dedup").save(first.select("_key"), "first")
    kept = keyed.join(first, "_key", "left_semi").groupBy("_key").agg(F.first(F.struct(*COLUMNS)).alias("_row"))
    return kept.select("_row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says: none, once or twice.  Rows equal in
    every column are documents of their own, and their copies are taken together.
    Documents without words are taken never."""
    work = Workspace(spark, "taken")
    keyed = keyed_rows(docs)
    sized = keyed.select(F.col("_key").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    groups = work.save(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "groups")
    rounded = round_groups(groups, MixPlan(), work)
    copies = rounded.groupBy(F.col("doc_id").alias("_key")).agg(F.sum(F.col("copies") * F.col("times")).alias("_n")).where("_n > 0")
    copies = work.save(copies, "copies")
    one = keyed.groupBy("_key").agg(F.first(F.struct(*COLUMNS)).alias("_row"))
    return one.join(copies, "_key").select("_row", F.explode(F.expr("sequence(1L, _n)")).alias("_")).select("_row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, with digests of the ids and of the decoded text;
    a null text has no ids."""
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Hash-drawn roundings and trained models are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again."""
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "stages")
    before = None
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
