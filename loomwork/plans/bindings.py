"""Views of the driver tables as question, attempt and text records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a question: its distinct part names are the options, the dearest line's is gold."""
    lines = load(spark, sf_dir, "lineitem").join(
        load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey"
    )
    line = F.struct(*LINE_ORDER, "p_name")
    per = lines.groupBy("l_orderkey").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["p_name"])).alias("options"),
        F.min_by("p_name", F.struct(-F.col("l_extendedprice"), *LINE_ORDER)).alias("gold"),
    )
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("macro_cat"), F.col("o_orderstatus").alias("source")
    )
    return (
        orders.join(per, "l_orderkey")
        .select(
            F.col("l_orderkey").alias("qid"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("question"),
            "options", "gold", (F.array_position("options", F.col("gold")) - 1).cast("int").alias("gold_idx"),
            "macro_cat", "source", F.size("options").alias("n_options"),
        )
    )


def option_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid and n_options of ``mcq``; no line is carried but for its name."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.struct("p_name").alias("name"))
    names = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    per = names.groupBy("l_orderkey").agg(F.size(F.collect_set("name")).alias("n_options"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(per, "l_orderkey").select(F.col("l_orderkey").alias("qid"), "n_options")


MCQ_SQL = """
ln AS (SELECT l.*, p_name FROM lineitem l JOIN part ON p_partkey = l_partkey),
opt AS (
  SELECT l_orderkey, p_name, min(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice, e := l_shipdate)) AS first
  FROM ln GROUP BY l_orderkey, p_name),
opts AS (SELECT l_orderkey, list(p_name ORDER BY first) AS options FROM opt GROUP BY l_orderkey),
gold AS (
  SELECT l_orderkey, p_name AS gold FROM (
    SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS r FROM ln) WHERE r = 1),
mcq AS (
  SELECT o_orderkey AS qid, 'Order ' || o_orderkey AS question, options, gold, list_position(options, gold) - 1 AS gold_idx,
    o_orderpriority AS macro_cat, o_orderstatus AS source, len(options) AS n_options
  FROM orders JOIN opts ON l_orderkey = o_orderkey JOIN gold USING (l_orderkey))
"""


def attempts(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """The first n lines of orders with at least n lines as n samples of a problem."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = load(spark, sf_dir, "lineitem").withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= n)
    right = (F.col("l_returnflag") == "R").cast("int")
    per = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("c"),
        F.sum(((F.col("l_linestatus") == "O") | (right == 1)).cast("int")).alias("boxed"),
        F.max(F.when(F.col("sample") == 1, right)).alias("first"), F.max(right).alias("any"),
    )
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("macro_cat"), F.col("o_orderstatus").alias("source")
    )
    return per.where(F.col("n") == n).join(orders, "l_orderkey")


ATTEMPTS_SQL = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS sample FROM lineitem),
att AS (
  SELECT l_orderkey, count(*) AS n, sum((l_returnflag = 'R')::INT) AS c, sum((l_linestatus = 'O' OR l_returnflag = 'R')::INT) AS boxed,
    max(CASE WHEN sample = 1 THEN (l_returnflag = 'R')::INT END) AS first, max((l_returnflag = 'R')::INT) AS any_
  FROM ranked WHERE sample <= 8 GROUP BY l_orderkey HAVING count(*) = 8),
a AS (SELECT att.*, o_orderpriority AS macro_cat, o_orderstatus AS source FROM att JOIN orders ON o_orderkey = l_orderkey)
"""
