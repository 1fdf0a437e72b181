"""Gates on running totals: rows in an order up to a number of rows or a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.workspace import Workspace


def running(df: DataFrame, order: list[Column], value: str, place: str = "place", upto: str = "upto") -> DataFrame:
    """Adds each row's place (from 1) in the order and the total of ``value`` up to it.

    Rows are dealt by ranges of the order and written; a row's figures are those in its
    range plus those of the ranges before, a table of a row a range."""
    spark = df.sparkSession
    work = Workspace(spark, "running")
    mark = "_r"
    while any(c.startswith(mark) for c in [*df.columns, place, upto]):
        mark += "_"
    keyed = df.select("*", *(c.alias(f"{mark}{i}") for i, c in enumerate(order)))
    keys = [F.col(f"{mark}{i}") for i in range(len(order))]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.save(keyed.repartitionByRange(n, *keys).withColumn(f"{mark}p", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(f"{mark}p").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    before = Window.partitionBy(F.lit(0)).orderBy(f"{mark}p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(f"{mark}p").alias(f"{mark}q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{mark}n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias(f"{mark}s"))
    own = Window.partitionBy(f"{mark}p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.select("*", F.count(F.lit(1)).over(own).alias(f"{mark}c"), F.sum(value).over(own).alias(f"{mark}t"))
    told = placed.join(F.broadcast(sums), F.col(f"{mark}p") == F.col(f"{mark}q"))  # a row a range
    return told.select(*df.columns, (F.col(f"{mark}c") + F.col(f"{mark}n")).alias(place), (F.coalesce(f"{mark}t", F.lit(0)) + F.col(f"{mark}s")).alias(upto))


def token_gate(df: DataFrame, tokens: Column, order: list[Column], most: int, rows: int | None = None, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows with tokens, place and upto; a report of one row) of rows in an order.

    Rows of over ``most`` tokens are dropped as overlong; of the others the first ``rows``
    are kept, and no more than reach ``budget`` tokens in all: the first that would pass
    it ends the scan.  tokens is any expression, as ``functions.tokens.token_count``; it is
    computed once.  Report: kept, tokens, scanned (rows up to where the scan ended),
    overlong (dropped among them)."""
    work = Workspace(df.sparkSession, "gate")
    counted = work.save(df.withColumn("tokens", tokens).withColumn("fits", F.coalesce(F.col("tokens") <= most, F.lit(False))), "counted")
    placed = running(counted.withColumn("_kept", F.when(F.col("fits"), F.col("tokens")).otherwise(0)).withColumn("_one", F.col("fits").cast("long")), order, "_kept", "scan", "upto")
    placed = work.save(running(placed, [F.col("scan")], "_one", "_again", "place"), "placed")
    inside = F.lit(True)
    if rows is not None:
        inside = inside & (F.col("place") <= rows)
    if budget is not None:
        inside = inside & (F.col("upto") <= budget)
    kept = placed.where(F.col("fits") & inside)
    last = placed.where(F.col("fits")).agg(
        F.count_if(inside).alias("kept"), F.coalesce(F.max(F.when(inside, F.col("upto"))), F.lit(0)).alias("tokens"), F.max(F.when(inside, F.col("scan"))).alias("_last"), F.count(F.lit(1)).alias("_all"),
    )
    # a scan that ends for want of rows has seen all
    full = F.lit(False) if rows is None else F.col("kept") >= rows
    ends = F.when(full, F.col("_last"))
    if budget is not None:
        over = placed.where(F.col("fits") & (F.col("upto") > budget)).agg(F.min("scan").alias("_over"))
        last, ends = last.crossJoin(over), F.least(ends, F.col("_over"))
    total = placed.agg(F.count(F.lit(1)).alias("_n"))
    last = last.crossJoin(total).select("kept", "tokens", F.coalesce(ends, F.col("_n")).alias("scanned"))  # one row each
    overlong = placed.where(~F.col("fits")).join(F.broadcast(last), F.col("scan") <= F.col("scanned")).agg(F.count(F.lit(1)).alias("overlong"))
    return kept.drop("fits", "_kept", "_one", "_again", "scan"), last.crossJoin(overlong)
