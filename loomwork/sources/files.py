"""File sources and sinks: explicit schemas, strict or lenient JSON lines, keyed answers, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.operators.rows import by_position
from loomwork.operators.scoring import boxed_count
from loomwork.workspace import Workspace


def jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): malformed lines are set aside, not lost."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    whole = F.try_parse_json("value").isNotNull()
    return parsed.where(whole).select("r.*"), parsed.where(~whole).select("value")


def unpivot_categories(df: DataFrame, items: str, category: str = "category") -> DataFrame:
    """A map of category to items as rows."""
    return df.select(F.explode(items).alias(category, "_items")).select(category, F.explode("_items").alias("item"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the files at ``path``: file, line_no, row_no, value.

    line_no is a line's place in its file, from 1; row_no its place among all lines that are
    not blank, the files in the order of their paths (null for a blank one).  A file is
    read in as many splits as Spark makes of it: a task counts through each of its splits,
    and a small table with a row a split tells how many lines stand before it."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", F.col("value").rlike(r"\S").alias("filled")
    )
    split = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"), F.count_if("filled").alias("filled"))
    split = Workspace(spark, "lines").save(split, "splits")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_file, in_all = before(Window.partitionBy("file").orderBy("split")), before(Window.partitionBy(F.lit(0)).orderBy("file", "split"))
    starts = split.select(
        F.col("file").alias("_f"), F.col("split").alias("_s"),
        F.coalesce(F.sum("lines").over(in_file), F.lit(0)).alias("_lines"), F.coalesce(F.sum("filled").over(in_all), F.lit(0)).alias("_rows"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places within a split: a split's lines follow each other in its task."""
        last, n_lines, n_rows = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch["key"].to_numpy(), batch["split"].to_numpy()], 1)
            filled = batch["filled"].to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.concatenate([[last is None or (key[0] != last).any()], (key[1:] != key[:-1]).any(1)])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))  # -1: the split of the batch before goes on
            upto = np.cumsum(filled)
            line = np.arange(len(key)) - first + 1 + np.where(first < 0, n_lines - 1, 0)
            row = upto - np.where(first < 0, -n_rows, np.where(first > 0, upto[first - 1], 0))
            last, n_lines, n_rows = key[-1], int(line[-1]), int(row[-1])
            columns = [batch["file"], batch["split"], pa.array(line), pa.array(np.where(filled > 0, row, 0), mask=filled == 0), batch["value"]]
            yield pa.RecordBatch.from_arrays(columns, ["file", "split", "line", "row", "value"])

    placed = lines.select(F.xxhash64("file").alias("key"), "file", "split", "filled", "value").mapInArrow(count, "file string, split long, line long, row long, value string")
    few = split.count() <= 1_000_000
    told = placed.join(F.broadcast(starts) if few else starts, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s")))
    return told.select("file", (F.col("line") + F.col("_lines")).alias("line_no"), (F.col("row") + F.col("_rows")).alias("row_no"), "value")


def jsonl_numbered(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with file, line_no and row_no (see ``numbered_lines``); blank lines give no row, a malformed one fails the job."""
    lines = numbered_lines(spark, path).where("row_no IS NOT NULL")
    return lines.select("file", "line_no", "row_no", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "line_no", "row_no", "r.*")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two numbered files (or folders of files) side by side by row_no; unequal lengths are an error."""
    return by_position(left.drop("file", "line_no"), right.drop("file", "line_no"), "row_no")


def with_answers(questions: DataFrame, answers: DataFrame, key: str = "id", letters: str = "ABCDEFGHIJKLMNOPQRST") -> DataFrame:
    """Questions with the answer of a keyed table, by the key as text; a number becomes its letter.

    A question without an answer, or a number without a letter, fails the job."""
    k = answers.select(F.col(key).cast("string").alias("_k"), "answer")
    named = F.array(*map(F.lit, letters))
    found = questions.join(k, F.col(key).cast("string") == F.col("_k"), "left")
    ok = F.assert_true(F.col("answer").isNotNull() & F.col("answer").between(0, len(letters) - 1), "a question has no answer")
    return found.withColumn("_ok", ok).where("_ok IS NULL").withColumn("answer", F.get(named, F.col("answer"))).drop("_k", "_ok")


def answer_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, answer) of a JSON object whose keys are ids and whose values hold an answer."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<answer: int>>")
    return whole.select(F.explode(entries).alias("id", "v")).select("id", "v.answer")


def from_path(df: DataFrame, pattern: str, **groups: int) -> DataFrame:
    """Columns from the file's path by the groups of a pattern."""
    return df.select("*", *(F.regexp_extract("_metadata.file_path", pattern, g).alias(n) for n, g in groups.items()))


def runs_below(spark: SparkSession, root: str, name: str, pattern: str, **groups: int) -> DataFrame:
    """Files called ``name`` anywhere below ``root``: path and columns from it by the groups of a pattern.

    Files whose path the pattern does not match are left out."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    return listed.where(F.col("path").rlike(pattern)).select("path", *(F.regexp_extract("path", pattern, g).alias(n) for n, g in groups.items()))


SCORED = """benchmark_method string, n_problems long, n_completions long, metrics map<string, double>,
 detailed_results array<struct<index: long, prompt: string, reference: string, n: long, c: long, boxed: long,
 completions: array<struct<extracted: string, correct: boolean, boxed: boolean>>>>"""


def scored_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row a scored file: file, its metrics, and box_compliance from its details where they lack it.

    A file without metrics or details is an error."""
    raw = spark.read.schema(SCORED).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    ok = F.assert_true(F.col("metrics").isNotNull() & F.col("detailed_results").isNotNull(), "not a scored file")
    boxed = F.aggregate("detailed_results", F.lit(0).cast("long"), lambda s, d: s + F.coalesce(boxed_count(d["boxed"], d["completions"]), F.lit(0)))
    made = F.aggregate("detailed_results", F.lit(0).cast("long"), lambda s, d: s + F.size(d["completions"]))
    held = raw.withColumn("_ok", ok).where("_ok IS NULL")
    rate = F.coalesce(F.try_element_at("metrics", F.lit("box_compliance")), F.when(made > 0, boxed / made))
    return held.select("file", "benchmark_method", "n_problems", "metrics", rate.alias("box_compliance"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, as they are in UTF-8, null fields left out."""
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_chunks(df: DataFrame, path: str, chunk: str) -> None:
    """Rows in a directory for each value of ``chunk``: a chunk written again replaces its own rows, and
    readers of ``path`` see whole chunks only, as the committer publishes them together."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], most: int = 1_000_000) -> None:
    """A report: fixed columns, header, one file; more than ``most`` rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a report of over {most} rows")
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(spark: SparkSession, sections: dict[str, DataFrame], path: str, most: int = 10_000) -> dict[str, list[dict]]:
    """A small JSON document with the rows of each section; a section of over ``most`` rows is an error."""
    report = {}
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"section {name} has over {most} rows")
        report[name] = [r.asDict(recursive=True) for r in rows]
    text = json.dumps(report, ensure_ascii=False, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return report


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the sink does not hold yet, one row a key; returns them as written."""
    fresh = df.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti").select(*df.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    written = Workspace(spark, "append").save(fresh, "rows")
    written.write.mode("append").parquet(path)
    return written
