"""Scores of responses: status, compliance, rewards and reports, as grouped expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import answers
from loomwork.workspace import Workspace


def compliance(box: Column, text: Column) -> dict[str, Column]:
    """Share with an extracted box, percentage with one that is not empty, share that holds the mark."""
    n = F.count(F.lit(1))
    return {
        "extracted": F.count(box) / n,
        "filled_pct": 100.0 * F.count_if(box != "") / n,
        "marked": F.count_if(text.contains("\\boxed{")) / n,
    }


def status(text: Column, letter: Column, gold: Column) -> Column:
    """How a response ended."""
    return (
        F.when(~text.contains("</think>"), "truncated_no_close").when(letter.isNull(), "no_answer")
        .when(letter != gold, "wrong_answer").otherwise("correct")
    )


def shares(df: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """Rows of each key and their percentage of all, by one aggregate and its total."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))  # one row
    return counts.join(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.col("all"), digits).alias("pct"))


def pooled(df: DataFrame, sections: list[str], right: str, digits: int = 6) -> DataFrame:
    """Right rows of all rows in percent, by each of several columns, in one pass."""
    sets = df.groupingSets([[F.col(s)] for s in sections], *sections).agg(
        F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("total"),
        *(F.grouping(s).alias(f"_{s}") for s in sections),
    )
    own = lambda value: F.coalesce(*(F.when(F.col(f"_{s}") == 0, value(s)) for s in sections))
    pct = F.round(100.0 * F.col("correct") / F.col("total"), digits)
    return sets.select(own(F.lit).alias("section"), own(F.col).alias("key"), "correct", "total", pct.alias("accuracy_pct"))


def _problems(df: DataFrame, by: str, keep: dict[str, Column], right: Column, formatted: Column) -> DataFrame:
    return df.groupBy(by).agg(
        *(e.alias(n) for n, e in keep.items()), F.count(F.lit(1)).alias("n"), F.count_if(right).alias("c"), F.count_if(formatted).alias("b"),
        F.min_by(formatted, F.col("attempt")).alias("first"),
    )


def breakdown(df: DataFrame, by: str, category: str, right: Column, formatted: Column, weak: float = 0.8) -> DataFrame:
    """Right responses a problem by category, weakest categories flagged; null is Unknown."""
    per = _problems(df, by, {"category": F.coalesce(F.max(category), F.lit("Unknown"))}, right, formatted)
    ratio = F.sum("c") / F.count(F.lit(1))
    return per.groupBy("category").agg(
        F.sum("c").alias("correct"), F.count(F.lit(1)).alias("total"), F.round(ratio, 6).alias("ratio"),
        F.count_if(~F.col("first")).alias("no_format"), (ratio < weak).alias("weak"),
    )


def level_report(df: DataFrame, by: str, sections: dict[str, str], right: Column, formatted: Column) -> DataFrame:
    """pass@1, pass@8 and box rate by each section; blank values get the section's own name.

    A problem of other than its section's number of responses is an error."""
    keep = {s: F.coalesce(F.max(F.nullif(F.col(s), F.lit(""))), F.lit(name)) for s, name in sections.items()}
    per = _problems(df, by, keep, right, formatted)
    sets = per.groupingSets([[F.col(s)] for s in sections], *sections).agg(
        F.count(F.lit(1)).alias("problems"), F.round(F.avg(F.col("c") / F.col("n")), 6).alias("pass_1"),
        F.round(F.avg(answers.pass_at_k(F.col("n"), F.col("c"), 8)), 6).alias("pass_8"),
        F.round(F.sum("b") / F.sum("n"), 6).alias("box_rate"),
        F.assert_true(F.min("n") == F.max("n"), "a group mixes numbers of responses").alias("_ok"),
        *(F.grouping(s).alias(f"_{s}") for s in sections),
    )
    own = lambda value: F.coalesce(*(F.when(F.col(f"_{s}") == 0, value(s)) for s in sections))
    held = sets.where("_ok IS NULL")
    return held.select(own(F.lit).alias("section"), own(F.col).alias("key"), "problems", "pass_1", "pass_8", "box_rate")


def boxed_count(stored: Column, completions: Column) -> Column:
    """The stored count, else flags of the responses, else which were extracted; null without any response."""
    flag = lambda c: F.coalesce(c["boxed"], c["extracted"].isNotNull()).cast("long")
    counted = F.aggregate(completions, F.lit(0).cast("long"), lambda n, c: n + flag(c))
    return F.coalesce(stored.cast("long"), F.when(F.size(completions) > 0, counted))


def binary_reward(predicted: Column, answer: Column) -> Column:
    """1 if both are the same characters, else 0; null is wrong."""
    return F.when(predicted == answer, 1.0).otherwise(0.0)


def graded(found: DataFrame, extracted: str, reference: str, method: str) -> DataFrame:
    """``found`` with ``correct``: whether an extracted answer matches its reference; null matches nothing.

    Normal forms cost far more than a row's way through an exchange, and answers repeat: each pair of
    an answer and a reference is graded once, spread over as many tasks as a shuffle has, and joined back.
    ``found`` is read twice, so it should be a written table."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, r = F.col(extracted), F.col(reference)
    pairs = found.where(x.isNotNull() & r.isNotNull()).select(x.alias("_x"), r.alias("_r")).distinct().repartition(n, F.xxhash64("_x", "_r"))
    right = Workspace(found.sparkSession, "pairs").save(pairs.select("_x", "_r", answers.correct(F.col("_x"), F.col("_r"), method).alias("correct")), "graded")
    told = found.join(right.where("correct"), (x == F.col("_x")) & (r == F.col("_r")), "left")
    return told.withColumn("correct", F.coalesce("correct", F.lit(False))).drop("_x", "_r")


def score_file(items: DataFrame, method: str, at: str = "index") -> tuple[DataFrame, DataFrame]:
    """(detailed results a row, metrics of one row) of a generation file.

    Items: ``at`` (a row's place), prompt, reference, answer, completions (array).  The
    reference goes before the answer.  Errors: no rows, a row without either, a row without
    completions, rows with different numbers of them.  Details: ``at``, prompt, reference,
    n, c, completions (extracted, correct).  Metrics: benchmark_method, n_problems,
    n_completions, pass_1 and, from eight completions on, pass_8 (else null)."""
    work = Workspace(items.sparkSession, "graded")
    gold = F.coalesce(F.col("reference").cast("string"), F.col("answer").cast("string"))
    own = items.select(at, "prompt", gold.alias("reference"), "completions")
    found = F.transform("completions", lambda t: answers.extract(t, F.col("reference"), method))
    rows = work.save(own.select(at, "prompt", "reference", found.alias("found")), "found")  # lines are read and answers extracted once
    n = F.coalesce(F.size("found"), F.lit(0))
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("low"), F.max(n).alias("high"), F.count_if(F.col("reference").isNull()).alias("bare"))
    held = sizes.select(  # one row
        F.coalesce(
            F.assert_true(F.col("rows") > 0, "the generation file is empty"), F.assert_true(F.col("bare") == 0, "a row has neither reference nor answer"),
            F.assert_true(F.col("low") > 0, "a row has no completions"), F.assert_true(F.col("low") == F.col("high"), "rows have different numbers of completions"),
        ).alias("_ok")
    )
    held.collect()  # one row; raises before anything is graded
    each = graded(rows.select(at, "prompt", "reference", F.posexplode("found").alias("_i", "extracted")), "extracted", "reference", method)
    per = each.groupBy(at).agg(
        F.any_value("prompt").alias("prompt"), F.any_value("reference").alias("reference"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "extracted", "correct"))), lambda x: F.struct(x["extracted"].alias("extracted"), x["correct"].alias("correct"))).alias("completions"),
    )
    details = work.save(per, "details")  # grouped once, for the details and the metrics
    rate = lambda k: F.avg(F.when(F.col("n") >= k, answers.pass_at_k(F.col("n"), F.col("c"), k)))
    metrics = details.agg(
        F.lit(method).alias("benchmark_method"), F.count(F.lit(1)).alias("n_problems"), F.max("n").alias("n_completions"), rate(1).alias("pass_1"), rate(8).alias("pass_8")
    )
    return details, metrics
