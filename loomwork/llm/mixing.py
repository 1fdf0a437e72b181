"""Mixing sources to target weights by pivotal dependent rounding, natively.

Every document starts with the copy probability target / size of its source.
Its whole part is taken at once; the fractional parts are rounded in pairs:
word mass moves at random from one document of a pair to the other until one
of the two probabilities is 0 or 1.  Each move keeps both expectations and the
pair's word mass, so a chunk of documents ends with one fractional document,
and chunks of such documents are rounded in the same way, level by level, until
a source has one left.  A source's words miss its target by less than that
document's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.workspace import Workspace


@dataclass(frozen=True)
class MixPlan:
    """weights: given to the sources in code-point order (null last), repeating.
    share: words of the mix by words of the table.  most: largest number of times
    a source may be taken.  chunk: documents rounded in one fold.  seed: of the
    random moves."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    chunk: int = 256
    seed: int = 17


def targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """source, source_size, target, n_docs: weighted shares, stopped at ``most``
    times a source's size, what is over being shared again by weight.

    The sources stop in the order of size by weight, so one ordered pass over the
    sums (a row a source) finds the level that all others reach."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, plan.weights)), (F.col("place") % len(plan.weights)).cast("int") + 1)
    sums = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_docs"))
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
    )
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.lit(plan.share) * F.sum("source_size").over(everything)
        - plan.most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    stopped = plan.most * F.col("source_size") <= F.col("level") * F.col("weight")
    first = F.min(F.when(~F.col("stopped"), F.struct("at", "level"))).over(everything)["level"]
    out = (
        sums.withColumn("level", level)
        .withColumn("at", F.row_number().over(fill))
        .withColumn("stopped", stopped)
        .withColumn("common", first)
    )
    target = F.when(
        F.col("common").isNull() | (plan.most * F.col("source_size") <= F.col("common") * F.col("weight")),
        (plan.most * F.col("source_size")).cast("double"),
    ).otherwise(F.col("common") * F.col("weight"))
    return out.select("source", "source_size", target.alias("target"), "n_docs")


def _unit(*parts: str) -> str:
    """A number in [0, 1) from hashed parts, as SQL."""
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) / 9007199254740992.0D)"


def _fold(seed: int, level: int) -> str:
    """Rounds ``items`` (doc_id, size, m, p) in order; SQL for struct<cur, out>.

    The largest documents come first, so that the one left over is small.

    A pair moves up with probability down / (up + down), where up and down are
    the word masses by which the first of the two can grow or shrink; the
    document that became whole goes to ``out``, the other stays as ``cur``."""
    mass = "(x.size * x.m)"
    cur = "(a.cur.size * a.cur.m)"
    up = f"least((1 - a.cur.p) * {cur}, x.p * {mass})"
    down = f"least(a.cur.p * {cur}, (1 - x.p) * {mass})"
    draw = _unit("a.cur.doc_id", "a.cur.size", "x.doc_id", "x.size", f"{seed}L", f"{level}L")
    grow = f"({up} + {down} = 0 OR {draw} * ({up} + {down}) < {down})"
    done = lambda who, p: f"named_struct('doc_id', {who}.doc_id, 'size', {who}.size, 'm', {who}.m, 'p', {p})"
    state = lambda keep, p, out, q: f"named_struct('cur', {done(keep, p)}, 'out', concat(a.out, array({done(out, q)})))"
    # first of the pair reaches 1, or the second 0; first reaches 0, or the second 1
    growing = (
        f"CASE WHEN (1 - a.cur.p) * {cur} <= x.p * {mass}"
        f" THEN {state('x', f'greatest(0.0D, x.p - {up} / {mass})', 'a.cur', '1.0D')}"
        f" ELSE {state('a.cur', f'least(1.0D, a.cur.p + {up} / {cur})', 'x', '0.0D')} END"
    )
    shrinking = (
        f"CASE WHEN a.cur.p * {cur} <= (1 - x.p) * {mass}"
        f" THEN {state('x', f'least(1.0D, x.p + {down} / {mass})', 'a.cur', '0.0D')}"
        f" ELSE {state('a.cur', f'greatest(0.0D, a.cur.p - {down} / {cur})', 'x', '1.0D')} END"
    )
    step = f"CASE WHEN {grow} THEN {growing} ELSE {shrinking} END"
    item = "struct<doc_id:bigint,size:bigint,m:bigint,p:double>"
    return (
        f"aggregate(slice(items, 2, size(items)), CAST(named_struct('cur', items[0], 'out', array())"
        f" AS struct<cur:{item},out:array<{item}>>), (a, x) -> CAST({step} AS struct<cur:{item},out:array<{item}>>))"
    )


def round_groups(groups: DataFrame, plan: MixPlan, work: Workspace) -> DataFrame:
    """How often documents enter the mix, equal ones together.

    Input: one row for each doc_id, source, size (long, not null) and m, the number of
    its equal rows.  Output: doc_id, source, size, source_size, target, copies, times:
    so many of its rows get so many copies.  A group may have several output rows; their
    times add up to m.

    Of m equal rows with the fractional probability p, floor(m p) get one copy more
    and at most one row, with what remains of m p, is rounded against other documents.
    """
    goal = work.save(targets(groups.select("source", (F.col("size") * F.col("m")).alias("size")), plan), "targets")
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    items = groups.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    items = items.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0)).withColumn("whole", F.floor("rate"))
    more = F.col("m") * (F.col("rate") - F.col("whole"))
    items = items.withColumn("up", F.floor(more)).withColumn("p", more - F.floor(more))
    same = ["source", "source_size", "target", "whole"]
    told = lambda copies, times: F.struct(copies.cast("long").alias("copies"), times.cast("long").alias("times"))
    open_ = (F.col("p") > 0).cast("long")
    known = F.array(told(F.col("whole") + 1, F.col("up")), told(F.col("whole"), F.col("m") - F.col("up") - open_))
    parts = [items.select(*same, "doc_id", "size", F.explode(known).alias("k")).select(*same, "doc_id", "size", "k.*").where("times > 0")]
    left = items.where("p > 0").select(*same, "n_docs", "doc_id", "size", F.lit(1).cast("long").alias("m"), "p")
    level, chunks = 0, most
    while chunks > 1 or level == 0:
        chunks = -(-chunks // plan.chunk)
        n = F.greatest(F.ceil(F.col("n_docs") / plan.chunk ** (level + 1)), F.lit(1))
        spread = F.xxhash64("doc_id", "size", F.lit(plan.seed), F.lit(level))
        folded = work.save(
            left.withColumn("chunk", F.pmod(spread, n))
            .groupBy(*same, "n_docs", "chunk")
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("k"), spread.alias("h"), "doc_id", "size", "m", "p"))).alias("items"))
            .withColumn("items", F.expr("transform(items, i -> struct(i.doc_id, i.size, i.m, i.p))"))
            .select(*same, "n_docs", F.expr(_fold(plan.seed, level)).alias("f")),
            f"level{level}",
        )
        parts.append(
            folded.select(*same, F.explode("f.out").alias("x")).select(
                *same, "x.doc_id", "x.size", (F.col("whole") + F.col("x.p").cast("long")).alias("copies"), F.lit(1).cast("long").alias("times")
            )
        )
        left = folded.select(*same, "n_docs", "f.cur.*")
        level += 1
    last = F.expr(f"{_unit('doc_id', 'size', f'{plan.seed}L', '-1L')} < p")
    parts.append(left.select(*same, "doc_id", "size", (F.col("whole") + last.cast("long")).alias("copies"), F.lit(1).cast("long").alias("times")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), "times")


def mix(sizes: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """How often each document enters the mix.

    Input: doc_id long, source string, size long (words; null counts as 0); other
    columns are ignored.  Output, one row per input row: doc_id, source, size,
    source_size, target, copies (long, at most plan.most).  Null sources form one
    source, ordered last.  Rows that repeat doc_id, source and size are documents of
    their own and may get different copies; a null doc_id is a value like any
    other.  Documents of size 0 get no copies.  An empty table gives an empty
    result.  Random moves depend on the seed and the rows alone, so reruns agree.
    """
    work = Workspace(sizes.sparkSession, "mix")
    groups = work.save(
        sizes.select(F.col("doc_id").cast("long"), "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("m")),
        "documents",
    )
    rounded = round_groups(groups, plan, work)
    return rounded.select("*", F.explode(F.expr("sequence(1L, times)")).alias("_")).drop("_", "times")
