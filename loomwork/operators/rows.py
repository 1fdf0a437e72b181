"""Row selection: ordered dedup, layering, blocklists, hash-ordered samples and splits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.workspace import Workspace


def hash_order(seed: int, *keys: str) -> Column:
    """Order of all samples: MD5 of seed and key, the same in every SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by ``order``: a grouped minimum, so that partial results shrink before the shuffle."""
    rest = [c for c in df.columns if c not in (key, *order)]
    row = F.struct(*order, *rest)
    return df.groupBy(key).agg(F.min(row).alias("_r")).select(key, "_r.*").select(*df.columns)


def last_wins(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The value of each key's last row by ``order``; blank values don't count."""
    kept = df.where(F.trim(F.coalesce(F.col(value), F.lit(""))) != "")
    return kept.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def without(df: DataFrame, block: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not in ``block``."""
    return df.join(block.select(*keys), list(keys), "left_anti")


def capped_first_wins(sources: list[DataFrame], key: str, order: str, cap: int) -> DataFrame:
    """First-wins over ordered sources, each stopped at ``cap`` rows: keys past a source's
    cap are not seen, so a later source may still give them."""
    work, kept = Workspace(sources[0].sparkSession, "capped"), []
    for i, df in enumerate(sources):
        fresh = reduce(lambda d, k: without(d, k, key), kept, df)
        one = first_wins(fresh, key, order)
        kept.append(work.save(one.orderBy(order).limit(cap), f"source{i}"))  # read by every later source
    return reduce(DataFrame.unionByName, kept)


def rank_in(df: DataFrame, by: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """Rows ranked at most ``limit`` within each group; groups are cut in each task before they meet."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= limit)


def round_robin(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """One row a stratum and turn until n: rank in the stratum is the turn."""
    turn = rank_in(df, [stratum], order, n, "turn")
    return turn.orderBy("turn", stratum).limit(n)


def numbered(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank", total: str = "total") -> DataFrame:
    """Adds each row's place (from 1) in its group and the group's size, with no group in one task.

    Rows are dealt by ranges of group and order and written; a row's place is its place in
    its range plus the rows of its group in the ranges before, a small table of a row a
    range and group.  A column range is bounded by the session's shuffle partitions.  The
    input's columns keep their names and values, whatever they are called; ``rank`` and
    ``total`` must be new."""
    if {rank, total} & set(df.columns):
        raise ValueError(f"{rank} or {total} is a column already")
    spark = df.sparkSession
    work = Workspace(spark, "numbered")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own_ = "_n"
    while any(c.startswith(own_) for c in [*df.columns, rank, total]):
        own_ += "_"
    part, place, many, before_ = f"{own_}p", f"{own_}at", f"{own_}n", f"{own_}before"
    keyed = df.select("*", *(c.alias(f"{own_}o{i}") for i, c in enumerate(order)))
    keys = [F.col(f"{own_}o{i}") for i in range(len(order))]
    dealt = work.save(keyed.repartitionByRange(n, *map(F.col, by), *keys).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part, *by).agg(F.count(F.lit(1)).alias(many))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before_, F.coalesce(F.sum(many).over(before), F.lit(0))).withColumn(total, F.sum(many).over(group))
    counts = counts.select(F.col(part).alias(f"{own_}q"), *(F.col(b).alias(f"{own_}b{i}") for i, b in enumerate(by)), before_, total)
    same = F.col(part) == F.col(f"{own_}q")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"{own_}b{i}"))
    own = F.row_number().over(Window.partitionBy(part, *by).orderBy(*keys))
    placed = dealt.withColumn(place, own.cast("long")).join(counts, same)
    return placed.select(*df.columns, (F.col(place) + F.col(before_)).alias(rank), total)


def split_at(df: DataFrame, seed: int, key: str, cuts: list[tuple[str, float]], last: str, by: list[str] | None = None) -> DataFrame:
    """Exact cuts of the hash order: floor(fraction * n) rows each, the rest is ``last``; within ``by`` if given."""
    edges = [(name, lambda n, share=share: F.floor(n * share)) for name, share in cuts]
    return split_by(df, seed, key, edges, last, by)


def split_by(df: DataFrame, seed: int, key: str, cuts: list[tuple[str, Callable[[Column], Column]]], last: str, by: list[str] | None = None) -> DataFrame:
    """Cuts of the hash order whose sizes are given by functions of the group's size."""
    ranked = numbered(df, by or [], [hash_order(seed, key), F.col(key)], "_at", "_size")
    return ranked.withColumn("split", cut_label(cuts, last)).drop("_at", "_size")


def cut_label(cuts: list[tuple[str, Callable[[Column], Column]]], last: str) -> Column:
    """The name of the cut that a row's place ``_at`` of ``_size`` is in; sizes of cuts are functions of ``_size``."""
    label, edge, bounds = F.lit(last), F.lit(0), []
    for name, size in cuts:
        edge = edge + size(F.col("_size"))
        bounds.append((name, edge))
    for name, edge in reversed(bounds):
        label = F.when(F.col("_at") <= edge, name).otherwise(label)
    return label


def drawn(df: DataFrame, seed: int, key: str, n: int) -> DataFrame:
    """n rows in hash order, all if there are fewer; each task keeps its own first n."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def keyed_last(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's value in its last row by ``order``, null values included."""
    return df.groupBy(key).agg(F.max(F.struct(order, value))[value].alias(value))


def by_position(left: DataFrame, right: DataFrame, at: str) -> DataFrame:
    """Rows of both sides with the same position; sides of different lengths are an error."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sizes = count(left, "_l").join(count(right, "_r"))  # one row
    ok = sizes.select(F.assert_true(F.col("_l") == F.col("_r"), "the sides differ in length").alias("_ok"))
    return left.join(right, at).join(F.broadcast(ok)).where("_ok IS NULL").drop("_ok")


def incomplete(items: DataFrame, done: DataFrame, key: str, wanted: int) -> DataFrame:
    """Items that have fewer than ``wanted`` rows in ``done``; those begun are to be done anew."""
    whole = done.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= wanted).select(key)
    return items.join(whole, key, "left_anti")


def good_prefix(df: DataFrame, at: str, good: Column) -> DataFrame:
    """Rows before the first bad one, by position."""
    bad = df.where(~F.coalesce(good, F.lit(False))).agg(F.min(at).alias("_first"))  # one row
    return df.join(F.broadcast(bad)).where(F.col("_first").isNull() | (F.col(at) < F.col("_first"))).drop("_first")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """One row a key; a key that repeats is an error."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*[c for c in df.columns if c != key])).alias("_r"))
    held = per.withColumn("_ok", F.assert_true(F.col("_n") == 1, f"{key} repeats")).where("_ok IS NULL")
    return held.select(key, "_r.*").select(*df.columns)


def stratified(df: DataFrame, by: str, seed: int, key: str, share: float, name: str = "test", last: str = "train") -> DataFrame:
    """Adds ``split``: ceil(share * n) rows of all n are ``name``, each stratum's part of them as near its own share as whole rows allow.

    A stratum gets its share rounded down; the rows then missing go one each to the strata
    that lost most by it, ties in the order of their names.  Rows are drawn in hash order."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_c"))
    all_ = Window.partitionBy(F.lit(0))  # a row a stratum
    sizes = sizes.withColumn("_n", F.sum("_c").over(all_)).withColumn("_t", F.ceil(F.col("_n") * share).cast("long"))
    sizes = sizes.withColumn("_base", F.expr("_c * _t div _n")).withColumn("_rest", F.expr("_c * _t % _n"))
    turn = F.row_number().over(all_.orderBy(F.desc("_rest"), F.col(by).asc_nulls_first()))
    take = F.col("_base") + (turn <= F.col("_t") - F.sum("_base").over(all_)).cast("long")
    sizes = sizes.select(F.col(by).alias("_s"), take.alias("_take"))
    ranked = numbered(df, [by], [hash_order(seed, key), F.col(key)], "_at", "_size")
    told = ranked.join(sizes, F.col(by).eqNullSafe(F.col("_s")))
    return told.withColumn("split", F.when(F.col("_at") <= F.col("_take"), name).otherwise(last)).select(*df.columns, "split")


def equal_share(df: DataFrame, by: str, order: list[Column], total: int) -> DataFrame:
    """total // (number of groups) rows of each group, in order; a group that has fewer is an error."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    share = total // max(1, sizes.count())
    ok = sizes.agg(F.assert_true(F.coalesce(F.min("n"), F.lit(share)) >= share, f"a group has fewer than {share} rows").alias("_ok"))  # one row
    return rank_in(df, [by], order, share).join(F.broadcast(ok)).where("_ok IS NULL").drop("_ok")


def group_batches(df: DataFrame, by: str, key: str, size: int, seed: int, epoch: int = 0) -> DataFrame:
    """Batches of ``size`` rows of one group each: adds batch (in its group, from 0) and place (of the batch among all, from 1).

    Rows within a group and the batches of all groups are in hash orders of seed and epoch,
    so every epoch has other batches in another order; a group's last incomplete batch is
    left out.  Batches are numbered by a row each."""
    ranked = numbered(df, [by], [hash_order(seed + epoch, key), F.col(key)], "_at", "_size")
    full = ranked.where(F.expr(f"(_at - 1) div {size} < _size div {size}")).withColumn("batch", F.expr(f"(_at - 1) div {size}"))
    full = Workspace(df.sparkSession, "batches").save(full.drop("_at", "_size"), "rows")
    heads = full.select(F.col(by).alias("_g"), F.col("batch").alias("_b")).distinct()
    draw = F.md5(F.concat_ws("|", F.lit(str(seed + epoch)), F.coalesce(F.col("_g").cast("string"), F.lit("")), F.col("_b").cast("string")))
    heads = numbered(heads, [], [draw, F.col("_g"), F.col("_b")], "place", "_all").drop("_all")
    return full.join(heads, F.col(by).eqNullSafe(F.col("_g")) & (F.col("batch") == F.col("_b"))).drop("_g", "_b")


def recipe(pools: list[tuple[str, DataFrame, int]], key: str, stratum: str, block: DataFrame, seed: int, at: str) -> DataFrame:
    """Rows of each pool (name, rows, number wanted) in turn by stratum, adds ``part``.

    A pool's rows are those whose key is neither blocked nor in an earlier pool, one a key
    (the first by ``at``); of these the wanted number is taken, one a stratum and turn in
    hash order of ``at``, or all if there are no more."""
    seen, out = block.select(key), None
    for name, df, wanted in pools:
        fresh = first_wins(without(df, seen, key), key, at)
        picked = round_robin(fresh, stratum, [hash_order(seed, at), F.col(at)], wanted).drop("turn").withColumn("part", F.lit(name))
        out = picked if out is None else out.unionByName(picked)
        seen = seen.unionByName(df.select(key))
    return out
