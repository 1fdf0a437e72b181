"""Sharding by histogram sort: equal bytes, rows in key order, one exchange.

Splitters are sought by counting, never by sorting or sampling: each round sums
the exact bytes below evenly spaced probes inside the key ranges that still hold
a splitter, until every splitter is within tolerance or its range is one key.
A key that is itself larger than the tolerance is split by a row number of the
written table, sought in the same way for all such keys at once.  Only then are
rows exchanged, once.

Probes and splitters are sorted arrays that narrow Arrow functions search, so the
plan's size doesn't depend on their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomwork.workspace import Workspace

#: Probes of a round, or two a range where there are more ranges.
_CELLS = 4096
_SIGN = np.uint64(1 << 63)


def _unsigned(x: pd.Series) -> np.ndarray:
    """Signed 64-bit numbers as unsigned ones in the same order."""
    return x.to_numpy(np.int64).view(np.uint64) ^ _SIGN


@dataclass
class _Span:
    """A range of keys (unsigned) within a group that holds splitters: bytes below it, goals inside."""

    group: int
    first: int
    n: int
    below: int
    goals: list[int]


def _search(spans: list[_Span], each: int) -> tuple[Callable[[pd.Series, pd.Series], pd.Series], list[tuple[int, int]]]:
    """A function of (group, key) that gives the cell's number (-1: none), and each span's (first cell, step)."""
    layout, by, at = [], {}, 0
    for i, s in enumerate(spans):
        step = -(-s.n // each)
        layout.append((at, step))
        by.setdefault(s.group, []).append(i)
        at += -(-s.n // step)
    tables = {
        g: tuple(
            np.array([f(i) for i in sorted(own, key=lambda i: spans[i].first)], np.uint64)
            for f in (lambda i: spans[i].first, lambda i: spans[i].first + spans[i].n - 1, lambda i: layout[i][1], lambda i: layout[i][0])
        )
        for g, own in by.items()
    }

    def cell(group: pd.Series, key: pd.Series) -> pd.Series:
        groups, x = group.to_numpy(np.int64), _unsigned(key)
        out = np.full(len(x), -1, np.int64)
        for g in np.unique(groups):
            if int(g) not in tables:
                continue
            first, last, step, base = tables[int(g)]
            rows = np.flatnonzero(groups == g)
            span = np.searchsorted(first, x[rows], side="right") - 1
            good = (span >= 0) & (x[rows] <= last[np.maximum(span, 0)])
            rows, span = rows[good], span[good]
            out[rows] = (base[span] + (x[rows] - first[span]) // step[span]).astype(np.int64)
        return pd.Series(out)

    return cell, layout


def _splitters(rows: DataFrame, group: Column, key: str, spans: list[_Span], goals: dict[int, int], slack: float) -> dict[int, tuple[int, int, int, int]]:
    """For each goal (bytes below): (first key at or after it, bytes below that key, bytes in its cell, keys in its cell).

    The driver sees the cells of one round: ``_CELLS``, or twice the ranges that are
    still open, which are no more than the splitters."""
    found: dict[int, tuple[int, int, int, int]] = {}
    while spans:
        cell, layout = _search(spans, max(2, _CELLS // len(spans)))
        number = F.pandas_udf(cell, "long")(group, F.col(key))
        counted = rows.select(number.alias("cell"), "size").where("cell >= 0").groupBy("cell").agg(F.sum("size")).collect()
        sums = sorted(map(tuple, counted))
        numbers = [c for c, _ in sums]
        after = []
        for span, (base, step) in zip(spans, layout, strict=True):
            lo, hi = (int(np.searchsorted(numbers, base + x)) for x in (0, -(-span.n // step)))
            todo, below = sorted(span.goals, key=goals.__getitem__), span.below
            for c, b in sums[lo:hi]:
                here = [g for g in todo if goals[g] < below + b]
                todo = todo[len(here) :]
                start = span.first + (c - base) * step
                width = min(step, span.first + span.n - start)
                rest = []
                for g in here:
                    if goals[g] - below <= slack or width == 1:
                        found[g] = (start, below, b, width)
                    elif below + b - goals[g] <= slack:
                        found[g] = (start + width, below + b, 0, 0)
                    else:
                        rest.append(g)
                if rest:
                    after.append(_Span(span.group, start, width, below, rest))
                below += b
            for g in todo:  # at the very end
                found[g] = (span.first + span.n, below, 0, 0)
        spans = after
    return found


def _place(splitters: list[tuple[int, int]]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """A function of (key, row number): how many sorted splitters (unsigned key, first row number) are at or below a row."""
    inside = [s for s in splitters if s[0] < 1 << 64]
    keys, firsts = np.array([k for k, _ in inside], np.uint64), np.array([t for _, t in inside], np.int64)

    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        x, t = _unsigned(key), tie.to_numpy(np.int64)
        out = np.searchsorted(keys, x, side="left")
        upto = np.searchsorted(keys, x, side="right")
        for k in np.unique(x[upto > out]):
            rows = np.flatnonzero(x == k)
            a, b = out[rows[0]], upto[rows[0]]
            out[rows] += np.searchsorted(firsts[a:b], t[rows], side="right")
        return pd.Series(out.astype(np.int32))

    return place


def _fresh(name: str, taken: list[str]) -> str:
    while name in {c.lower() for c in taken}:
        name += "_"
    return name


def histogram_shards(
    docs: DataFrame, key: str, size: str, shards: int = 24, tolerance: float = 0.001, part_bytes: int = 128 << 20
) -> DataFrame:
    """Deal rows in the order of an integer key into shards of near-equal bytes.

    Input: any columns, among them ``key`` (integer, null allowed) and ``size``
    (long, not negative; null counts as 0).  Output: the input's columns, shard
    (int, from 0) and slot (long, gapless from 0 within its shard, in key order); an
    input column of either name gives way to it.  A shard's bytes miss the equal
    share by ``tolerance`` of it at each end, or by one row.  Null keys come first;
    rows of one key are ordered by a number given when the table was written, so a
    key of any weight is split between shards.  An empty table gives an empty result.

    A shard is ordered in parts of about ``part_bytes``, cut by the same counting,
    so no task takes a whole shard; slots add up the parts' exact row counts.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    least = -(2**63)
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    k, b, u, p = (_fresh(n, docs.columns) for n in ("_key", "_size", "_row", "_part"))
    made = docs.select(
        *(F.col(f"`{c}`") for c in own),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(least)).alias(k),
        F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias(b),
        F.monotonically_increasing_id().alias(u),
    )
    rows = work.save(made, "rows")
    kept = [F.col(f"`{c}`") for c in own]
    n, total, lo, hi, last = rows.agg(F.count(F.lit(1)), F.sum(b), F.min(k), F.max(k), F.max(u)).first()
    if not n:
        return rows.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(1, -(-total // (shards * part_bytes)))
    count = shards * parts
    slack = tolerance * total / count
    lean = rows.select(k, u, F.col(b).alias("size"))
    goals = {i: total * i // count for i in range(1, count)}
    splitters = {i: (1 << 64, 0) for i in goals}
    if total:
        whole = _Span(0, lo + 2**63, hi - lo + 1, 0, list(goals))
        found = _splitters(lean, F.lit(0).cast("long"), k, [whole] if goals else [], goals, slack)
        splitters = {g: (key_, 0) for g, (key_, *_) in found.items()}
        heavy: dict[int, _Span] = {}
        for g, (key_, below, inside, width) in found.items():
            if width == 1 and goals[g] - below > slack:
                heavy.setdefault(key_, _Span(key_ - 2**63, 2**63, last + 1, below, [])).goals.append(g)
        if heavy:
            for g, (row, *_) in _splitters(lean, F.col(k), u, list(heavy.values()), goals, slack).items():
                splitters[g] = (splitters[g][0], row - 2**63)
    part_of = F.pandas_udf(_place(sorted(splitters.values())), "int")
    counts = dict(rows.select(part_of(k, u).alias(p)).groupBy(p).count().collect())
    starts, seen = np.zeros(count, np.int64), 0
    for i in range(count):
        seen = 0 if i % parts == 0 else seen
        starts[i] = seen
        seen += counts.get(i, 0)
    start = F.pandas_udf(lambda part: pd.Series(starts[part.to_numpy()]), "long")
    order = Window.partitionBy(p).orderBy(k, u)
    placed = rows.withColumn(p, part_of(k, u)).withColumn(u, F.row_number().over(order).cast("long"))
    return placed.select(*kept, F.expr(f"cast(`{p}` div {parts} as int)").alias("shard"), (start(p) + F.col(u) - 1).alias("slot"))
