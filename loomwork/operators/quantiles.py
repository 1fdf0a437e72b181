"""Exact order statistics by group through repeated counting of value ranges.

Every wanted place of every group lies in a range of values, at first the group's whole
range.  A pass over the rows counts them by a few equal parts of each open range, with
partial counts in each task; the part that holds the place is the next range, until it is
a single value.  Whole numbers of up to 64 bits need at most eleven passes at 64 parts,
text lengths two or three.  No group's values meet in one place and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.workspace import Workspace


def at_places(df: DataFrame, group: str, value: str, places: dict[str, Column], parts: int = 64) -> DataFrame:
    """The values at some places (from 0, as functions of ``n``) of each group's values in ascending order: group, n, low, high, and a column a place.

    ``value`` is a whole number; null values don't count, and a group without others gives
    no row.  A null group is a group.  A place outside 0 to n - 1 is the nearest one."""
    work = Workspace(df.sparkSession, "quantiles")
    v = F.col(value).cast("long")
    rows = df.select(F.col(group).alias("_g"), v.alias("_v")).where("_v IS NOT NULL")
    ends = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    ends = work.save(ends, "ends")
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.greatest(place, F.lit(0)), F.col("n") - 1).cast("long").alias("at")) for name, place in places.items()))
    state = ends.select("_g", F.explode(wanted).alias("w"), "low", "high").select("_g", "w.name", "w.at", "low", "high", F.lit(0).cast("long").alias("below"))
    state, turn = work.save(state, "state0"), 0
    width = "greatest(1L, cast(ceil((cast(high AS decimal(38,0)) - low + 1) / {0}) AS long))".format(parts)
    while state.where("low < high").limit(1).count():
        turn += 1
        open_ = state.where("low < high").select("_g", "low", "high").distinct().groupBy("_g").agg(F.collect_list(F.struct("low", "high", F.expr(width).alias("width"))).alias("_r"))
        met = rows.join(open_.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h")))
        ranges = F.expr("transform(filter(_r, x -> _v >= x.low AND _v <= x.high), x -> struct(x.low, x.high, x.width, cast((_v - x.low) div x.width AS int) AS part))")
        cells = met.select("_g", F.explode(ranges).alias("c")).groupBy("_g", "c.low", "c.high", "c.width", "c.part").agg(F.count(F.lit(1)).alias("m"))
        before = Window.partitionBy("_g", "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("upto", F.sum("m").over(before))  # at most ``parts`` rows a range
        told = cells.select(F.col("_g").alias("_h"), F.col("low").alias("_l"), F.col("high").alias("_u"), "width", "part", "m", "upto")
        same = F.col("_g").eqNullSafe(F.col("_h")) & (F.col("low") == F.col("_l")) & (F.col("high") == F.col("_u"))
        in_part = (F.col("at") - F.col("below") < F.col("upto")) & (F.col("at") - F.col("below") >= F.col("upto") - F.col("m"))
        first = F.col("low") + F.col("part") * F.col("width")
        nearer = state.where("low < high").join(told, same & in_part).select(
            "_g", "name", "at", first.alias("low"), F.least(F.col("high"), first + F.col("width") - 1).alias("high"), (F.col("below") + F.col("upto") - F.col("m")).alias("below")
        )
        state = work.save(nearer.unionByName(state.where("low = high")), f"state{turn}")
    found = state.groupBy("_g").agg(*(F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in places))
    out = ends.join(found.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h")))
    return out.select(F.col("_g").alias(group), "n", "low", "high", *places)


def percentiles(df: DataFrame, group: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between neighbours, as ``wanted`` (name to share): group, n, low, high, and a column each."""
    n1 = F.col("n") - 1
    places = {f"{name}_{side}": f(n1 * q) for name, q in wanted.items() for side, f in (("a", F.floor), ("b", F.ceil))}
    found = at_places(df, group, value, places)
    part = lambda q: n1 * q - F.floor(n1 * q)
    line = lambda name, q: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * part(q)
    return found.select(group, "n", "low", "high", *(line(name, q).alias(name) for name, q in wanted.items()))
