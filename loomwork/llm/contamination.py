"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of an item, or all words of a shorter one, seen
as the set of its word shingles and their places.  Shingles are ordered by how rare they
are in all documents.  A document's window that holds the asked share of an item's
window must hold one of its rarest shingles, the prefix; so only those are joined, each
match fixes where the document's window would begin, places outside the document are
ruled out, and the others are confirmed by all shingles at their places.

One pass reads the texts.  It keeps of every document the places of shingles that
some item may have, told by a filter of bounded size; everything after that are joins
of what was kept, so neither items nor matches are gathered in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.minhash import _WordHash
from loomwork.llm.terms import hash_filter, lists, shingle_hashes, term_runs
from loomwork.workspace import Workspace


@dataclass(frozen=True)
class WindowPlan:
    """width: words in a window.  shingle: words in a shingle (a shorter window is one
    shingle).  percent: of a window's shingles that a document's window must hold at
    the same places; 100 is the whole window, word by word."""

    width: int = 10
    shingle: int = 5
    percent: int = 100


def item_windows(items: DataFrame, plan: WindowPlan) -> DataFrame:
    """Every window of every item: item (its id as a string), wid (of equal windows), k
    (words in a shingle), len (words), w (shingle hashes in order)."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHash()
        for frame in frames:
            for item, text in zip(frame["item"], frame["text"], strict=True):
                (_, terms, ends), *_ = term_runs(pa.array([text], pa.binary()), known)
                n = int(ends[-1])
                if n:
                    size = min(n, plan.width)
                    k = min(size, plan.shingle)
                    rows = np.lib.stride_tricks.sliding_window_view(shingle_hashes(terms, k), size - k + 1)
                    yield pd.DataFrame(
                        {"item": item, "wid": [hashlib.md5(bytes([k, size]) + r.tobytes()).digest() for r in rows], "k": k, "len": size, "w": list(rows.view(np.int64))}
                    )

    source = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    return source.mapInPandas(cut, "item string, wid binary, k int, len int, w array<long>")


def contaminated_spans(docs: DataFrame, items: DataFrame, plan: WindowPlan, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words), hits (row, start, len, wid) and items of windows (wid, item)."""
    windows = work.save(item_windows(items, plan), "windows")
    distinct = work.save(windows.dropDuplicates(["wid"]).select("wid", "k", "len", "w"), "distinct")
    shingles = work.save(distinct.select(F.explode("w").alias("h")).distinct(), "shingles")
    widths = sorted(r.k for r in distinct.select("k").distinct().collect())  # at most plan.shingle
    shared = docs.sparkSession.sparkContext.broadcast(hash_filter(shingles, shingles.count()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, may = _WordHash(), shared.value
        for batch in batches:
            for first, terms, ends in term_runs(batch["text"], known):
                starts = np.concatenate([[0], ends[:-1]])
                rows, places, hashes = [], [], []
                for k in widths:
                    x = shingle_hashes(terms, k)
                    at = np.flatnonzero(may.passes(x))
                    row = np.searchsorted(ends, at, "right")
                    whole = at + k <= ends[row]
                    rows.append(row[whole])
                    places.append((at - starts[row])[whole].astype(np.int32))
                    hashes.append(x[at[whole]].view(np.int64))
                row = np.concatenate([np.empty(0, np.int64), *rows])
                order = np.argsort(row, kind="stable")
                own = batch.slice(first, len(ends))
                kept = [
                    lists(np.concatenate([np.empty(0, kind), *found])[order], row[order], len(ends))
                    for found, kind in ((places, np.int32), (hashes, np.int64))
                ]
                yield pa.RecordBatch.from_arrays([own["row"], own["doc_id"], pa.array(ends - starts), *kept], ["row", "doc_id", "n_words", "at", "h"])

    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    feats = work.save(source.mapInArrow(find, "row long, doc_id long, n_words long, at array<int>, h array<long>"), "features")
    # rarity over all documents; what no document holds has no row here and joins with nothing
    seen = feats.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    seen = work.save(seen.join(shingles, "h", "left_semi"), "seen")
    need = F.ceil(F.size("w") * plan.percent / 100)
    ranked = distinct.select("*", F.posexplode("w").alias("i", "h")).join(seen, "h")
    ranked = ranked.groupBy("wid").agg(
        F.first("len").alias("len"), F.first("w").alias("w"), F.sort_array(F.collect_list(F.struct("df", "h", "i"))).alias("r")
    )
    # shingles that no document holds are the rarest of the prefix
    prefix = ranked.withColumn("need", need).withColumn("take", F.size("r") - F.col("need") + 1).where("take > 0")
    prefix = work.save(prefix.select("wid", "len", "w", "need", F.explode(F.expr("slice(r, 1, cast(take AS INT))")).alias("p")).select("*", "p.h", "p.i").drop("p"), "prefix")
    reach = max(0, plan.width - plan.shingle)
    low = F.greatest(F.col("j") - reach, F.lit(0))
    near = lambda name: F.slice(name, (low + 1).cast("int"), (F.col("j") + reach + 1 - low).cast("int"))
    matches = feats.where("size(h) > 0").select("row", "n_words", "at", F.col("h").alias("hs"), F.posexplode("h").alias("j", "h"))
    matches = matches.select("row", "n_words", "h", F.expr("at[j]").alias("place"), F.arrays_zip(near("at").alias("at"), near("hs").alias("h")).alias("near"))
    start = (F.col("place") - F.col("i")).alias("start")
    bounded = matches.join(prefix, "h").select("row", "n_words", start, "len", "wid", "w", "need", "near").where("start >= 0 AND start + len <= n_words")
    asked = F.expr("transform(w, (x, i) -> struct(start + i AS at, x AS h))")
    hits = bounded.where(F.size(F.array_intersect("near", asked)) >= F.col("need")).select("row", "start", "len", "wid")
    if plan.percent < 100:
        hits = hits.distinct()
    hits = work.save(hits, "hits")
    work.drop("distinct", "shingles", "seen", "prefix")
    return feats.select("row", "doc_id", "n_words"), hits, windows.select("wid", "item")


def decontaminate(docs: DataFrame, items: DataFrame, plan: WindowPlan = WindowPlan()) -> DataFrame:
    """What of each document occurs in the items' windows.

    Documents: doc_id and text; items: item_id and text; other columns are ignored.
    Output, one row per document row: doc_id, n_words, n_hit (words inside any
    occurrence of a window), n_items and items_sha256 (of the ids of items with
    occurring windows, sorted as strings and comma-joined), contaminated (n_hit > 0).

    Null and empty texts have no words: such a document has no hits, such an item no
    windows.  Rows that repeat a doc_id are judged each; rows that repeat an item_id
    are one item, and so are those with a null one, named by an empty string.  Empty
    tables give no rows, or rows without hits.  Texts are read whole, whatever their
    length.  Words are compared as 64-bit hashes.
    """
    work = Workspace(docs.sparkSession, "leaks")
    rows, hits, named = contaminated_spans(docs, items, plan, work)
    before = Window.partitionBy("row").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    covered = hits.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    found = hits.select("row", "wid").distinct().join(named.distinct(), "wid").select("row", "item").distinct()
    found = found.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = rows.join(covered, "row", "left").join(found, "row", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
