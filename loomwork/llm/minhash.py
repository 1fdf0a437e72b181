"""b-bit MinHash near-duplicate detection with exact confirmation.

Signatures are minima of 32-bit permutations over hashed word shingles.  Full
minima give the band keys; of each minimum only the low ``bits`` are kept, packed
as bit planes, so that bit counts of two signatures estimate their similarity,
corrected for chance collisions.  Pairs that pass are confirmed on full sets.

Within a band's bucket no pairs are expanded.  First every member meets the
bucket's smallest document; so a group of thousands of near copies costs one pair
a member, and is one component.  Only buckets that are not one component are then
compared further, inside tasks over blocks of bounded size, which emit no more
than a link a member.  No pair of a bucket is skipped unless its two documents
are already connected.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.kept import let_go
from loomwork.workspace import Workspace

#: More buckets than this cannot each hold as large a share of all memberships.
_HOT = 4096


@dataclass(frozen=True)
class NearDup:
    """width: words in a shingle.  percent: smallest Jaccard similarity of a link.
    bands x rows: minima (a multiple of 32); at the threshold 85 % a link misses
    every band with probability (1 - 0.85**rows)**bands, 7e-9 here.  bits: kept of
    each minimum.  slack: of the estimate below the threshold, six standard
    deviations here.  seed: of the permutations.
    block_items: shingles of a block, about, of which one task holds two."""

    width: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 5
    bits: int = 4
    slack: float = 0.19
    seed: int = 5
    block_items: int = 500_000

    @property
    def minima(self) -> int:
        return self.bands * self.rows


class _WordHash(dict):
    """64-bit hashes of words, remembered up to a bound in bytes; long words are not."""

    room = 48 << 20

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self.room -= 160 + len(word)
            if self.room < 0:
                self.clear()
                del self.room
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int, known: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words between
    ASCII white space; fewer words than ``width`` are one shingle, no words none."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    n = len(words)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n == 0:
        return h
    k = min(n, width)
    x = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return np.unique(x)


@functools.cache
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(items: np.ndarray, plan: NearDup) -> tuple[list[int], list[int]]:
    """Packed low bits (planes of 32-bit words) and band keys of a set."""
    a, b = _permutations(plan.minima, plan.seed)
    x = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(plan.minima, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(1), out=least)
    full = _mix(least.astype(np.uint64))
    planes = [np.packbits(((full >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)).view("<i4") for p in range(plan.bits)]
    keys = np.arange(plan.bands, dtype=np.uint64)
    for row in full.reshape(plan.bands, plan.rows).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return np.concatenate(planes).tolist(), keys.view(np.int64).tolist()


def similarity(plan: NearDup, left: str, right: str) -> str:
    """SQL of the estimated similarity of two packed signatures, corrected for collisions."""
    words = plan.minima // 32
    differ = " + ".join(
        "bit_count(4294967295L & ("  # of a 64-bit number: the sign must not spread
        + " | ".join(f"({left}[{p * words + w}] ^ {right}[{p * words + w}])" for p in range(plan.bits))
        + "))"
        for w in range(words)
    )
    chance = 2.0**-plan.bits
    return f"((1 - ({differ}) / {float(plan.minima)}D) - {chance}D) / {1 - chance}D"


def compare(plan: NearDup, frame: pd.DataFrame) -> pd.DataFrame:
    """Links within a bucket's block, or between two of its blocks, that join components.

    Of the confirmed links only those that connect two components leave the task:
    at most one a member.  The packed signatures rule most pairs out by bit counts;
    the others are confirmed on full sets, one document against all at once.
    """
    frame = frame.sort_values("id", ignore_index=True)
    ids, block = frame["id"].to_numpy(), frame["block"].to_numpy()
    first, second = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    sets = [np.asarray(x, np.int64) for x in frame["items"]]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    offsets = np.concatenate([[0], np.cumsum(n)[:-1]])
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sig = np.array(frame["sig"].tolist(), np.int32).view(np.uint32).reshape(len(ids), plan.bits, -1)
    _, group = np.unique(frame["c"].to_numpy(), return_inverse=True)
    chance, least = 2.0**-plan.bits, plan.percent / 100 - plan.slack
    mark, out = np.zeros(len(distinct), bool), []
    for a in range(len(ids) - 1):
        rest = np.arange(a + 1, len(ids))
        good = group[rest] != group[a]
        if first != second:
            good &= block[rest] != block[a]
        good &= np.minimum(n[rest], n[a]) * 100 >= np.maximum(n[rest], n[a]) * plan.percent
        rest = rest[good]
        if not len(rest):
            continue
        differ = np.bitwise_count(np.bitwise_or.reduce(sig[rest] ^ sig[a], axis=1)).sum(1)
        rest = rest[((1 - differ / plan.minima) - chance) / (1 - chance) >= least]
        if not len(rest):
            continue
        own = flat[offsets[a] : offsets[a] + n[a]]
        mark[own] = True
        if len(rest) > len(ids) // 8:
            both = np.add.reduceat(mark[flat], offsets)[rest]
        else:
            both = np.array([mark[flat[offsets[b] : offsets[b] + n[b]]].sum() for b in rest])
        mark[own] = False
        for b in rest[100 * both >= plan.percent * (n[rest] + n[a] - both)]:
            if group[a] != group[b]:
                group[group == group[b]] = group[a]
                out.append((ids[a], ids[b]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Connected components of links (a, b): node and the smallest node it reaches.

    Alternating stars: every node links its larger neighbours to its smallest one,
    then its smaller neighbours likewise, until every component is one star: no node
    has two smaller neighbours, or both a smaller and a larger one.  Each step is a
    grouped minimum and a join on written tables."""
    edges = work.save(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}-0"
    )
    round_ = 0
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.save(large.where("u > v"), f"{name}-large{round_}")
        # small star
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        round_ += 1
        edges = work.save(small.where("u > v").distinct(), f"{name}-{round_}")
        work.drop(f"{name}-{round_ - 1}", f"{name}-large{round_ - 1}")


def _by_key(rows: DataFrame, told: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows joined with what is told of their key; the rows of hot keys (fewer than ``_HOT``
    keys, so a list to broadcast) stay where they are."""
    known = F.broadcast(told.join(F.broadcast(hot), "key", "left_semi"))
    return rows.join(known, "key").unionByName(rows.join(F.broadcast(hot), "key", "left_anti").join(told, "key"))


def near_duplicates(docs: DataFrame, plan: NearDup = NearDup()) -> DataFrame:
    """Classes of documents linked by similar shingle sets.

    Input: doc_id (integer) and text; other columns are ignored.  Output, one row
    per input row: doc_id, n_shingles (size of its set), component_id (smallest
    doc_id reachable, itself included), kept (doc_id = component_id).  A null text,
    or one without words, has an empty set and is linked with nothing.  Rows that
    repeat a doc_id are one document: what any of its texts is linked with is linked
    with all of them (a row without words stays alone).  A null doc_id takes no part: component null,
    kept true.  An empty table gives an empty result.  Sets are held as 64-bit
    hashes of shingles.
    """
    work = Workspace(docs.sparkSession, "neardup")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = _WordHash()
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                items = shingles(text or b"", plan.width, known)
                sig, keys = signature(items, plan) if len(items) else (None, None)
                rows.append((len(items), hashlib.md5(items.tobytes()).digest() if len(items) else None, sig, keys))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n", "fp", "sig", "keys"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    feats = work.save(
        source.mapInArrow(features, "doc_id long, n long, fp binary, sig array<int>, keys array<long>"), "features"
    )
    # equal sets are one class; only its smallest document goes on
    classes = work.save(
        feats.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")), "classes"
    )
    reps = work.save(
        feats.join(classes.drop("c"), (feats["fp"] == classes["fp"]) & (feats["doc_id"] == classes["rep"]))
        .groupBy("doc_id")  # a repeated row, or an id with two texts, stays one node for each set
        .agg(F.collect_set(F.struct("n", "sig", "keys")).alias("sets"))
        .select(F.col("doc_id").alias("id"), F.explode("sets").alias("s"))
        .select("id", "s.*"),
        "reps",
    )
    # an id that repeats with other texts is one document: it links their classes
    own = feats.where("fp IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "fp")
    several = own.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    joined = own.join(several, "doc_id", "left_semi").join(classes.drop("c"), "fp").where("doc_id <> rep")
    joined = work.save(joined.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "joined")
    members = reps.select("id", F.explode("keys").alias("key")).distinct()
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("a")).where("c > 1")
    buckets = work.save(buckets, "buckets")
    total = buckets.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = buckets.where(F.col("c") * _HOT > total).select("key")  # fewer than _HOT keys
    open_ = work.save(_by_key(members, buckets.select("key", "a"), hot), "open0")
    wanted = open_.select("id").distinct()

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        known = _WordHash()
        for frame in frames:
            yield pd.DataFrame(
                {"id": frame["doc_id"], "items": [shingles(t or b"", plan.width, known).view(np.int64) for t in frame["text"]]}
            )

    table = work.save(
        source.join(wanted, source["doc_id"] == wanted["id"], "left_semi").mapInPandas(sets, "id long, items array<long>"),
        "sets",
    )
    # first round: every member of a bucket meets the bucket's smallest document
    pairs = open_.where("a < id").select("a", F.col("id").alias("b")).distinct()
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    likely = pairs.join(left, "a").join(right, "b").where(
        (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * plan.percent)
        & (F.expr(similarity(plan, "sa", "sb")) >= plan.percent / 100 - plan.slack)
    )
    likely = work.save(likely.select("a", "b").distinct(), "likely")
    xa = table.select(F.col("id").alias("a"), F.col("items").alias("xa"))
    xb = table.select(F.col("id").alias("b"), F.col("items").alias("xb"))
    found = likely.join(xa, "a").join(xb, "b").withColumn("both", F.size(F.array_intersect("xa", "xb")))
    found = found.where(100 * F.col("both") >= plan.percent * (F.size("xa") + F.size("xb") - F.col("both")))
    found = work.save(found.select("a", "b").unionByName(joined), "links")
    comp = components(found, work, "first")
    # second round: buckets that are not one component yet are compared within bounded blocks
    rest = (
        open_.where("a < id")
        .join(comp.withColumnRenamed("node", "id"), "id", "left")
        .select("key", "id", F.coalesce("root", "id").alias("c"))
    )
    sizes = reps.groupBy("id").agg(F.sum("n").alias("n"))
    split = rest.join(sizes, "id").groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("n").alias("n"))
    split = work.save(split.where("lo <> hi").select("key", F.ceil(F.col("n") / plan.block_items).alias("blocks")), "split")
    blocked = _by_key(rest, split, hot).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    units = work.save(
        blocked.select("key", "id", "c", "block", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("o")).select(
            "key", "id", "c", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")
        ),
        "units",
    )
    facts = table.join(reps.select("id", "sig"), "id")
    more = units.join(facts, "id").groupBy("key", "i", "j").applyInPandas(lambda frame: compare(plan, frame), "a long, b long")
    more = work.save(more, "more")
    known = found.unionByName(more)
    comp = components(known, work, "all")
    work.drop("sets", "open0", "units", "likely", "reps", "buckets")
    roots = comp.select(F.col("node").alias("rep"), "root")
    named = classes.join(roots, "rep", "left").select("fp", "c", F.coalesce("root", "rep").alias("root"))
    # texts of many copies are fewer than _HOT, so their list is broadcast; texts without words and rows without an id are named by none
    rows = feats.select("doc_id", "n", "fp")
    copies = classes.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = F.broadcast(named.where(F.col("c") * _HOT > copies).drop("c"))
    known = rows.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    out = known.join(hot, "fp").unionByName(known.join(hot.select("fp"), "fp", "left_anti").join(named.drop("c"), "fp"))
    out = out.unionByName(rows.where("fp IS NULL OR doc_id IS NULL").withColumn("root", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
