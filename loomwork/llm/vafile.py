"""Vector codes: integer product codebooks whose nearest entries are found by VA-file filtering.

A vector's components become integers and are cut into equal parts; each part is coded
by the number of its nearest codebook entry.  The entries' coordinates are quantised to
a few bits: each coordinate lies in a cell of its dimension.  For a part that is looked
up, tables by dimension and cell hold the least and the largest squared distance to
what a cell may hold; their sums bound every entry's distance from below and above.
Only entries whose lower bound is within the smallest upper bound are refined, by their
integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.workspace import Workspace

#: Larger integer components would not leave room for sums of squares in 64 bits.
_LIMIT = 1 << 26


@dataclass(frozen=True)
class CodePlan:
    """parts of a vector; entries of a part's codebook (256 at most); rounds of
    assigning and averaging; scale: of components before they are rounded down;
    bits: of a cell number; block: parts looked up at once."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    bits: int = 4
    block: int = 2048


class VaFile:
    """One part's codebook (entries by coordinates, integers) with the cells of its coordinates."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries = entries
        k, d = entries.shape
        cells = min(k, 1 << bits)
        self.cell = np.empty((d, k), np.int64)
        self.low, self.high = np.empty((d, cells), np.int64), np.empty((d, cells), np.int64)
        group = np.arange(k) * cells // k  # as many entries in one cell as in another
        first = np.searchsorted(group, np.arange(cells))
        last = np.searchsorted(group, np.arange(cells), "right") - 1
        for i in range(d):
            order = np.argsort(entries[:, i], kind="stable")
            self.cell[i, order] = group
            self.low[i], self.high[i] = entries[order[first], i], entries[order[last], i]

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each part to each entry."""
        lower = np.zeros((len(parts), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for i in range(parts.shape[1]):
            below, above = self.low[i] - parts[:, i, None], parts[:, i, None] - self.high[i]
            least = np.maximum(np.maximum(below, above), 0)
            most = np.maximum(np.abs(below), np.abs(above))
            lower += (least * least)[:, self.cell[i]]
            upper += (most * most)[:, self.cell[i]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each part's nearest entry; ties go to the smaller number."""
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        apart = parts[row] - self.entries[entry]
        dist = (apart * apart).sum(1)
        best = np.minimum.reduceat(dist, np.searchsorted(row, np.arange(len(parts))))
        equal = np.flatnonzero(dist == best[row])
        return entry[equal[np.searchsorted(row[equal], np.arange(len(parts)))]], best


def _coded(batch: pa.RecordBatch, files: list[VaFile], block: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a batch: rows, parts (row, part, place), entry numbers and distances (row, part)."""
    flat = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    parts = flat.reshape(len(batch), len(files), -1)
    for at in range(0, len(parts), block):
        own = parts[at : at + block]
        found = [file.nearest(own[:, j]) for j, file in enumerate(files)]
        yield slice(at, at + len(own)), own, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", plan: CodePlan = CodePlan()) -> DataFrame:
    """Product codes of all vectors.

    Every component x becomes floor(scale * x).  A part's codebook begins as that part of
    the ``entries`` rows of smallest id (null last; of rows that repeat an id, the
    smaller vector first); each round every part is assigned to its nearest entry and
    every entry that has parts becomes the floor of their mean.

    Output, one row per vector kept: vec_id, code (entry numbers, two hex digits a part),
    error (squared distances summed over the parts), label_error (error summed over equal
    labels, nulls together; null if that is beyond 64 bits), codebooks_sha256 (of the
    final entries' components).  Other columns are ignored.  Vectors that are null or
    hold null or non-finite components take no part, nor do those whose length is not
    that of the smallest id's vector, nor those with a scaled component beyond 2**26,
    whose errors would not fit.  That length must be a multiple of ``parts`` (else an
    error tells so); an empty table gives an empty result.

    The codebooks, parts * entries rows, go through the driver, and sums of each task.
    """
    if not 0 < plan.entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    work = Workspace(spark, "codes")
    scaled = F.transform(F.col(embedding).cast("array<double>"), lambda x: x * plan.scale)
    small = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LIMIT))
    kept = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.transform(F.when(small, scaled), lambda x: F.floor(x).cast("int")).alias("v"))
    kept = work.save(kept.where("size(v) > 0"), "rows")
    order = (F.col("id").asc_nulls_last(), F.col("v"))
    first = kept.select("id", "v").orderBy(*order).limit(plan.entries).collect()
    size = len(first[0].v) if first else plan.parts
    if size % plan.parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {plan.parts} equal parts")
    rows = kept.where(F.size("v") == size)
    if any(len(r.v) != size for r in first):
        first = rows.select("id", "v").orderBy(*order).limit(plan.entries).collect()
    width = size // plan.parts
    books = np.array([r.v for r in first], np.int64).reshape(len(first), plan.parts, width).transpose(1, 0, 2).copy()

    for _ in range(plan.rounds if first else 0):
        shared = spark.sparkContext.broadcast([VaFile(book, plan.bits) for book in books])

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            files = shared.value
            n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                for _, own, entry, _ in _coded(batch, files, plan.block):
                    for j in range(len(files)):
                        np.add.at(n[j], entry[:, j], 1)
                        np.add.at(sums[j], entry[:, j], own[:, j])
            part, entry = np.nonzero(n)
            columns = [pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

        total = rows.select("v").mapInArrow(gather, "part long, entry long, n long, sums array<long>").groupBy("part", "entry")
        sums = total.agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))).collect()
        for r in sums:  # parts * entries rows at most
            books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]  # Python's division rounds down
        shared.unpersist()

    shared = spark.sparkContext.broadcast([VaFile(book, plan.bits) for book in books] if first else [])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                for at, _, entry, dist in _coded(batch, shared.value, plan.block):
                    own = batch.slice(at.start, at.stop - at.start)
                    codes = pa.array([c.tobytes().hex() for c in entry.astype(np.uint8)])
                    yield pa.RecordBatch.from_arrays([own["id"], own["label"], codes, pa.array(dist.sum(1))], ["id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = work.save(rows.select("id", "label", "v").mapInArrow(assign, f"id long, label {kind}, code string, error long"), "coded")
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.expr("try_sum(error)").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("l")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
