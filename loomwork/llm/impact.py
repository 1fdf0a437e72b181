"""Ranked lexical search over impact-ordered postings, score at a time.

A term's impact in a document is what it adds to the document's score.  Each task cuts
its documents into shards of bounded size and orders each term's postings by impact.
A query's groups of equal impact are taken in descending order over all its terms and
added up; what the terms' next groups could still add bounds every document from above.
Once that is less than the k-th best sum, no document that has not been met can be among
the k best, and those met whose sum and bound fall short of it cannot either.  Only then
the scan stops, and the scores of the others are completed from their own postings.

What a task has found so far for a query bounds its next shards' scans too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.minhash import _WordHash
from loomwork.llm.terms import hash_filter, lists, term_runs
from loomwork.workspace import Workspace


@dataclass(frozen=True)
class SearchPlan:
    """k: documents returned for a query.  step: share of the last level of impact down to
    which the next groups are taken.  shard: postings in a shard, about.  block: terms of
    the queries that are searched at once, about."""

    k: int = 10
    step: float = 0.8
    shard: int = 1 << 20
    block: int = 1 << 18


class Queries:
    """A block of queries: their terms' hashes in order, weights, and each query's terms."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.hashes, at, where = np.unique(term, return_index=True, return_inverse=True)
        self.weights = weight[at]
        order = np.argsort(query, kind="stable")
        self.ids, first = np.unique(query[order], return_index=True)
        self.terms = np.split(where[order], first[1:])


class Shard:
    """Impact-ordered postings of some documents.

    doc, term and impact are parallel and sorted by document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        self.doc_term, self.doc_impact, self.n_docs = term, impact, n_docs
        self.doc_start = np.searchsorted(doc, np.arange(n_docs + 1))
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order].astype(np.int32), impact[order]
        self.descending = -self.impact
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.asked = np.zeros(n_terms, bool)

    def top(self, terms: np.ndarray, k: int, step: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (ascending) and exact scores, among them all of the k best with a score of ``least`` or more."""
        at, end = self.start[terms], self.start[terms + 1]
        terms, at, end = terms[at < end], at[at < end], end[at < end]
        sums = np.zeros(self.n_docs, np.int64)
        while len(at):
            nexts = self.impact[at]
            bound = int(nexts.sum())
            if bound < least or (best := self._kth(sums, k)) > bound:
                break
            level = max(1, int(nexts.max() * step))
            for i in np.flatnonzero(nexts >= level):  # whole groups of equal impact: all down to the level
                to = at[i] + np.searchsorted(self.descending[at[i] : end[i]], -level, "right")
                sums[self.doc[at[i] : to]] += self.impact[at[i] : to]  # a term has one posting a document
                at[i] = to
            at, end = at[at < end], end[at < end]
        bound = int(self.impact[at].sum()) if len(at) else 0
        need = max(1, least, self._kth(sums, k))
        docs = np.flatnonzero((sums > 0) & (sums + bound >= need))
        return docs, self._complete(docs, terms) if bound else sums[docs]

    @staticmethod
    def _kth(sums: np.ndarray, k: int) -> int:
        return int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 0

    def _complete(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from their own postings."""
        if not len(docs):
            return np.empty(0, np.int64)
        first, n = self.doc_start[docs], self.doc_start[docs + 1] - self.doc_start[docs]
        ends = np.cumsum(n)
        own = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
        self.asked[terms] = True
        impact = np.where(self.asked[self.doc_term[own]], self.doc_impact[own], 0)
        self.asked[terms] = False
        return np.add.reduceat(impact, ends - n)  # a document that was met has a posting


def search(docs: DataFrame, items: DataFrame, plan: SearchPlan = SearchPlan()) -> DataFrame:
    """The ``plan.k`` documents of highest score for each item.

    Documents: doc_id and text; items: item_id and text; other columns are ignored.
    Output: item_id, rank (from 1), doc_id, score.  A document's score sums, over the
    item's distinct terms, w * ((1000000000 * tf) div (1000 * tf + 8 * m)): w is
    floor(1000 * ln((2N + 2) / (2 df + 1))), m is 10 + ((90 * n * N) div L); N counts the
    documents with a term, L all terms with repeats, n the document's, df documents with
    the term, tf the term's occurrences in the document; integers have 64 bits.  Only
    scores above 0 are returned, equal ones by ascending doc_id (null last).

    Null and empty texts have no terms and are never found, nor do they count.  Every row
    is a document or an item of its own, also where it repeats an id.  Empty tables give
    an empty result.  Terms are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "search")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            for first, terms, ends in term_runs(batch["text"], known):
                own = batch.slice(first, len(ends))
                found = [np.unique(t) for t in np.split(terms, ends[:-1])]
                rows = np.repeat(np.arange(len(ends)), list(map(len, found)))
                yield pa.RecordBatch.from_arrays([own["query"], lists(np.concatenate(found).view(np.int64), rows, len(ends))], ["query", "h"])

    numbered = items.select(F.monotonically_increasing_id().alias("query"), "item_id", F.col("text").cast("binary").alias("text"))
    numbered = work.save(numbered, "items")
    wanted = numbered.select("query", "text").mapInArrow(ask, "query long, h array<long>").select("query", F.explode("h").alias("h"))
    wanted = work.save(wanted, "wanted")
    vocabulary = work.save(wanted.select("h").distinct(), "vocabulary")
    shared = spark.sparkContext.broadcast(hash_filter(vocabulary, vocabulary.count()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, may = _WordHash(), shared.value
        for batch in batches:
            for first, terms, ends in term_runs(batch["text"], known):
                own = batch.slice(first, len(ends))
                at = np.flatnonzero(may.passes(terms))
                row = np.searchsorted(ends, at, "right")
                order = np.lexsort((terms[at], row))
                row, h = row[order], terms[at][order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
                tf = np.diff(np.append(new, len(h)))
                n = np.diff(ends, prepend=0)
                columns = [own["doc_id"], pa.array(n), lists(h[new].view(np.int64), row[new], len(ends)), lists(tf, row[new], len(ends))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h", "tf"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    postings = work.save(source.mapInArrow(index, "doc_id long, n long, h array<long>, tf array<long>"), "postings")
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = postings.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = df.join(vocabulary, "h", "left_semi").select("h", weight.alias("w")).where("w > 0")
    blocks = max(1, -(-wanted.count() // plan.block))
    asked = wanted.join(weights, "h").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    asked = work.save(asked, "asked")
    best = [_block(postings, asked.where(F.col("block") == b), int(n_docs), int(n_terms), plan) for b in range(blocks)]
    found = work.save(best[0], "found-0")
    for b, more in enumerate(best[1:], 1):
        found = found.unionByName(work.save(more, f"found-{b}"))
    work.drop("wanted", "vocabulary", "asked", "postings")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= plan.k)
    return ranked.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _block(postings: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, plan: SearchPlan) -> DataFrame:
    """Each task's best documents for a block of queries: query, doc_id, score."""
    rows = asked.select("query", "h", "w").toPandas()  # about plan.block rows
    block = Queries(rows["query"].to_numpy(np.int64), rows["h"].to_numpy(np.int64), rows["w"].to_numpy(np.int64))
    shared = postings.sparkSession.sparkContext.broadcast(block)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Shards of the task's documents: ids, whether null, and parallel document, term and impact."""
        ask, held, size = shared.value, [], 0
        for batch in batches:
            h = batch["h"].flatten().to_numpy()
            term = np.searchsorted(ask.hashes, h)
            good = ask.hashes[np.minimum(term, len(ask.hashes) - 1)] == h
            doc = np.repeat(np.arange(len(batch)), batch["h"].value_lengths().to_numpy())[good]
            term, tf = term[good], batch["tf"].flatten().to_numpy()[good]
            m = 10 + 90 * batch["n"].to_numpy()[doc] * n_docs // n_terms
            impact = ask.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            doc, term, impact = doc[impact > 0], term[impact > 0], impact[impact > 0]
            cuts = np.searchsorted(doc, np.arange(len(batch) + 1))
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + plan.shard, "right")) - 1)
                lo, hi = cuts[at], cuts[to]
                held.append((batch["doc_id"].slice(at, to - at), doc[lo:hi] - at, term[lo:hi], impact[lo:hi]))
                size += hi - lo
                at = to
                if size >= plan.shard:
                    yield _joined(held)
                    held, size = [], 0
        if held:
            yield _joined(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for ids, null, doc, term, impact in gather(batches) if len(ask.hashes) else ():
            shard = Shard(doc, term, impact, len(ids), len(ask.hashes))
            for i, terms in enumerate(ask.terms):
                had = best.get(i)
                least = int(had[2][-1]) if had and len(had[2]) == plan.k else 0
                docs, score = shard.top(terms, plan.k, plan.step, least)
                if len(docs):
                    own = (ids[docs], null[docs], score)
                    if had:
                        own = tuple(np.concatenate(x) for x in zip(had, own, strict=True))
                    order = np.lexsort((own[0], own[1], -own[2]))[: plan.k]
                    best[i] = tuple(x[order] for x in own)
        for i, (ids, null, score) in best.items():
            columns = [pa.array(np.full(len(ids), ask.ids[i])), pa.array(ids, mask=null), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return postings.where("size(h) > 0").mapInArrow(run, "query long, doc_id long, score long")


def _joined(held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(x[0]) for x in held])
    before = np.cumsum(sizes) - sizes
    ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
    doc = np.concatenate([x[1] + b for x, b in zip(held, before, strict=True)])
    return (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), doc, *(np.concatenate([x[i] for x in held]) for i in (2, 3)))
