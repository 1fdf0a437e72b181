"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

A point is offered its nearest ones of the shard as neighbours, and an edge is
dropped when an already chosen neighbour is nearer to its end by the factor
``alpha``, which keeps edges of all directions.  Edges are then added backwards and
pruned again where there are too many; a few edges of each point lead to its nearest
of a thin sample and to drawn points.  Queries walk every shard's graph with a beam;
distances of what they find are computed again in double precision.

A shard grows with the table up to a bound, so the number of shards a query walks
stays the same until all are of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.workspace import Workspace


@dataclass(frozen=True)
class GraphPlan:
    """k: neighbours returned.  degree: edges of a node, ``far`` of them to a sample's nearest and
    drawn points.  near: points offered as its other neighbours.  search_beam: of the queries.
    fan: nodes of the beam that are opened together.
    alpha: relaxation of the pruning.  shard_rows, most_shard_rows: distinct vectors in a shard,
    about, of tables of up to ``shards`` shards and of larger ones.  block: queries that meet a
    shard together, so that its graph is read once for them.  walk: of these searched at once.
    batch: points whose neighbours are found at once."""

    k: int = 10
    degree: int = 24
    far: int = 4
    near: int = 48
    search_beam: int = 128
    fan: int = 4
    alpha: float = 1.2
    shard_rows: int = 4096
    most_shard_rows: int = 16384
    shards: int = 48
    block: int = 8192
    walk: int = 256
    batch: int = 256

    def shards_of(self, points: int) -> int:
        """Shards of so many distinct vectors."""
        rows = min(max(self.shard_rows, -(-points // self.shards)), max(self.shard_rows, self.most_shard_rows))
        return max(1, -(-points // rows))


class Graph:
    """A searchable graph over one shard's vectors, held about their mean."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.middle = vectors.mean(0, dtype=np.float64)
        self.x, self.edges, self.entries = (vectors - self.middle).astype(np.float32), edges, entries

    def search(self, queries: np.ndarray, beam: int, fan: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each query the beam's node numbers (-1: none) and squared distances, nearest first."""
        q = (queries - self.middle).astype(np.float32)
        b, n, fan = len(q), len(self.x), min(fan, beam)
        rows = np.arange(b)[:, None]
        start = np.broadcast_to(self.entries, (b, len(self.entries)))
        seen = np.zeros((b, n), bool)
        seen[rows, start] = True
        ids, dist = self._nearest(start, self._distance(q, start), beam)
        fresh = ids >= 0
        while True:
            best = np.argpartition(np.where(fresh, dist, np.inf), fan - 1, axis=1)[:, :fan]
            active = fresh[rows, best]
            if not active.any():
                return self._nearest(ids, dist, beam)
            fresh[rows, best] = False
            near = np.where(active[:, :, None], self.edges[np.where(active, ids[rows, best], 0)], -1).reshape(b, -1)
            r, c = np.nonzero(near >= 0)
            v = near[r, c]
            new = ~seen[r, v]
            r, c, v = r[new], c[new], v[new]
            once = np.unique(r * n + v, return_index=True)[1]
            r, c, v = r[once], c[once], v[once]
            seen[r, v] = True
            d = np.full(near.shape, np.inf, np.float32)
            apart = self.x[v] - q[r]
            d[r, c] = np.einsum("kd,kd->k", apart, apart)
            everything = np.concatenate([dist, d], 1)
            order = np.argpartition(everything, beam - 1, axis=1)[:, :beam]
            dist = everything[rows, order]
            ids = np.where(dist < np.inf, np.concatenate([ids, near], 1)[rows, order], -1)
            fresh = np.concatenate([fresh, d < np.inf], 1)[rows, order]

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        apart = self.x[ids] - q[:, None, :]
        return np.einsum("bkd,bkd->bk", apart, apart)

    @staticmethod
    def _nearest(ids: np.ndarray, dist: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(dist, 1, kind="stable")[:, :beam]
        pad = max(0, beam - order.shape[1])
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        return np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)


def _prune(x: np.ndarray, points: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of candidate rows (-1: none) for each point: at most ``degree`` diverse neighbours."""
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    alive = (ids >= 0) & (ids != points[:, None])
    v = x[np.where(ids >= 0, ids, 0)] - x[points][:, None, :]  # as seen from the point: no large numbers to cancel
    dist = np.einsum("bkd,bkd->bk", v, v)
    apart = dist[:, :, None] + dist[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    for r in range(degree):
        if not alive.any():
            break
        pick = np.argmin(np.where(alive, dist, np.inf), 1)
        has = alive[rows, pick]
        out[has, r] = ids[rows, pick][has]
        alive &= ~(has[:, None] & (alpha * alpha * apart[rows, pick] <= dist))
        alive[rows, pick] = False
    return out


def _nearest_of(x: np.ndarray, squares: np.ndarray, points: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of ``among`` to each point, itself left out (-1: none)."""
    k = min(k, len(among))
    if not k:
        return np.empty((len(points), 0), np.int32)
    d = squares[among] - 2 * (x[points] @ x[among].T)
    d[points[:, None] == among] = np.inf
    best = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.where(np.take_along_axis(d, best, 1) < np.inf, among[best], -1).astype(np.int32)


def _distinct(ids: np.ndarray) -> np.ndarray:
    """Rows of node numbers with what is repeated in a row set to -1."""
    ids = np.sort(ids, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def build(vectors: np.ndarray, plan: GraphPlan, seed: int = 7) -> Graph:
    """The graph of distinct vectors; every node can be reached from its entries.

    A point's nearest ones are found among all of the shard, whose size is bounded."""
    n = len(vectors)
    far = min(plan.far, plan.degree - 1)
    degree = plan.degree - far
    edges = np.full((n, plan.degree), -1, np.int32)
    graph = Graph(vectors, edges, np.zeros(1, np.int64))
    x = graph.x
    squares = np.einsum("nd,nd->n", x, x)
    drawn = np.random.Generator(np.random.PCG64(seed))
    every, order = np.arange(n), drawn.permutation(n)
    thin, starts = np.sort(order[: -(-n // 8)]), order[: -(-n // 64)]
    for at in range(0, n, plan.batch):
        points = every[at : at + plan.batch]
        edges[points, :degree] = _prune(x, points, _nearest_of(x, squares, points, every, plan.near), degree, plan.alpha)
        others = [_nearest_of(x, squares, points, thin, far // 2), drawn.integers(0, n, (len(points), far - far // 2), np.int32)]
        others = np.concatenate(others, 1)
        edges[points, degree : degree + others.shape[1]] = np.where(others == points[:, None], -1, others)
    near = edges[:, :degree]
    to, of = near[near >= 0], np.repeat(every, degree)[(near >= 0).ravel()]
    sort = np.argsort(to, kind="stable")
    to, of = to[sort], of[sort].astype(np.int32)
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    count = np.minimum(count, 2 * plan.near)  # of a node that very many lead to, as many are offered
    for c in range(0, len(nodes), plan.batch):
        own, f, m = nodes[c : c + plan.batch], first[c : c + plan.batch], count[c : c + plan.batch]
        wide = np.arange(m.max())
        added = np.where(wide < m[:, None], of[np.minimum(f[:, None] + wide, len(of) - 1)], -1)
        offered = _distinct(np.concatenate([near[own], added], 1))
        room = (offered >= 0).sum(1) <= degree
        packed = np.take_along_axis(offered, np.argsort(offered < 0, 1, kind="stable"), 1)[:, :degree]
        edges[own[room], :degree] = packed[room]
        if (~room).any():
            edges[own[~room], :degree] = _prune(x, own[~room], offered[~room], degree, plan.alpha)
    reached = np.zeros(n, bool)
    entries, stack = starts.tolist(), starts.tolist()
    lost = iter(range(n))
    while True:
        while stack:
            now = np.array(stack)
            stack = []
            if not reached[now].all():
                reached[now] = True
                near = np.unique(edges[now])
                near = near[near >= 0]
                stack = near[~reached[near]].tolist()
        more = next((i for i in lost if not reached[i]), None)
        if more is None:
            return Graph(vectors, edges, np.array(entries))
        entries.append(more)
        stack = [more]


def nearest_neighbours(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, plan: GraphPlan = GraphPlan()
) -> DataFrame:
    """The ``plan.k`` nearest rows to each row whose id is divisible by ``every``.

    Output: query_id, rank (from 1), vec_id, score: Euclidean distance in double
    precision on the original vectors; ties go to the smaller id; a query's own row
    is no candidate.  Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows with a null id, take no part; rows that repeat an
    id with the same vector count once.  Vectors of different lengths are never
    compared.  An empty table gives an empty result.

    Equal vectors are indexed once, with their k + 1 smallest ids (no other member
    can be among the k nearest), so a vector with many copies is one node.
    """
    work = Workspace(vectors.sparkSession, "ann")
    finite = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = work.save(
        vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
        .where("id IS NOT NULL AND v IS NOT NULL")
        .where(finite),
        "rows",
    )
    n = plan.k + 1
    same = Window.partitionBy("v")
    members = work.save(
        rows.withColumn("rank", F.dense_rank().over(same.orderBy("id")))
        .where(F.col("rank") <= n)
        .select("v", "id", F.min("id").over(same).alias("rep")),
        "members",
    )
    points = members.where("id = rep").dropDuplicates(["id", "v"])
    shards = plan.shards_of(points.count())
    parts = 2 * shards  # few shards in a task, whatever their bytes

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        x = np.stack(frame["v"].to_numpy())
        graph = build(x, plan)
        return pd.DataFrame(
            {
                "shard": [int(frame["shard"].iloc[0])],
                "dim": [x.shape[1]],
                "ids": [frame["rep"].to_numpy(np.int64).tobytes()],
                "x": [x.tobytes()],
                "edges": [graph.edges.astype(np.int32).tobytes()],
                "entries": [graph.entries.astype(np.int64).tobytes()],
            }
        )

    index = work.save(
        points.select("rep", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"))
        .repartition(parts, "shard", "dim")
        .groupBy("shard", "dim")
        .applyInPandas(make, "shard int, dim int, ids binary, x binary, edges binary, entries binary"),
        "index",
    )
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "v"])
    blocks_n = max(1, -(-queries.count() // plan.block))
    blocks = (
        queries.withColumn("dim", F.size("v"))
        .groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(blocks_n)).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("q"))
        .select("dim", "q", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    )

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                x = np.frombuffer(row.x).reshape(-1, row.dim)
                ids = np.frombuffer(row.ids, np.int64)
                graph = Graph(x, np.frombuffer(row.edges, np.int32).reshape(len(x), -1), np.frombuffer(row.entries, np.int64))
                for at in range(0, len(row.q), plan.walk):
                    own = row.q[at : at + plan.walk]
                    qid = np.array([q["id"] for q in own], np.int64)
                    q = np.array([q["v"] for q in own], np.float64)
                    found, _ = graph.search(q, plan.search_beam, plan.fan)
                    good = found >= 0
                    score = np.sqrt(((x[np.where(good, found, 0)] - q[:, None, :]) ** 2).sum(2))
                    out = pd.DataFrame({"query_id": np.repeat(qid, found.shape[1]), "rep": ids[found].ravel(), "score": score.ravel()})
                    yield out[good.ravel()]

    met = blocks.repartition(parts, "shard", "dim").join(index.repartition(parts, "shard", "dim"), ["shard", "dim"])
    hits = met.mapInPandas(walk, "query_id long, rep long, score double")
    near = Window.partitionBy("query_id").orderBy("score", "rep")
    best = hits.withColumn("r", F.row_number().over(near)).where(F.col("r") <= n).drop("r")
    best = work.save(best, "best")
    listed = members.select(F.col("rep").alias("m"), "id").distinct()
    last = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        best.join(listed, F.col("rep") == F.col("m"))
        .where("id <> query_id")
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= plan.k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
