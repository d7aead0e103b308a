"""Approximate nearest neighbours: a robust-pruned directed graph in every shard.

Vectors are dealt by id to shards, as many as the cluster has cores as long as
these fit a task, so a query's work grows with the shards' depth and not with
their number; beyond, shards keep the largest size that fits.  In a shard, points enter the
graph in growing batches: a greedy search over the graph so far proposes
neighbours, relaxed distance pruning keeps a diverse few of them (a candidate
goes if a kept one is nearer to it, by the factor ALPHA, than the point is), and
edges are added in both directions.  A query walks every shard by beam search
from the point nearest the shard's mean; the shards' nearest are merged.
Reported scores are exact.  Equal vectors are one point of the graph.  Distances
within a graph are those of vectors scaled to the shard's spread, so very large
and very small ones neither overflow nor vanish; a walk that finds fewer points
than asked for gives way to a look at the whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.llm import common

#: Rows below which a shard is not split for the sake of cores, and most bytes of a shard's vectors.
SHARD, SHARD_BYTES = 4096, 1 << 25
#: Queries of a block, edges of a point, beams of building and search, pruning factor, points a step expands.
BLOCK, DEGREE, BUILD_BEAM, BEAM, ALPHA, EXPAND = 256, 32, 64, 128, 1.2, 4


def _order(x: np.ndarray, sq: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its points, less the query's own square."""
    return sq[at] - 2 * np.einsum("md,mkd->mk", q, x[at])


def _near(x: np.ndarray, sq: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its points."""
    return np.maximum(sq[at] - 2 * np.einsum("md,mkd->mk", q, x[at]) + np.einsum("md,md->m", q, q)[:, None], 0)


def beam(x: np.ndarray, sq: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` nearest points that a greedy walk finds for each query, nearest first (-1: none).

    The query's own square is left out of distances: it orders nothing, and of a
    far query it would drown the rest.
    """
    m, n = len(q), len(x)
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, start] = seen[:, n] = True
    rows = np.arange(m)[:, None]
    ids = np.full((m, width), n)
    dist = np.full((m, width), np.inf, dtype=np.float32)
    done = np.ones((m, width), dtype=bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = _order(x, sq, q, np.full((m, 1), start))[:, 0]
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argsort(open_, axis=1, kind="stable")[:, :EXPAND]
        usable = np.take_along_axis(open_, pick, 1) < np.inf
        some = usable.any(axis=1)
        live, pick, usable = live[some], pick[some], usable[some]
        if not len(live):
            break
        sel = rows[live]
        done[sel, pick] = True
        near = edges[np.where(usable, ids[sel, pick], n)].reshape(len(live), -1)
        near = np.where(seen[sel, near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[sel, near] = True
        d = np.where(near < n, _order(x, sq, q[live], np.minimum(near, n - 1)), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[live] = np.take_along_axis(all_d, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near >= n], axis=1), keep, 1)
    return np.where(np.isinf(dist), -1, ids)


def prune(x: np.ndarray, sq: np.ndarray, cand: np.ndarray, dist: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """The edges that relaxed pruning keeps of each point's candidates (sorted by distance; -1: none)."""
    m, k = cand.shape
    v = x[cand]
    mutual = np.maximum(sq[cand][:, :, None] + sq[cand][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    alive = cand >= 0
    out = np.full((m, degree), -1)
    rows = np.arange(m)
    for j in range(degree):
        any_ = alive.any(axis=1)
        if not any_.any():
            break
        first = alive.argmax(axis=1)
        out[any_, j] = cand[rows, first][any_]
        alive &= ~((alpha * alpha * mutual[rows, first] <= dist) & any_[:, None])
        alive[rows, first] = False
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Edges (n + 1 rows, n standing for none) and the starting point of distinct float32 vectors."""
    n = len(x)
    sq = np.einsum("nd,nd->n", x, x)
    start = int(np.argmin(np.einsum("nd,nd->n", x - x.mean(axis=0), x - x.mean(axis=0))))
    edges = np.full((n + 1, DEGREE), n)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]])

    def settle(who: np.ndarray, cand: np.ndarray) -> None:
        """Prunes each point's candidates (n or -1: none) to its edges."""
        cand = np.where((cand >= n) | (cand == who[:, None]), -1, cand)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        d = np.where(cand >= 0, _near(x, sq, x[who], cand), np.inf)
        by = np.argsort(d, axis=1, kind="stable")[:, : 3 * DEGREE]
        kept = prune(x, sq, np.take_along_axis(cand, by, 1), np.take_along_axis(d, by, 1))
        edges[who] = np.where(kept < 0, n, kept)

    # each pass goes over all points; the second sees the whole graph
    for again in (False, True):
        at = 1 if not again else 0
        while at < n:
            size = 256 if again else min(256, max(1, at))
            who = order[at : at + size]
            found = beam(x, sq, edges, start, x[who], BUILD_BEAM)
            settle(who, np.concatenate([found, edges[who]], axis=1))
            # the other direction
            to, back = edges[who].ravel(), np.repeat(who, DEGREE)
            to, back = to[to < n], back[to < n]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            heads, first, count = np.unique(to, return_index=True, return_counts=True)
            more = np.full((len(heads), int(count.max()) if len(count) else 0), n)
            more[np.repeat(np.arange(len(heads)), count), np.arange(len(to)) - np.repeat(first, count)] = back
            both = np.concatenate([edges[heads], more], axis=1)
            room = (both < n).sum(axis=1) <= DEGREE
            if room.any():
                packed = np.sort(both[room], axis=1)
                packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = n
                edges[heads[room]] = np.sort(packed, axis=1)[:, :DEGREE]
            for i in range(0, int((~room).sum()), 512):
                settle(heads[~room][i : i + 512], both[~room][i : i + 512])
            at += size
    return edges, start


def _scaled(v: np.ndarray, mean: np.ndarray, unit: float) -> np.ndarray:
    """Vectors around a mean in units of the shard's spread, in single precision; halves keep differences of huge vectors finite.

    Of a vector very far off, its direction is what orders the shard's points.
    """
    with np.errstate(over="ignore"):
        x = (v / 2 - mean / 2) / unit
    x = np.nan_to_num(x, posinf=1e300, neginf=-1e300)
    return (x * np.minimum(1, 1e9 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300))).astype(np.float32)


def _frame(points: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean of a shard's points and the largest component around it (halved)."""
    mean = (points / len(points)).sum(axis=0)
    return mean, max(float(np.abs(points / 2 - mean / 2).max()), 5e-324)


def _distances(points: np.ndarray, found: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances of each query to its points in double precision, components added in their order.

    Where squares would overflow or vanish, both vectors are scaled by a power of two.
    """
    total, top = np.zeros(found.shape), np.zeros(found.shape)
    with np.errstate(over="ignore", under="ignore"):
        for j in range(points.shape[1]):
            d = points[found, j] - queries[:, j : j + 1]
            total += d**2
            np.maximum(top, np.abs(d), out=top)
    out = np.sqrt(total)
    for i, k in zip(*np.nonzero((top > 1e150) | ((top < 1e-150) & (top > 0))), strict=True):
        p, q = points[found[i, k]], queries[i]
        unit = 2.0 ** min(1000, max(-1000, int(np.floor(np.log2(max(top[i, k] if np.isfinite(top[i, k]) else 1e308, 5e-324))))))
        with np.errstate(over="ignore"):
            out[i, k] = np.sqrt(((p / unit - q / unit) ** 2).sum()) * unit
    return out


def _matrix(t: pa.Table) -> np.ndarray:
    """The vectors of a group's rows, which have one length."""
    flat = t.column("v").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def _index(t: pa.Table) -> pa.Table:
    """One row with the graph of a shard's rows."""
    ids = t.column("id").to_numpy()
    v = _matrix(t)
    _, first, back = np.unique(v, axis=0, return_index=True, return_inverse=True)
    edges, start = build(_scaled(v[first], *_frame(v[first])))
    by = np.lexsort((ids, back.ravel()))
    ends = np.cumsum(np.bincount(back.ravel()))
    cols = {"ids": ids[by], "ends": ends, "points": v[first], "edges": edges.astype(np.int32)}
    return pa.table({"dim": t.column("dim").slice(0, 1), "shard": t.column("shard").slice(0, 1), "start": pa.array([start], pa.int32())} | {k: pa.array([a.tobytes()], pa.binary()) for k, a in cols.items()})


class _Shard:
    """A shard's graph, read from its row."""

    def __init__(self, row: dict):
        self.key = row["dim"], row["shard"]
        self.start, dim = row["start"], row["dim"]
        self.ids, self.ends = (np.frombuffer(row[c], np.int64) for c in ("ids", "ends"))
        self.points = np.frombuffer(row["points"], np.float64).reshape(-1, dim)
        self.edges = np.frombuffer(row["edges"], np.int32).reshape(-1, DEGREE)
        self.frame = _frame(self.points)
        self.x = _scaled(self.points, *self.frame)
        self.sq = np.einsum("nd,nd->n", self.x, self.x)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
        """The k nearest of each query."""
        points, ids, ends = self.points, self.ids, self.ends
        found = beam(self.x, self.sq, self.edges, self.start, _scaled(queries, *self.frame), max(BEAM, 4 * k))
        score = np.where(found < 0, np.inf, _distances(points, found, queries))
        # the query's own point may be among them
        short = (found >= 0).sum(axis=1) < min(k + 1, len(points))
        if short.any():
            most = max(found.shape[1], min(len(points), k + 1))
            found = np.pad(found, ((0, 0), (0, most - found.shape[1])), constant_values=-1)
            score = np.pad(score, ((0, 0), (0, most - score.shape[1])), constant_values=np.inf)
            for i in np.flatnonzero(short):
                d = _distances(points, np.arange(len(points))[None], queries[i : i + 1])[0]
                by = np.lexsort((ids[np.append(0, ends[:-1])], d))[:most]
                found[i], score[i] = -1, np.inf
                found[i, : len(by)], score[i, : len(by)] = by, d[by]
        out = []
        for i, q in enumerate(qids.tolist()):
            near = []
            for j in np.argsort(score[i], kind="stable"):
                if found[i, j] < 0 or (len(near) >= k and score[i, j] > near[k - 1][0]):
                    break
                a, b = (ends[found[i, j] - 1] if found[i, j] else 0), ends[found[i, j]]
                # of equal vectors no more than k + 1 can matter
                near += [(score[i, j], v, q) for v in ids[a : min(b, a + k + 1)].tolist() if v != q]
                near.sort()
            out += near[:k]
        return pa.RecordBatch.from_pydict({"query_id": pa.array([r[2] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[0] for r in out], pa.float64())})


def _walk(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by shard, its graph first and then its queries: one graph at a time is held."""
    shard = None
    for b in batches:
        starts = b.column("start").to_pylist()
        keys = list(zip(b.column("dim").to_pylist(), b.column("shard").to_pylist(), strict=True))
        at = 0
        while at < b.num_rows:
            if starts[at] is not None:
                shard = _Shard(b.slice(at, 1).to_pylist()[0])
                at += 1
                continue
            end = at + 1
            while end < min(b.num_rows, at + BLOCK) and starts[end] is None and keys[end] == keys[at]:
                end += 1
            # no vector of the query's length fell into this shard: none of it is near
            if shard is not None and shard.key == keys[at]:
                part = pa.table({"v": b.column("v").slice(at, end - at)})
                yield shard.search(b.column("id").slice(at, end - at).to_numpy(), _matrix(part), k)
            at = end


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance, without the row of the query's own id.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows with a null id; vectors of different lengths are
    not compared.  Ties go to the smaller id.  Rows that share an id are one
    (one of them, if their vectors differ).  Fewer than k candidates: all of
    them.  Empty tables give no rows; other columns are not read.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        own = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return own.where(fine).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))

    base = common.materialize(usable(vectors), "vectors")
    asked = common.materialize(usable(queries), "queries")
    rows, components = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(1, -(-components * 8 // SHARD_BYTES), min(-(-rows // SHARD), vectors.sparkSession.sparkContext.defaultParallelism))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    shape = "dim int, shard int, start int, ids binary, ends binary, points binary, edges binary"
    # few rows, much work: by range, so that each shard is a task of its own
    index = common.materialize(dealt.repartitionByRange(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(_index, shape), "graph")
    # queries travel to every shard, behind its graph; the rows of a shard are read in that order
    graphs = index.withColumns({"id": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>")})
    visits = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "v")
    both = graphs.unionByName(visits, allowMissingColumns=True).withColumn("turn", F.col("start").isNull())
    ordered = both.repartitionByRange(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "turn").drop("turn")
    found = ordered.mapInArrow(lambda it: _walk(it, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(100)) == 0))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
