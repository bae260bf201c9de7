"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension sampling.

Vectors are rotated by a random orthogonal matrix, so that the first ``d`` of ``D`` coordinates are a fair sample of
a distance.  Inside each probed list the rotated vectors lie in column blocks.  After each block a hypothesis test
compares the scaled partial distance with the k-th best distance so far: a candidate is abandoned when
``partial * D / d > kth * (1 + epsilon / sqrt(d)) ** 2``, and only survivors see the next block.  Survivors of all
blocks are measured exactly, in double precision, on the original vectors.

The coarse centroids are fitted on a bounded sample; every vector is indexed.  A list longer than ``SLICE`` is cut into
slices that meet the queries in separate tasks, so one very common vector doesn't fill a task; the queries of a
list are cut likewise, and each part meets each slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from faultlens.llm.common import pick, settle

#: Rows of a list that one task holds at most (about; slices are cut by a hash).
SLICE = 4096
#: Candidates that are measured fully before the first test, and candidates tested at once.
FIRST, CHUNK = 64, 1024


@dataclass(frozen=True)
class CoarseIndex:
    """Centroids of the lists and the rotation; both small and of a size that parameters bound."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int = 1

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector, nearest first."""
        gap = (self.centroids ** 2).sum(axis=1)[None, :] - 2 * vectors @ self.centroids.T
        if n == 1:
            return np.argmin(gap, axis=1)[:, None]
        return np.argsort(gap, axis=1, kind="stable")[:, :n]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the vectors that take part: not null, not zero, all components present and finite."""
    own = pick(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"),
                                                   F.col(vector_col).cast("array<double>").alias("v"))
    good = F.expr("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) "
                  "and exists(v, x -> x <> 0)")
    return own.where(F.coalesce(good, F.lit(False)))


def kmeans(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of a bounded sample; a list that empties takes the vector farthest from its centroid."""
    draw = np.random.default_rng(seed)
    centroids = sample[draw.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        gap = (centroids ** 2).sum(axis=1)[None, :] - 2 * sample @ centroids.T
        own = np.argmin(gap, axis=1)
        far = np.argsort(-(gap[np.arange(len(sample)), own] + (sample ** 2).sum(axis=1)), kind="stable")
        for k in range(lists):
            mine = sample[own == k]
            centroids[k] = mine.mean(axis=0) if len(mine) else sample[far[k]]
    return centroids


def needed_probes(index: CoarseIndex, sample: np.ndarray, k: int, recall: float, queries: int = 256, seed: int = 6) -> int:
    """Lists to probe so that ``recall`` of the sample's own nearest neighbours lie in them."""
    lists = len(index.centroids)
    own = index.nearest(sample, 1)[:, 0]
    turns = []
    for q in np.random.default_rng(seed).permutation(len(sample))[:queries]:
        gap = ((sample - sample[q]) ** 2).sum(axis=1)
        gap[q] = np.inf
        near = np.argsort(gap, kind="stable")[:min(k, len(sample) - 1)]
        turn = np.empty(lists, np.int64)
        turn[index.nearest(sample[q][None], lists)[0]] = np.arange(lists)
        turns.append(turn[own[near]])
    turns = np.sort(np.concatenate(turns)) if turns else np.zeros(0)
    return int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))))]) + 1 if len(turns) else lists


def fit(rows: DataFrame, k: int = 10, recall: float = 0.97, max_sample: int = 8192, max_lists: int = 256, seed: int = 5) -> CoarseIndex | None:
    """Centroids, and the number of probes for ``recall``, on about ``max_sample`` rows ``(id, v)`` chosen by a hash; None without rows."""
    n = rows.count()
    if not n:
        return None
    chance = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < min(1.0, max_sample / n)).orderBy("id").limit(2 * max_sample).collect() or rows.limit(1).collect()
    data = np.array([r["v"] for r in sample], np.float64)
    different = np.unique(data, axis=0)
    lists = int(min(max_lists, len(different), max(1, round(np.sqrt(n) / 2))))
    dims = data.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
    index = CoarseIndex(kmeans(different, lists, seed=seed), rotation)
    return CoarseIndex(index.centroids, rotation, needed_probes(index, data, k, recall))


def scan(base_ids: np.ndarray, base: np.ndarray, turned: np.ndarray, query_id: int, query: np.ndarray, query_turned: np.ndarray,
         k: int, block: int = 16, epsilon: float = 2.1) -> tuple[np.ndarray, np.ndarray]:
    """The query's ``k`` nearest of one list slice: ``(ids, distances)``, nearest first, ties by smaller id.

    ``turned`` holds the rotated vectors, one row per dimension.
    """
    dims = len(query)
    best_id, best = np.zeros(0, np.int64), np.zeros(0)
    bounds = [0, *range(min(FIRST, len(base_ids)), len(base_ids), CHUNK), len(base_ids)]
    for lo, hi in zip(bounds, bounds[1:]):
        alive = np.arange(lo, hi)
        kth = best[-1] ** 2 * (1 + 1e-9) + 1e-12 if len(best) == k else np.inf
        if kth < np.inf:
            partial = np.zeros(len(alive))
            for d in range(0, dims, block):
                stop = min(d + block, dims)
                gap = turned[d:stop, alive] - query_turned[d:stop, None]
                partial += np.einsum("ij,ij->j", gap, gap)
                slack = 1 + epsilon / np.sqrt(stop) if stop < dims else 1 + 1e-6
                keep = partial * (dims / stop) <= kth * slack ** 2
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
        alive = alive[base_ids[alive] != query_id]
        gap = base[alive] - query
        ids, score = np.concatenate([best_id, base_ids[alive]]), np.concatenate([best, np.sqrt((gap * gap).sum(axis=1))])
        order = np.lexsort((ids, score))[:k]
        best_id, best = ids[order], score[order]
    return best_id, best


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 100, k: int = 10,
           recall: float = 0.97, max_sample: int = 8192, max_lists: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each row whose id is divisible by ``query_every``.

    Euclidean distance, nearest first, ties to the smaller id; a query's own id is no candidate. Vectors that are null, zero
    or hold null or non-finite components take no part, nor do rows without id or of another than the most common
    dimension. Repeated rows are candidates each; queries that repeat an id and vector count once. An empty table gives
    no rows. As many lists are probed as hold ``recall`` of the sample's neighbours, and further ones until they hold ``k``
    other vectors.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["d"]
    rows = rows.where(F.size("v") == dims)
    index = fit(rows, k, recall, max_sample, max_lists)
    lists = len(index.centroids)
    parts = spark.sparkContext.broadcast((index.centroids, index.rotation))

    def matrix(column):
        return column.combine_chunks().flatten().to_numpy().reshape(-1, dims) if isinstance(column, pa.ChunkedArray) \
            else column.flatten().to_numpy().reshape(-1, dims)

    def assign(batches):
        own = CoarseIndex(*parts.value)
        for batch in batches:
            if batch.num_rows:
                near = own.nearest(matrix(batch.column(1)), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], ["id", "v", "list"])

    is_query = F.pmod("id", F.lit(query_every)) == 0
    base = settle(rows.mapInArrow(assign, "id long, v array<double>, list int"))
    held = np.zeros(lists, np.int64)
    for r in base.groupBy("list").count().collect():  # one row per list, bounded by max_lists
        held[r["list"]] = r["count"]
    slices = np.maximum(1, -(-held // SLICE))
    cuts = F.array(*[F.lit(int(s)) for s in slices])
    probes = index.probes
    query_count = base.where(is_query).select("id", "v").distinct().count()
    parts_of_queries = max(1, -(-query_count * probes // (lists * SLICE)))

    def ask(batches):
        own = CoarseIndex(*parts.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            order = own.nearest(matrix(batch.column(1)), lists)
            at, target, piece = [], [], []
            for q in range(batch.num_rows):
                needed = np.searchsorted(np.cumsum(held[order[q]]), k + 1) + 1
                for list_ in order[q][:max(probes, int(needed))]:
                    n = int(slices[list_])
                    at += [q] * n
                    target += [int(list_)] * n
                    piece += range(n)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(target, pa.int32()), pa.array(piece, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)],
                ["list", "slice", "id", "v"])

    queries = base.where(is_query).select("id", "v").distinct()
    asked = queries.mapInArrow(ask, "list int, slice int, id long, v array<double>").withColumns(
        {"role": F.lit(1), "part": F.pmod(F.xxhash64("id"), F.lit(parts_of_queries)).cast("int")})
    stored = base.select("list", "id", "v", F.pmod(F.xxhash64("id", "v"), F.element_at(cuts, F.col("list") + 1))
                         .cast("int").alias("slice"), F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), F.lit(parts_of_queries - 1))).alias("part"))
    both = stored.unionByName(asked).withColumn("slice", (F.col("slice") * parts_of_queries + F.col("part")).cast("int"))
    both = both.select("list", "slice", "role", "id", "v")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(width, "list", "slice").sortWithinPartitions("list", "slice", "role", "id")

    def run(batches):
        rotation = parts.value[1]
        now, chunks, base_ids, own, turned = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            list_, piece, role = (batch.column(c).to_numpy() for c in range(3))
            ids, data = batch.column(3).to_numpy(), matrix(batch.column(4))
            edges = np.flatnonzero((np.diff(list_) != 0) | (np.diff(piece) != 0) | (np.diff(role) != 0)) + 1
            out = []
            for lo, hi in zip([0, *edges], [*edges, len(ids)]):
                if (list_[lo], piece[lo]) != now:
                    now, chunks, own = (list_[lo], piece[lo]), [], None
                if role[lo] == 0:
                    chunks.append((ids[lo:hi], data[lo:hi].copy()))
                    continue
                if own is None and chunks:
                    base_ids, own = (np.concatenate(c) for c in zip(*chunks))
                    turned = np.ascontiguousarray((own @ rotation).T)
                if own is None:
                    continue
                for q in range(lo, hi):
                    near, score = scan(base_ids, own, turned, ids[q], data[q], data[q] @ rotation, k)
                    out.append((np.full(len(near), ids[q]), near, score))
            flat = [np.concatenate([o[c] for o in out] or [np.zeros(0)]) for c in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64))],
                ["query_id", "vec_id", "score"])

    near = both.mapInArrow(run, "query_id long, vec_id long, score double")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
