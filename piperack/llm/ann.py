"""Approximate nearest neighbours: an inverted multi-index with exact reranking.

The two halves of a vector are quantised separately, by centroids fitted on a bounded sample; a pair of centroids is a
cell. Every row is indexed. A query walks the pairs in the order of their summed nearness, kept by a heap, until its
cells hold a set share of the rows; the share is measured on the sample, so that the expected recall reaches a target.
Candidates are reranked by the exact inner product in double precision.

Cells are packed into shards of like size; the rows of a large cell spread over several. A query goes once to each
shard that it probes, in blocks, so no task or group grows with the input. It goes nearest shards first, in rounds of
one, three, twelve, ... shards, and takes along the score of its ``k``-th nearest so far: a shard returns only what
reaches that. A round asks three times the shards of all rounds before, so it brings back some 3 ``k`` rows a query,
however many rows there are. ``recall=None`` walks all cells, which is exact.

Cases: vectors that are null, zero, of another length than the commonest, or that hold null or non-finite components
take no part, nor do rows without id; an id's repeated rows count once, as a query with the least vector; ties go to
the smaller id; a query with fewer candidates gets them all; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piperack.llm.shared import kept

#: Vectors sampled, centroids of a half, rows aimed at in a shard, queries in a block, queries walked in a task, recall aimed at on the sample.
SAMPLE, CENTROIDS, SHARD_ROWS, QUERY_BLOCK, WALK_BLOCK, RECALL = 10_000, 32, 4096, 20_000, 256, 0.96


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector (array of double) of the rows that take part."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    commonest = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (commonest[0].n if commonest else 0))


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids from rows spread over the sample."""
    found = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((found**2).sum(1)[None] - 2 * x @ found.T, axis=1)
        for c in range(len(found)):
            if (own := near == c).any():
                found[c] = x[own].mean(axis=0)
    return found


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in the order of falling summed nearness until they hold ``wanted`` rows; empty cells are passed over."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen, held, out = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, 0, []
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if counts[cell]:
            held += counts[cell]
            out.append(cell)
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (-(first[a[p]] + second[b[q]]), p, q))
    return out


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    share: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        near = lambda c, v: np.argmin((c**2).sum(1)[None] - 2 * v @ c.T, axis=1)
        return near(self.first, x[:, :half]) * len(self.second) + near(self.second, x[:, half:])

    def probes(self, q: np.ndarray, counts: np.ndarray, wanted: float) -> list[list[int]]:
        half = self.first.shape[1]
        return [walk(f, s, counts, wanted) for f, s in zip(q[:, :half] @ self.first.T, q[:, half:] @ self.second.T, strict=True)]


def fit(sample: np.ndarray, k: int, centroids: int = CENTROIDS, recall: float | None = RECALL, trials: int = 200) -> MultiIndex:
    """Centroids, and the share of rows to walk over that finds ``recall`` of the nearest ``k`` within the sample; all rows for None."""
    half = sample.shape[1] // 2
    index = MultiIndex(_centroids(sample[:, :half], centroids), _centroids(sample[:, half:], centroids), 1.0)
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    depths: list[float] = []
    if recall is None:
        return index
    for t in np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int):
        near = sample @ sample[t]
        near[t] = -np.inf
        best = np.argsort(-near)[: min(k, len(sample) - 1)]
        order = index.probes(sample[t][None], counts, np.inf)[0]
        ends = np.zeros(len(counts))
        ends[order] = np.cumsum(counts[order])
        depths += (ends[cells[best]] / len(sample)).tolist()
    if depths:
        index.share = float(min(1.0, np.quantile(depths, recall) + 0.01))
    return index


def _top(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The nearest ``k`` rows of one shard for each query of one block, among the cells that the query probes, less
    those that score below the query's bound."""
    empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
    if not len(queries) or not len(rows):
        return pa.table(empty)
    matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    q, e = matrix(queries), matrix(rows)
    qid, eid, cell = queries.column("id").to_numpy(), rows.column("id").to_numpy(), rows.column("cell").to_numpy()
    least = queries.column("bound").to_numpy()
    by_id = np.argsort(eid, kind="stable")
    e, eid, cell = e[by_id], eid[by_id], cell[by_id]
    starts = np.flatnonzero(np.concatenate(([True], eid[1:] != eid[:-1])))
    lists = queries.column("cells").combine_chunks()
    asked, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
    out = []
    step = max(1, (4 << 20) // len(e))
    for low in range(0, len(q), step):
        part = (at >= low) & (at < low + step)
        probes = np.zeros((min(step, len(q) - low), int(cell.max()) + 1), bool)
        inside = asked[part] <= cell.max()
        probes[at[part][inside] - low, asked[part][inside]] = True
        near = q[low : low + step] @ e.T
        near[~probes[:, cell] | (qid[low : low + step, None] == eid[None])] = -np.inf
        each = np.maximum.reduceat(near, starts, axis=1)  # the best of each id
        bound = np.partition(each, each.shape[1] - k, axis=1)[:, each.shape[1] - k] if each.shape[1] > k else np.full(len(near), -np.inf)
        bound = np.maximum(bound, least[low : low + step])
        a, b = np.nonzero((near >= bound[:, None] - 1e-9) & (near > -np.inf))
        exact = (q[low + a] * e[b]).sum(axis=1)
        reached = exact >= least[low + a]
        a, b, exact = a[reached], b[reached], exact[reached]
        order = np.lexsort((-exact, eid[b], a))  # an id's rows stand together, the best first
        a, b, exact = a[order], b[order], exact[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (eid[b][1:] != eid[b][:-1])
        a, b, exact = a[fresh], b[fresh], exact[fresh]
        order = np.lexsort((eid[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        take = rank < k
        out.append((qid[low + a[take]], eid[b[take]], exact[take]))
    ids, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query_id": ids, "vec_id": found, "score": scores})


def search(vectors: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest ``k`` found of each row whose id ``every`` divides, by inner product."""
    rows = kept(usable(vectors, id, vector).distinct())  # repeated rows count once; taken in part before the shuffle
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()  # bounded by SAMPLE
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(taken):
        return empty
    index = fit(taken.flatten().to_numpy(zero_copy_only=False).reshape(len(taken), -1), k, **options)
    width = len(index.first) * len(index.second)
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("int")
    def cell_of(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.cells(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)).astype(np.int32))

    indexed = kept(rows.withColumn("cell", cell_of("vector")))
    counts, ids = np.zeros(width, int), np.zeros(width, int)
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).collect():  # at most a row for each pair of centroids
        counts[r.cell], ids[r.cell] = r.n, r.ids
    parts = np.maximum(1, -(-counts // SHARD_ROWS))
    shard_of, filled, shard = np.zeros(width, int), 0, 0
    for c in range(width):  # small cells share a shard, a large one has shards of its own
        if filled and filled + counts[c] > SHARD_ROWS:
            shard, filled = shard + 1, 0
        shard_of[c] = shard
        filled += counts[c]
        if parts[c] > 1:
            shard, filled = shard + parts[c], 0
    layout = vectors.sparkSession.sparkContext.broadcast((ids, parts, shard_of, float(index.share * ids.sum())))

    @F.arrow_udf("array<struct<shard:int,cells:array<int>>>")
    def probes(x: pa.Array) -> pa.Array:
        ids, parts, shard_of, wanted = layout.value
        out = []
        for cells in shared.value.probes(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), ids, wanted):
            by_shard: dict[int, list[int]] = {}
            for c in cells:
                for p in range(parts[c]):
                    by_shard.setdefault(int(shard_of[c]) + p, []).append(c)
            out.append([{"shard": s, "cells": c} for s, c in by_shard.items()])
        return pa.array(out, pa.list_(pa.struct([("shard", pa.int32()), ("cells", pa.list_(pa.int32()))])))

    @F.arrow_udf("int")
    def home(cells: pa.Array, hashes: pa.Array) -> pa.Array:
        _, parts, shard_of, _ = layout.value
        c, h = cells.to_numpy(), hashes.to_numpy()
        return pa.array((shard_of[c] + h % parts[c]).astype(np.int32))

    queries = indexed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    queries = queries.repartition(max(1, -(-total // WALK_BLOCK)), "id")
    walks = kept(queries.select(F.col("id").alias("asker"), F.col("vector").alias("asked"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), probes("vector").alias("probes")))
    most = walks.agg(F.max(F.size("probes"))).first()[0] or 0
    held = indexed.select("id", "vector", "cell", home("cell", F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30))).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, done, count = None, 0, 1
    while done < most:
        bound = F.lit(float("-inf")) if best is None else F.coalesce("bound", F.lit(float("-inf")))
        bounds = walks if best is None else walks.join(best.where(F.col("rank") == k).select(F.col("query_id").alias("asker"), F.col("score").alias("bound")), "asker", "left")
        asked = bounds.select(F.col("asker").alias("id"), F.col("asked").alias("vector"), "block", bound.alias("bound"), F.explode(F.slice("probes", done + 1, count)).alias("p")).select("id", "vector", "block", "bound", "p.shard", "p.cells")
        near = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(lambda a, b: _top(a, b, k), "query_id long, vec_id long, score double")
        near = near if best is None else near.union(best.drop("rank"))
        ranked = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
        best = kept(ranked.where(F.col("rank") <= k))
        done, count = done + count, 3 * (done + count)
    return empty if best is None else best.select("query_id", "rank", "vec_id", "score")
