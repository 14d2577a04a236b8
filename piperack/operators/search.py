"""Top-k retrieval that never makes a row for every chunk and query.

Queries are taken in blocks of a set number, whose words and vectors are broadcast. A task scores the chunks it reads
against a block and keeps the best of each query, so what it hands on is the block's queries times k, however many
chunks there are. Where a result needs ranks in two lists, the best of each list are candidates; their ranks are counted
exactly in a second pass, and a bound on what all other chunks can have tells whether the candidates suffice. The
queries for which they don't are asked again with longer lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from piperack.checkpoints import cut, stored
from piperack.operators import retrieval as r

#: Queries of a block, and candidates of a list that a fused search starts with.
BLOCK, CANDIDATES = 512, 64
COSINE, BM25 = 0, 1
FOUND = "channel int, query int, chunk_id long, score double"
_FOUND = pa.schema([("channel", pa.int32()), ("query", pa.int32()), ("chunk_id", pa.int64()), ("score", pa.float64())])
CELLS, TERMS = "array<struct<bucket:int,value:double>>", "array<struct<term:string,tf:bigint>>"


@dataclass
class Block:
    """The queries of a block: ids, unit vectors, and by term the queries that hold it with their weights."""

    ids: list
    vectors: np.ndarray
    terms: dict[str, tuple[np.ndarray, np.ndarray]]
    mean: float

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        """Chunk ids, and by channel the score of each query and chunk; 0 where they share nothing."""
        cells, width = batch.column("cells"), batch.num_rows
        flat = cells.flatten()
        at = np.repeat(np.arange(width), np.nan_to_num(cells.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
        dense = np.zeros((width, self.vectors.shape[1]))
        dense[at, flat.field("bucket").to_numpy()] = flat.field("value").to_numpy()
        out = [self.vectors @ dense.T, np.zeros((len(self.ids), width))]
        if self.terms:
            terms, length = batch.column("terms"), batch.column("length").to_numpy(zero_copy_only=False)
            hits = terms.flatten()
            at = np.repeat(np.arange(width), np.nan_to_num(terms.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
            tf = hits.field("tf").to_numpy().astype(float)
            part = tf * (r.K1 + 1) / (tf + r.K1 * (1 - r.B + r.B * length[at] / self.mean))
            coded = hits.field("term").dictionary_encode()
            order = np.argsort(coded.indices.to_numpy(), kind="stable")
            ends = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(coded.dictionary) + 1))
            for k, term in enumerate(coded.dictionary.to_pylist()):
                if term in self.terms:
                    own, (who, weight) = order[ends[k] : ends[k + 1]], self.terms[term]
                    out[BM25][np.ix_(who, at[own])] += np.outer(weight, part[own])
        return batch.column("chunk_id").to_numpy(), out


def rows_of(cells: DataFrame, chunks: DataFrame | None = None, wanted: DataFrame | None = None, text: str = "text") -> DataFrame:
    """chunk_id, cells, terms, length: a row for each chunk with its vector (cells: chunk_id, bucket, value) and, of its
    words, those that are ``wanted`` (term)."""
    vectors = cells.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "value")).alias("cells"))
    if chunks is None:
        return vectors.select("chunk_id", "cells", F.lit(None).cast(TERMS).alias("terms"), F.lit(None).cast("double").alias("length"))
    return vectors.join(terms_of(chunks, wanted, text), "chunk_id", "full").select("chunk_id", F.coalesce("cells", F.array().cast(CELLS)).alias("cells"), F.coalesce("terms", F.array().cast(TERMS)).alias("terms"), F.coalesce("length", F.lit(0.0)).alias("length"))


def terms_of(chunks: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """chunk_id, terms, length of the chunks that hold ``wanted`` words (term), as in ``rows_of``."""
    sized = chunks.select("chunk_id", r.tokens(F.col(text)).alias("t")).select("chunk_id", F.size("t").cast("double").alias("length"), F.explode("t").alias("term"))
    return r.term_counts(sized, wanted).groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"), F.first("length").alias("length"))


def blocks_of(cells: DataFrame, dim: int, weights: DataFrame | None = None, mean: float = 1.0, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of queries from their cells (query_id, bucket, value) and weights (query_id, term, weight)."""
    ids = cells.select("query_id") if weights is None else cells.select("query_id").union(weights.select("query_id"))
    ids = cut(ids.distinct())
    count = max(1, -(-ids.count() // size))
    part = F.pmod(F.xxhash64("query_id"), F.lit(count))
    for k in range(count):
        own = [x[0] for x in ids.where(part == k).orderBy("query_id").collect()]  # some ``size`` ids
        if not own:
            continue
        place = {x: i for i, x in enumerate(own)}
        vectors = np.zeros((len(own), dim))
        for x in cells.where(part == k).collect():
            vectors[place[x.query_id], x.bucket] = x.value
        by_term: dict[str, list[tuple[int, float]]] = {}
        for x in [] if weights is None else weights.where(part == k).collect():
            by_term.setdefault(x.term, []).append((place[x.query_id], x.weight))
        yield Block(own, vectors, {t: (np.array([a for a, _ in v]), np.array([b for _, b in v])) for t, v in by_term.items()}, mean)


def _first(score: np.ndarray, chunk: np.ndarray, query: np.ndarray, k: int, digits: int) -> np.ndarray:
    """The places of each query's best ``k``: by rounded score, ties to the smaller chunk."""
    order = np.lexsort((chunk, -np.round(score, digits), query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def best_of(rows: DataFrame, block: Block, k: int, digits: int, channels: tuple[int, ...] = (COSINE,), positive: bool = False) -> DataFrame:
    """channel, query (its place in the block), chunk_id, score: each task's best ``k`` of each query, by score rounded to
    ``digits``, then chunk; with ``positive`` only scores above 0 once rounded. Pairs that share nothing have no score."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: (np.empty(0, int), np.empty(0, np.int64), np.empty(0)) for c in channels}
        for batch in batches:
            ids, scores = shared.value.scores(batch)
            for c in channels:
                least = 0.5 * 10.0**-digits if positive else None
                q, at = np.nonzero(scores[c] >= least if positive else scores[c])
                parts = [np.concatenate(x) for x in zip(held[c], (q, ids[at], scores[c][q, at]), strict=True)]
                keep = _first(parts[2], parts[1], parts[0], k, digits)
                held[c] = tuple(x[keep] for x in parts)
        for c, (q, chunk, score) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), c, np.int32)), pa.array(q.astype(np.int32)), pa.array(chunk), pa.array(score)], schema=_FOUND)

    return rows.mapInArrow(scored, FOUND)


def top_by_cosine(rows: DataFrame, cells: DataFrame, dim: int, k: int, digits: int) -> DataFrame:
    """query_id, rank, chunk_id, score: the ``k`` best chunks of each query (cells: query_id, bucket, value)."""
    return _best_by(COSINE, cut(rows), blocks_of(cells, dim), cells.schema["query_id"].dataType, k, digits)


def top_by_bm25(chunks: DataFrame, queries: DataFrame, k: int, digits: int, text: str = "text") -> DataFrame:
    """query_id, rank, chunk_id, score: the ``k`` best chunks of each query (query_id, query) by ``retrieval.bm25``."""
    chunks = chunks.select("chunk_id", text)
    asked = cut(r.query_terms(queries))
    totals = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(r.tokens(F.col(text)))).alias("mean")).first()
    rows = stored(terms_of(chunks, asked.select("term").distinct(), text).withColumn("cells", F.array().cast(CELLS)))
    weights = _weighed(asked, rows, totals.n)
    none = asked.where("false").select("query_id", F.lit(0).alias("bucket"), F.lit(0.0).alias("value"))
    return _best_by(BM25, rows, blocks_of(none, 1, weights, totals.mean or 1.0), queries.schema["query_id"].dataType, k, digits)


def _weighed(asked: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """query_id, term, weight of the terms that are ``asked`` and that some of the ``n`` chunks hold."""
    df = rows.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return cut(asked.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight")))


def _best_by(channel: int, rows: DataFrame, blocks: Iterable[Block], kind: DataType, k: int, digits: int) -> DataFrame:
    out = None
    order = Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")
    for block in blocks:
        found = best_of(rows, block, k, digits, (channel,)).withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = found.select(F.element_at(F.lit(block.ids), F.col("query") + 1).cast(kind).alias("query_id"), F.col("rank").cast("long").alias("rank"), "chunk_id", "score")
        out = named if out is None else out.union(named)
    return rows.sparkSession.createDataFrame([], f"query_id {kind.simpleString()}, rank long, chunk_id long, score double") if out is None else out


def _ranks(rows: DataFrame, block: Block, asked: DataFrame, digits: int) -> DataFrame:
    """query, chunk_id, channel, rank of the candidates ``asked`` (query, chunk_id), for scores above 0: 1 and the chunks
    that come before them, counted in every task."""
    spark = rows.sparkSession
    wanted: dict[int, set[int]] = {}
    for x in asked.collect():  # two lists of candidates for the queries of a block
        wanted.setdefault(x.query, set()).add(x.chunk_id)
    shared = spark.sparkContext.broadcast((block, wanted))

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, want = shared.value
            ids, scores = found.scores(batch)
            place = {int(x): i for i, x in enumerate(ids)}
            pairs = [(c, q, x, float(np.round(scores[c][q, place[x]], digits))) for q, xs in want.items() for x in xs if x in place for c in (COSINE, BM25)]
            c, q, x, s = zip(*pairs, strict=True) if pairs else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(q, pa.int32()), pa.array(x, pa.int64()), pa.array(s, pa.float64())], schema=_FOUND)

    named = asked.select("chunk_id").distinct()
    candidates = cut(rows.join(named, "chunk_id", "left_semi").mapInArrow(own, FOUND).where("score > 0"))
    lists: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for x in candidates.collect():
        lists.setdefault((x.channel, x.query), []).append((-x.score, x.chunk_id))
    keys = {k: (np.array([s for s, _ in sorted(v)]), np.array([i for _, i in sorted(v)], np.int64)) for k, v in lists.items()}
    to_count = spark.sparkContext.broadcast((block, keys))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, want = to_count.value
        before = {k: np.zeros(len(v[0]), np.int64) for k, v in want.items()}
        for batch in batches:
            ids, scores = found.scores(batch)
            for (c, q), (score, chunk) in want.items():
                mine = -np.round(scores[c][q], digits)
                better = np.flatnonzero(mine <= score[-1])
                mine, these = mine[better], ids[better]
                order = np.lexsort((these, mine))
                mine, these = mine[order], these[order]
                low, high = np.searchsorted(mine, score, "left"), np.searchsorted(mine, score, "right")
                before[c, q] += low + np.array([np.searchsorted(these[a:b], x) for a, b, x in zip(low, high, chunk, strict=True)], np.int64)
        for (c, q), n in before.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c, np.int32)), pa.array(np.full(len(n), q, np.int32)), pa.array(want[c, q][1]), pa.array(n.astype(float))], schema=_FOUND)

    return rows.mapInArrow(counted, FOUND).groupBy("query", "chunk_id", "channel").agg((F.sum("score") + 1).cast("long").alias("rank"))


def search(chunks: DataFrame, queries: DataFrame, boosts: DataFrame, k: int = 5, digits: int = 9, text: str = "text", most_boost: float = 1 + 2 * r.BOOST) -> DataFrame:
    """query_id, rank, chunk_id, score: the ``k`` best chunks of each query by reciprocal ranks in both lists, times the
    chunk's boost (boosts: chunk_id, boost, ``most_boost`` at most); scores are shares of the best."""
    chunks = chunks.select("chunk_id", text)
    asked = cut(r.query_terms(queries))
    wanted = cut(asked.select("term").distinct())
    totals = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(r.tokens(F.col(text)))).alias("mean")).first()
    rows = cut(rows_of(r.hashed_vector(chunks, "chunk_id", text).select("chunk_id", "bucket", "value"), chunks, wanted, text))
    weights = _weighed(asked, rows, totals.n)
    cells = cut(r.hashed_vector(queries, "query_id", "query").select("query_id", "bucket", "value"))
    kind, out = queries.schema["query_id"].dataType, None
    for block in blocks_of(cells, r.DIM, weights, totals.mean or 1.0):
        n, left = CANDIDATES, block
        while True:
            order = Window.partitionBy("channel", "query").orderBy(F.desc(F.round("score", digits)), "chunk_id")
            best = best_of(rows, left, n, digits, (COSINE, BM25), positive=True)
            asking = cut(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query", "chunk_id").distinct())
            fused = _ranks(rows, left, asking, digits).groupBy("query", "chunk_id").agg(F.sum(1.0 / (r.RRF_K + F.col("rank"))).alias("fused"))
            fused = fused.join(boosts, "chunk_id").select(F.col("query").alias("query_id"), "chunk_id", F.round(F.col("fused") * F.col("boost"), digits).alias("fused"))
            found = cut(r.top(fused, k).join(fused, ["query_id", "chunk_id"]))
            others = most_boost * 2 / (r.RRF_K + n + 1)  # what a chunk in neither list may have
            sure = {x.query_id for x in found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("fused").alias("least")).where((F.col("n") >= k) & (F.col("least") > others + 10.0**-digits)).collect()}
            done = n >= totals.n
            own = found if done else found.where(F.col("query_id").isin(sorted(sure)) if sure else F.lit(False))
            named = own.select(F.element_at(F.lit(left.ids), F.col("query_id") + 1).cast(kind).alias("query_id"), "rank", "chunk_id", "score")
            out = named if out is None else out.union(named)
            again = [i for i in range(len(left.ids)) if i not in sure]
            if done or not again:
                break
            new = {old: i for i, old in enumerate(again)}
            terms = {t: (np.array([new[q] for q in who if q in new], int), np.array([w for q, w in zip(who, weight, strict=True) if q in new])) for t, (who, weight) in left.terms.items()}
            n, left = 4 * n, Block([left.ids[i] for i in again], left.vectors[again], {t: v for t, v in terms.items() if len(v[0])}, left.mean)
    return rows.sparkSession.createDataFrame([], f"query_id {kind.simpleString()}, rank int, chunk_id long, score double") if out is None else out
