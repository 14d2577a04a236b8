"""Hybrid retrieval over chunks(chunk_id, text, ...): BM25, hashed vectors, reciprocal-rank fusion, boosts and gates.

Queries are a table too (query_id, query), so many run in one plan. The index is term-sparse: only the terms of the
queries meet the postings, after a join on the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piperack.functions.plant import tokens

# BM25's k1 and b, the fusion constant, the boost of a matching tag, the vector's width.
K1, B, RRF_K, BOOST, DIM = 1.5, 0.75, 60, 0.5, 256


def gate_reason(curation: Column, holdout: Column) -> Column:
    """Why a document isn't indexed, curation first; null if it is."""
    return F.when(F.coalesce(curation, F.lit("pending")) != "approved", F.concat(F.lit("curation: "), F.coalesce(curation, F.lit("pending")))).when(F.coalesce(holdout, F.lit(False)), F.lit("holdout"))


def applicable(values: Column, wanted: Column | None) -> Column:
    """If a document with the list ``values`` applies where ``wanted`` is asked for; an empty list applies everywhere."""
    if wanted is None:
        return F.lit(True)
    return F.coalesce(F.size(values) <= 0, F.lit(True)) | F.array_contains(values, wanted)


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunk_id, term, tf, length."""
    spread = chunks.select("chunk_id", tokens(F.col(text)).alias("t")).select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return spread.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def document_frequency(chunks: DataFrame, text: str = "text") -> DataFrame:
    """term, df over distinct terms of each chunk."""
    return chunks.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times; a term that a query repeats counts as often."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def term_counts(spread: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunk_id, term, tf, length for spread(chunk_id, length, term), a row for each word, of the ``wanted`` terms (term).

    Rows are dealt by chunk before they are counted: a task that reads many texts would else hold all their terms."""
    dealt = spread.join(wanted, "term", "left_semi").repartition("chunk_id")
    return dealt.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(chunks: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, chunk_id, score of the chunks that share a term with a query.

    Only terms of the queries are kept of each chunk, before anything is shuffled; lengths come from the whole chunk.
    """
    asked = query_terms(queries)
    sized = chunks.select("chunk_id", tokens(F.col(text)).alias("t")).select("chunk_id", F.size("t").alias("length"), "t")
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    if not totals.n:
        return asked.select("query_id", F.lit(None).cast("long").alias("chunk_id"), F.lit(0.0).alias("score")).where("false")
    wanted = asked.select("term").distinct()
    hits = term_counts(sized.select("chunk_id", "length", F.explode("t").alias("term")), wanted)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(totals.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(totals.mean))
    scored = hits.join(df, "term").join(asked, "term").select("query_id", "chunk_id", (F.col("times") * idf * F.col("tf") * (K1 + 1) / norm).alias("s"))
    return scored.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))


def hashed_vector(rows: DataFrame, id: str, text: str, dim: int = DIM) -> DataFrame:
    """id, bucket, value: each token adds a sign, both told by its SHA-1, and vectors have unit length; zero cells are left out."""
    digest = F.sha1(F.col("term").cast("binary"))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    terms = rows.select(F.col(id), F.explode(tokens(F.col(text))).alias("term")).groupBy(id, "term").agg(F.count(F.lit(1)).alias("tf"))
    cells = terms.groupBy(id, bucket.alias("bucket")).agg(F.sum(sign * F.col("tf")).alias("raw")).where("raw <> 0")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id)))
    return cells.select(id, "bucket", "raw", (F.col("raw") / norm).alias("value"))


def cosine(chunks: DataFrame, queries: DataFrame, text: str = "text", dim: int = DIM) -> DataFrame:
    """query_id, chunk_id, score: the dot product of unit vectors, by the cells that both have."""
    left = hashed_vector(chunks, "chunk_id", text, dim).select("chunk_id", "bucket", F.col("value").alias("a"))
    right = hashed_vector(queries, "query_id", "query", dim).select("query_id", "bucket", F.col("value").alias("b"))
    return left.join(right, "bucket").groupBy("query_id", "chunk_id").agg(F.sum(F.col("a") * F.col("b")).alias("score"))


def fuse(*channels: DataFrame, digits: int | None = None) -> DataFrame:
    """query_id, chunk_id, fused: the sum over channels of 1 / (60 + rank), for positive scores; ties rank by chunk_id.

    ``digits`` rounds scores before they are ranked, so that the order doesn't hang on the order of summation.
    """
    parts = []
    for channel in channels:
        positive = channel.withColumn("s", F.round("score", digits) if digits is not None else F.col("score")).where("s > 0")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "chunk_id"))
        parts.append(positive.select("query_id", "chunk_id", (1.0 / (RRF_K + rank)).alias("part")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("fused"))


def boost(guidewords: Column, parameters: Column, guideword: Column, parameter: Column) -> Column:
    """1, and a half more for a matching guideword and for a matching parameter."""
    hit = lambda values, want: F.when(F.coalesce(want != "", F.lit(False)) & F.coalesce(F.array_contains(values, want), F.lit(False)), BOOST).otherwise(0.0)
    return 1.0 + hit(guidewords, F.upper(guideword)) + hit(parameters, F.lower(parameter))


def top(fused: DataFrame, k: int = 5, digits: int = 3) -> DataFrame:
    """query_id, rank, chunk_id, score: the first ``k`` of each query, scores as shares of the best."""
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "chunk_id")
    best = F.max("fused").over(Window.partitionBy("query_id"))
    ranked = fused.where("fused > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "chunk_id", F.round(F.col("fused") / best, digits).alias("score"))


def unit_cells(rows: DataFrame, id: str, vector: str, key: str) -> DataFrame:
    """``key``, bucket, value: given vectors at unit length, by their components; zero vectors have none."""
    spread = rows.select(F.col(id).alias(key), F.posexplode(vector).alias("bucket", "raw")).where("raw <> 0").select(key, "bucket", F.col("raw").cast("double").alias("raw"))
    return spread.select(key, "bucket", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))).alias("value"))


def dense(vectors: DataFrame, queries: DataFrame, id: str, vector: str) -> DataFrame:
    """query_id, chunk_id, score: cosines of given vectors, by their components, as for hashed ones; zero vectors have none."""
    left, right = unit_cells(vectors, id, vector, "chunk_id"), unit_cells(queries, id, vector, "query_id").withColumnRenamed("value", "w")
    return left.join(right, "bucket").groupBy("query_id", "chunk_id").agg(F.sum(F.col("value") * F.col("w")).alias("score"))
