"""Retrieval queries over all documents, with the benchmark's items as the questions asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from piperack.operators import retrieval as r
from piperack.operators import search
from piperack.plans import standins as s

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


_REASON = "CASE WHEN curation <> 'approved' THEN 'curation: ' || curation WHEN holdout THEN 'holdout' END"


@_register(f"WITH {s.CHUNKS_SQL} SELECT chunk_id, {_REASON} IS NULL AS indexed, {_REASON} AS reason FROM chunks")
def kb_gate(spark, sf_dir):
    reason = r.gate_reason(F.col("curation"), F.col("holdout"))
    return s.chunks(spark, sf_dir).select("chunk_id", reason.isNull().alias("indexed"), reason.alias("reason"))


@_register(f"WITH {s.CHUNKS_SQL} SELECT coalesce({_REASON}, 'indexed') AS reason, count(*) AS n FROM chunks GROUP BY ALL")
def kb_exclusion_reasons(spark, sf_dir):
    reason = F.coalesce(r.gate_reason(F.col("curation"), F.col("holdout")), F.lit("indexed"))
    return s.chunks(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@_register(f"WITH {s.CHUNKS_SQL} SELECT chunk_id FROM indexed WHERE lang = 'en' OR source = 'src3'")
def kb_applicability(spark, sf_dir):
    units = F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("source"))
    return s.indexed(spark, sf_dir).where(r.applicable(units, F.lit("src3"))).select("chunk_id")


@_register(f"WITH {s.CHUNKS_SQL} SELECT s.chunk_id, length, (SELECT count(*) FROM postings p WHERE p.chunk_id = s.chunk_id) AS distinct_terms FROM sizes s")
def kb_tokens(spark, sf_dir):
    found = s.indexed(spark, sf_dir).select("chunk_id", r.tokens(F.col("text")).alias("t"))
    return found.select("chunk_id", F.size("t").cast("long").alias("length"), F.size(F.array_distinct("t")).cast("long").alias("distinct_terms"))


@_register(f"WITH {s.CHUNKS_SQL} SELECT term, df FROM df")
def kb_df(spark, sf_dir):
    return r.document_frequency(s.indexed(spark, sf_dir))


def _top(score: str, k: int, digits: int) -> str:
    return f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {digits}) DESC, chunk_id) AS rank, chunk_id, round(score, {digits}) AS score FROM {score} QUALIFY rank <= {k}"


@_register(f"WITH {s.CHUNKS_SQL} {_top('bm25', 20, 6)}")
def kb_bm25_topk(spark, sf_dir):
    return search.top_by_bm25(s.indexed(spark, sf_dir), s.asked(spark, sf_dir), 20, 6)


@_register(f"WITH {s.CHUNKS_SQL}, {s.VECTORS_SQL} SELECT id AS chunk_id, bucket, raw, round(value, 6) AS value FROM vectors WHERE side = 'c'")
def kb_hash_embed(spark, sf_dir):
    return r.hashed_vector(s.indexed(spark, sf_dir), "chunk_id", "text").select("chunk_id", "bucket", "raw", F.round("value", 6).alias("value"))


@_register(f"WITH {s.CHUNKS_SQL}, {s.VECTORS_SQL} {_top('cosine', 20, 6)}")
def kb_cosine_topk(spark, sf_dir):
    cells = lambda df, id, text: r.hashed_vector(df, id, text).select(id, "bucket", "value")
    rows = search.rows_of(cells(s.indexed(spark, sf_dir), "chunk_id", "text"))
    return search.top_by_cosine(rows, cells(s.asked(spark, sf_dir), "query_id", "query"), r.DIM, 20, 6)


def _fused(spark, sf_dir):
    chunks, asked = s.indexed(spark, sf_dir), s.asked(spark, sf_dir)
    return r.fuse(r.bm25(chunks, asked), r.cosine(chunks, asked), digits=9)


@_register(f"WITH {s.CHUNKS_SQL}, {s.VECTORS_SQL}, {s.FUSED_SQL} SELECT query_id, chunk_id, round(fused, 9) AS fused FROM fused")
def kb_rrf(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "chunk_id", F.round("fused", 9).alias("fused"))


_BOOSTED_SQL = "boosted AS (SELECT query_id, f.chunk_id, fused * (1 + CASE WHEN upper(lang) = 'EN' THEN 0.5 ELSE 0 END + CASE WHEN source = 'src3' THEN 0.5 ELSE 0 END) AS fused FROM fused f JOIN indexed i ON i.chunk_id = f.chunk_id)"


def _boosted(spark, sf_dir):
    tags = s.indexed(spark, sf_dir).select("chunk_id", F.array(F.upper("lang")).alias("g"), F.array("source").alias("p"))
    return _fused(spark, sf_dir).join(tags, "chunk_id").select("query_id", "chunk_id", (F.col("fused") * r.boost(F.col("g"), F.col("p"), F.lit("en"), F.lit("src3"))).alias("fused"))


@_register(f"WITH {s.CHUNKS_SQL}, {s.VECTORS_SQL}, {s.FUSED_SQL}, {_BOOSTED_SQL} SELECT query_id, chunk_id, round(fused, 9) AS fused FROM boosted")
def kb_boosted(spark, sf_dir):
    return _boosted(spark, sf_dir).withColumn("fused", F.round("fused", 9))


@_register(f"""WITH {s.CHUNKS_SQL}, {s.VECTORS_SQL}, {s.FUSED_SQL}, {_BOOSTED_SQL}, final AS (SELECT query_id, chunk_id, round(fused, 9) AS fused FROM boosted)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank, chunk_id, round(fused / max(fused) OVER (PARTITION BY query_id), 3) AS score FROM final QUALIFY rank <= 5""")
def kb_search(spark, sf_dir):
    chunks = s.indexed(spark, sf_dir)
    boosts = chunks.select("chunk_id", r.boost(F.array(F.upper("lang")), F.array("source"), F.lit("en"), F.lit("src3")).alias("boost"))
    return search.search(chunks, s.asked(spark, sf_dir), boosts).withColumn("rank", F.col("rank").cast("long"))
