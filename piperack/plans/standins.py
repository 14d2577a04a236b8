"""How the driver's tables stand for a plant, a knowledge base, worksheets and logs; each with its SQL.

A part is an item of the plant, typed by its size; consecutive parts of an order are connected, verified if the line is
finished. A document is a chunk: approved if labelled good, rejected if labelled bad, pending without a label, held out
if labelled toxic; its language stands for a guideword and its source for a parameter and a list of applicability. An
order is a finding, its lines are citations, and a line's return flag is the verdict on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piperack.checkpoints import stored
from piperack.functions.plant import EQUIPMENT_TYPES
from piperack.operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in EQUIPMENT_TYPES])
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("tag"), F.element_at(kinds, F.col("p_size") % 12 + 1).alias("equipment_type"), F.col("p_name").alias("name"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, pos, tag, equipment_type, verified, next: the lines of each order in their order."""
    kinds = F.array(*[F.lit(t) for t in EQUIPMENT_TYPES])
    parts = table(spark, sf_dir, "part").select("p_partkey", F.element_at(kinds, F.col("p_size") % 12 + 1).alias("equipment_type"))
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linestatus") == "F").alias("verified"), F.row_number().over(along).alias("pos"), F.lead("l_partkey").over(along).alias("after"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("chain"), "pos", F.concat(F.lit("P"), "l_partkey").alias("tag"), "equipment_type", "verified", F.concat(F.lit("P"), "after").alias("next"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(along).alias("dst"), (F.col("l_linestatus") == "F").alias("verified"))
    return steps.where("dst is not null")


def _tagged(found: DataFrame) -> DataFrame:
    """``found`` with its keys, which are narrower while they are shuffled, as tags."""
    return found.withColumns({c: F.concat(F.lit("P"), c) for c in ("src", "dst")})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(graph.any_verified(_steps(spark, sf_dir)))


def walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The edges and their query graph, from one table that is written once."""
    every = stored(_tagged(graph.drawn_or_back(_steps(spark, sf_dir))))
    return every.where("drawn").drop("drawn"), every.drop("drawn")


def hub(found: DataFrame) -> DataFrame:
    """The item with most outgoing edges, as start; the smallest tag of those."""
    return found.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("start"))


_TYPES = "[" + ", ".join(f"'{t}'" for t in EQUIPMENT_TYPES) + "]"
_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
GRAPH_SQL = f"""
nodes AS (SELECT 'P' || p_partkey AS tag, ({_TYPES})[p_size % 12 + 1] AS equipment_type, p_name AS name FROM part),
steps AS (SELECT 'P' || l_partkey AS src, 'P' || lead(l_partkey) OVER ({_ORDER}) AS dst, l_linestatus = 'F' AS v FROM lineitem),
edges AS (SELECT src, dst, bool_or(v) AS verified FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
graph AS (SELECT * FROM edges UNION ALL
  SELECT e.dst, e.src, false FROM edges e WHERE NOT e.verified AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.src = e.dst AND r.dst = e.src)),
hub AS (SELECT src AS start FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)
"""
CHAIN_SQL = f"""
lines AS (SELECT l_orderkey AS chain, l_partkey, l_linestatus = 'F' AS verified, row_number() OVER ({_ORDER}) AS pos, lead(l_partkey) OVER ({_ORDER}) AS after FROM lineitem),
chains AS (SELECT chain, pos, 'P' || l_partkey AS tag, ({_TYPES})[p_size % 12 + 1] AS equipment_type, verified, 'P' || after AS next FROM lines JOIN part ON p_partkey = l_partkey)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with curation and holdout."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), "text", "lang", "source",
        F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "approved").otherwise("rejected").alias("curation"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("holdout"),
    )


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("curation = 'approved' and not holdout")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


CHUNKS_SQL = """
chunks AS (SELECT d.doc_id AS chunk_id, d.text, d.lang, d.source, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS curation, coalesce(toxic = 1, false) AS holdout
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
indexed AS (SELECT * FROM chunks WHERE curation = 'approved' AND NOT holdout),
terms AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM indexed),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT chunk_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS length FROM indexed),
totals AS (SELECT count(*) AS n, avg(length) AS mean FROM sizes),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
bm25 AS (SELECT query_id, p.chunk_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
  FROM postings p JOIN df USING (term) JOIN asked USING (term) JOIN sizes s ON s.chunk_id = p.chunk_id CROSS JOIN totals GROUP BY ALL)
"""
VECTORS_SQL = """
spread AS (SELECT 'c' AS side, chunk_id AS id, term, tf FROM postings UNION ALL SELECT 'q', query_id, term, times FROM asked),
cells AS (SELECT side, id, (('0x' || substr(sha1(term), 1, 8))::UBIGINT % 256)::INTEGER AS bucket,
  sum(CASE WHEN ('0x' || substr(sha1(term), 9, 2))::UBIGINT % 2 = 1 THEN tf ELSE -tf END)::BIGINT AS raw FROM spread GROUP BY ALL HAVING raw <> 0),
vectors AS (SELECT side, id, bucket, raw, raw / sqrt(sum(raw * raw) OVER (PARTITION BY side, id)) AS value FROM cells),
cosine AS (SELECT q.id AS query_id, c.id AS chunk_id, sum(c.value * q.value) AS score FROM vectors c JOIN vectors q ON c.bucket = q.bucket AND c.side = 'c' AND q.side = 'q' GROUP BY ALL)
"""
FUSED_SQL = """
ranked AS (
  SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)) AS part FROM bm25 WHERE round(score, 9) > 0
  UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)) FROM cosine WHERE round(score, 9) > 0),
fused AS (SELECT query_id, chunk_id, sum(part) AS fused FROM ranked GROUP BY ALL)
"""
