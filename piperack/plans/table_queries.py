"""Geometry, set, ranking and format queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from piperack.operators import geometry
from piperack.plans import standins as s

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


#: Points are the first two components of a vector, spread over a sheet; a page is its label.
_POINTS = "points AS (SELECT vec_id AS id, label AS page, round(embedding[1]::DOUBLE * 1000, 3) AS x, round(embedding[2]::DOUBLE * 1000, 3) AS y FROM embeddings)"
_SEGMENTS = "segments AS (SELECT vec_id AS seg, label AS page, round(embedding[3]::DOUBLE * 1000, 3) AS ax, round(embedding[4]::DOUBLE * 1000, 3) AS ay, round(embedding[5]::DOUBLE * 1000, 3) AS ex, round(embedding[6]::DOUBLE * 1000, 3) AS ey FROM embeddings)"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_T = "CASE WHEN (ex - ax) * (ex - ax) + (ey - ay) * (ey - ay) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) ELSE 0 END"


def _points(spark, sf_dir):
    at = lambda k: F.round(F.element_at("embedding", k).cast("double") * 1000, 3)
    return s.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("page"), at(1).alias("x"), at(2).alias("y"))


def _segments(spark, sf_dir):
    at = lambda k: F.round(F.element_at("embedding", k).cast("double") * 1000, 3)
    return s.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seg"), F.col("label").alias("page"), at(3).alias("ax"), at(4).alias("ay"), at(5).alias("bx"), at(6).alias("by"))


def _others(points):
    return points.select("page", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))


@_register(f"WITH {_POINTS} SELECT a.page, a.id, b.id AS other, round({_D}, 6) AS d FROM points a JOIN points b ON a.page = b.page AND a.id < b.id AND {_D} <= 20")
def geo_within(spark, sf_dir):
    p = _points(spark, sf_dir)
    return geometry.within(p, _others(p), 20.0).where("id < other").select("page", "id", "other", F.round("d", 6).alias("d"))


@_register(f"WITH {_POINTS} SELECT a.page, a.id, min(b.id) AS anchor FROM points a JOIN points b ON a.page = b.page AND {_D} <= 12 GROUP BY ALL")
def geo_snap(spark, sf_dir):
    return geometry.snap(_points(spark, sf_dir), 12.0)


@_register(f"WITH {_POINTS}, pairs AS (SELECT a.page, a.id, b.id AS other, {_D} AS d FROM points a JOIN points b ON a.page = b.page AND a.id <> b.id AND {_D} <= 90) SELECT page, id, other, round(d, 6) AS d FROM pairs QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY d, other) = 1")
def geo_nearest(spark, sf_dir):
    p = _points(spark, sf_dir)
    return geometry.nearest(p, _others(p), 90.0, apart=True).select("page", "id", "other", F.round("d", 6).alias("d"))


_ON = f"placed AS (SELECT page, id, seg, t, sqrt((x - ax - t * (ex - ax)) * (x - ax - t * (ex - ax)) + (y - ay - t * (ey - ay)) * (y - ay - t * (ey - ay))) AS d FROM (SELECT *, {_T} AS t FROM points JOIN segments USING (page)))"


@_register(f"WITH {_POINTS}, {_SEGMENTS}, {_ON} SELECT page, id, seg, round(t, 6) AS t, round(d, 6) AS d FROM placed WHERE d <= 6")
def geo_point_segment(spark, sf_dir):
    return geometry.point_segments(_points(spark, sf_dir), _segments(spark, sf_dir), 6.0).select("page", "id", "seg", F.round("t", 6).alias("t"), F.round("d", 6).alias("d"))


@_register(f"""WITH {_POINTS}, {_SEGMENTS}, {_ON}, ends AS (SELECT page, seg, round(t, 6) AS t FROM placed WHERE t BETWEEN 0.02 AND 0.98 AND d < 1.2 UNION SELECT page, seg, 0 FROM segments UNION SELECT page, seg, 1 FROM segments),
cut AS (SELECT page, seg, t AS t0, lead(t) OVER (PARTITION BY page, seg ORDER BY t) AS t1, row_number() OVER (PARTITION BY page, seg ORDER BY t) AS piece FROM ends) SELECT page, seg, piece, t0, t1 FROM cut WHERE t1 IS NOT NULL""")
def geo_tsplit(spark, sf_dir):
    return geometry.t_split(_points(spark, sf_dir), _segments(spark, sf_dir)).withColumn("piece", F.col("piece").cast("long"))


@_register(f"""WITH {_POINTS}, m AS (SELECT page, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM points GROUP BY page), moved AS (SELECT page, n, mx, my, x - mx AS u, y - my AS v FROM points JOIN m USING (page)),
s AS (SELECT page, n, mx, my, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * (u * u + v * v)) AS pu, sum(v * (u * u + v * v)) AS pv FROM moved GROUP BY ALL),
f AS (SELECT *, (pu * vv - pv * uv) / (2 * (uu * vv - uv * uv)) AS a, (pv * uu - pu * uv) / (2 * (uu * vv - uv * uv)) AS b FROM s)
SELECT page, n, round(mx + a, 4) AS cx, round(my + b, 4) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 4) AS r FROM f""")
def geo_circle_fit(spark, sf_dir):
    return geometry.fit_circles(_points(spark, sf_dir), "page").select("page", "n", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("r", 4).alias("r"))


@_register("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(w - 0.43) < 0.05 OR abs(w - 1.13) < 0.05 OR abs(w - 1.70) < 0.05 THEN 'pipe' WHEN abs(w - 0.71) < 0.05 THEN 'aux' WHEN abs(w - 0.14) < 0.03 THEN 'dash' END AS stroke,
  CASE WHEN q >= 15.5 THEN 'instrument' WHEN q >= 5.5 AND q < 12 THEN 'small' WHEN q >= 3 AND q < 5.5 THEN 'dot' ELSE 'tiny-dot' END AS circle FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 50000 AS w, l_quantity AS q FROM lineitem)""")
def geo_classes(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", geometry.stroke_class(F.col("l_extendedprice") / 50000).alias("stroke"), geometry.circle_class(F.col("l_quantity")).alias("circle"))


def _keys(spark, sf_dir, name, key):
    return s.table(spark, sf_dir, name).select(F.col(key).cast("long").alias("key"))


@_register("SELECT o_custkey::BIGINT AS key FROM orders UNION SELECT s_suppkey FROM supplier")
def set_union(spark, sf_dir):
    return _keys(spark, sf_dir, "orders", "o_custkey").union(_keys(spark, sf_dir, "supplier", "s_suppkey")).distinct()


@_register("SELECT o_custkey::BIGINT AS key FROM orders EXCEPT SELECT s_suppkey FROM supplier")
def set_except(spark, sf_dir):
    return _keys(spark, sf_dir, "orders", "o_custkey").subtract(_keys(spark, sf_dir, "supplier", "s_suppkey"))


@_register("SELECT p_partkey::BIGINT AS key FROM part INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, sf_dir):
    return _keys(spark, sf_dir, "part", "p_partkey").intersect(_keys(spark, sf_dir, "orders", "o_custkey"))


@_register("SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 5")
def topk_per_group(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return s.table(spark, sf_dir, "events").withColumn("rank", rank.cast("long")).where("rank <= 5").select("event_type", "event_id", "value", "rank")


@_register("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def last_n_runs(spark, sf_dir):
    return s.table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "ts")


@_register("""SELECT l_orderkey AS suggestion, row_number() OVER w AS row, CASE WHEN row_number() OVER w = 1 THEN l_returnflag END AS verdict, l_partkey AS citation FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)""")
def csv_first_row(spark, sf_dir):
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).cast("long")
    return s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("suggestion"), row.alias("row"), F.when(row == 1, F.col("l_returnflag")).alias("verdict"), F.col("l_partkey").alias("citation"))


@_register(f"""WITH {s.GRAPH_SQL} SELECT 'MERGE (n:PlantItem {{tag: "' || tag || '"}}) SET n.equipment_type = "' || equipment_type || '"' AS statement FROM nodes
UNION ALL SELECT 'MATCH (a:PlantItem {{tag: "' || src || '"}}), (b:PlantItem {{tag: "' || dst || '"}}) MERGE (a)-[:' || CASE WHEN verified THEN 'FLOWS_TO' ELSE 'CONNECTED_TO' END || ']->(b)' FROM edges""")
def x_cypher_export(spark, sf_dir):
    from piperack.sources import exports

    return exports.cypher(s.nodes(spark, sf_dir), s.edges(spark, sf_dir))
