"""Drawing queries over points and segments spread by the vectors' components; a page is a label."""

from __future__ import annotations

from pyspark.sql import functions as F

from piperack.checkpoints import stored
from piperack.operators import drawing, plants
from piperack.plans import standins as s
from piperack.plans import table_queries as t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_SEG = t._SEGMENTS.replace("segments AS", "raw AS")
_LINES = f"""{_SEG}, lines AS (SELECT page, seg AS id, ax, ay, ex, ey, ((degrees(atan2(ey - ay, ex - ax)) % 180) + 180) % 180 AS angle, (ax + ex) / 2 AS mx, (ay + ey) / 2 AS my FROM raw)"""


def _lines(spark, sf_dir):
    found = t._segments(spark, sf_dir).withColumnRenamed("seg", "id")
    angle = F.pmod(F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))), F.lit(180.0))
    return found.withColumns({"angle": angle, "mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2})


@_register(f"""WITH {_LINES}, pairs AS (SELECT a.page, a.id AS a, b.id AS b, a.ax, a.ay, a.ex - a.ax AS ux, a.ey - a.ay AS uy, b.ex - b.ax AS vx, b.ey - b.ay AS vy, b.ax - a.ax AS wx, b.ay - a.ay AS wy
  FROM lines a JOIN lines b ON a.page = b.page AND a.id < b.id AND sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) <= 60 AND abs(a.angle - b.angle) BETWEEN 30 AND 150),
solved AS (SELECT *, (wx * vy - wy * vx) / (ux * vy - uy * vx) AS t, (wx * uy - wy * ux) / (ux * vy - uy * vx) AS u FROM pairs)
SELECT page, a, b, round(ax + t * ux, 4) AS x, round(ay + t * uy, 4) AS y FROM solved WHERE t BETWEEN -0.4 AND 1.4 AND u BETWEEN -0.4 AND 1.4""")
def geo_crossings(spark, sf_dir):
    return drawing.crossings(_lines(spark, sf_dir), 60.0).select("page", "a", "b", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@_register(f"""WITH {_SEG}, ends AS (SELECT page, seg AS id, ax AS x, ay AS y, ex - ax AS dx, ey - ay AS dy FROM raw UNION ALL SELECT page, seg, ex, ey, ex - ax, ey - ay FROM raw),
pairs AS (SELECT a.page, a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, abs(a.dx * b.dy - a.dy * b.dx) / (sqrt(a.dx * a.dx + a.dy * a.dy) * sqrt(b.dx * b.dx + b.dy * b.dy)) AS bend,
  abs(a.dx * (b.y - a.y) - a.dy * (b.x - a.x)) / sqrt(a.dx * a.dx + a.dy * a.dy) AS aside FROM ends a JOIN ends b ON a.page = b.page AND a.id < b.id)
SELECT page, a, b, round(min(d), 6) AS gap FROM pairs WHERE d > 1.2 AND d <= 40 AND bend < 0.5 AND aside < 10 GROUP BY ALL""")
def geo_gap_bridge(spark, sf_dir):
    return drawing.gap_bridges(_lines(spark, sf_dir), 1.2, 40.0, 10.0, 0.5).select("page", "a", "b", F.round("gap", 6).alias("gap"))


@_register(f"WITH {t._POINTS}, {t._SEGMENTS}, {t._ON} SELECT page, id, seg, round(d, 6) AS d FROM placed WHERE d <= 30 QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY d, seg) = 1")
def geo_labels_on_runs(spark, sf_dir):
    return drawing.labels_on_runs(t._points(spark, sf_dir), t._segments(spark, sf_dir)).select("page", "id", "seg", F.round("d", 6).alias("d"))


@_register(f"""WITH {t._POINTS}, {t._SEGMENTS}, heads AS (SELECT p.*, round(embedding[7]::DOUBLE * 1000, 3) AS dx, round(embedding[8]::DOUBLE * 1000, 3) AS dy FROM points p JOIN embeddings ON vec_id = id),
placed AS (SELECT page, id, seg, t, dx, dy, ex - ax AS sx, ey - ay AS sy, sqrt((x - ax - t * (ex - ax)) * (x - ax - t * (ex - ax)) + (y - ay - t * (ey - ay)) * (y - ay - t * (ey - ay))) AS d FROM (SELECT *, {t._T} AS t FROM heads JOIN segments USING (page))),
along AS (SELECT *, (dx * sx + dy * sy) / (sqrt(dx * dx + dy * dy) * sqrt(sx * sx + sy * sy)) AS c FROM placed WHERE d <= 20)
SELECT page, id, seg, CASE WHEN c > 0 THEN 1 ELSE -1 END AS direction FROM along WHERE abs(c) >= 0.85 QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY d, seg) = 1""")
def geo_arrows(spark, sf_dir):
    at = lambda k: F.round(F.element_at("embedding", k).cast("double") * 1000, 3)
    heads = t._points(spark, sf_dir).join(s.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(7).alias("dx"), at(8).alias("dy")), "id")
    return drawing.arrows_on_runs(heads, t._segments(spark, sf_dir), 20.0)


@_register(f"""WITH {t._POINTS}, {t._SEGMENTS}, boxes AS (SELECT page, id AS box, x - 15 AS x0, x + 15 AS x1, y - 15 AS y0, y + 15 AS y1 FROM points),
ends AS (SELECT page, seg, 0 AS e, ax AS x, ay AS y FROM segments UNION ALL SELECT page, seg, 1, ex, ey FROM segments),
hits AS (SELECT ends.page, seg, e, min(box) AS owner FROM ends JOIN boxes ON ends.page = boxes.page AND x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2 GROUP BY ALL)
SELECT page, seg, owner, CASE WHEN count(*) = 2 THEN 'internal' ELSE 'nozzle' END AS role FROM hits GROUP BY ALL""")
def geo_owned_edges(spark, sf_dir):
    boxes = t._points(spark, sf_dir).select("page", F.col("id").alias("box"), (F.col("x") - 15).alias("x0"), (F.col("x") + 15).alias("x1"), (F.col("y") - 15).alias("y0"), (F.col("y") + 15).alias("y1"))
    return drawing.owned_edges(t._segments(spark, sf_dir), boxes)


@_register(f"""WITH {t._POINTS}, tags AS (SELECT id AS tag, page, x, y, CASE WHEN id % 2 = 0 THEN 2.5 ELSE 1.0 END AS weight FROM points),
pairs AS (SELECT a.page, a.id, tag, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, weight FROM points a JOIN tags b ON a.page = b.page AND a.id <> tag)
SELECT page, id, tag, round(d, 6) AS d FROM pairs WHERE d <= 90 AND d * weight <= 90 QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY d * weight, tag) = 1""")
def geo_weighted_nearest(spark, sf_dir):
    points = t._points(spark, sf_dir)
    tags = points.select("page", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.when(F.col("id") % 2 == 0, 2.5).otherwise(1.0).alias("weight"))
    return drawing.weighted_nearest(points, tags, 90.0, apart=True).select("page", "id", "tag", F.round("d", 6).alias("d"))


@_register("""WITH e AS (SELECT l_orderkey AS page, l_partkey AS a, l_suppkey AS b FROM lineitem), ends AS (SELECT page, 'p' || a AS node FROM e UNION ALL SELECT page, 's' || b FROM e)
SELECT page, node, count(*) AS degree, CASE WHEN count(*) <= 1 THEN 'dead_end' WHEN count(*) = 2 THEN 'corner' ELSE 'junction' END AS kind FROM ends GROUP BY ALL""")
def geo_degrees(spark, sf_dir):
    return drawing.degrees(s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")))


@_register("SELECT l_partkey AS line_number, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS first FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def geo_cross_sheet(spark, sf_dir):
    found = drawing.cross_sheet_links(s.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.array("l_partkey").alias("lines")))
    return found.select("line_number", F.size("sheets").cast("long").alias("n"), F.element_at("sheets", 1).alias("first"))


@_register("SELECT l_suppkey AS page, count(*) AS spans, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median_size, CASE WHEN count(*) >= 20 THEN 'ok' ELSE 'poor' END AS verdict FROM lineitem GROUP BY ALL")
def geo_page_checks(spark, sf_dir):
    return drawing.page_checks(s.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_quantity").alias("size")))


@_register(f"""WITH {t._POINTS}, radii AS (SELECT p_size % 10 AS page, p_retailprice / 60 AS r FROM part), counted AS (SELECT page, round(r * 2) / 2 AS r, count(*) AS c FROM radii GROUP BY ALL),
scale AS (SELECT page, max_by(r, [c, r]) / 18 AS s FROM counted GROUP BY page), chosen AS (SELECT p.id, p.x, p.y, CASE WHEN abs(coalesce(s, 1) - 1) > 0.02 THEN s ELSE 1 END AS s FROM points p LEFT JOIN scale USING (page))
SELECT id, round(x / s, 6) AS x, round(y / s, 6) AS y FROM chosen""")
def geo_normalise(spark, sf_dir):
    radii = s.table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("page"), (F.col("p_retailprice") / 60).alias("r"))
    return drawing.normalised(t._points(spark, sf_dir), radii).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@_register(f"""WITH RECURSIVE {s.CHAIN_SQL}, e AS (SELECT chain * 100 + pos AS id, chain, pos, verified FROM chains WHERE next IS NOT NULL),
known(id, chain, pos) AS (SELECT id, chain, pos FROM e WHERE verified UNION SELECT e.id, e.chain, e.pos FROM known k JOIN e ON e.chain = k.chain AND abs(e.pos - k.pos) = 1)
SELECT id, CASE WHEN id IN (SELECT id FROM known) THEN 1 ELSE 0 END AS direction FROM e""")
def geo_orient(spark, sf_dir):
    """Runs of every order, seeded by its finished lines; nodes of two edges pass the direction on."""
    found = stored(s.chains(spark, sf_dir).where("next is not null").select("chain", "pos", "verified"))
    number = (F.col("chain") * 100 + F.col("pos")).alias("id")
    edges = found.select(F.col("chain").alias("plant"), number, F.col("pos").alias("a"), (F.col("pos") + 1).alias("b"))
    seeds = found.where("verified").select(F.col("chain").alias("plant"), number, F.lit(1).alias("direction"), F.lit(0).alias("priority"), F.lit("arrow").alias("source"))
    return plants.orient(edges, seeds).select("id", "direction")


@_register("""WITH d AS (SELECT DISTINCT l_orderkey AS arc, l_quantity * 7.0 % 360 AS angle FROM lineitem),
g AS (SELECT arc, angle, coalesce(lead(angle) OVER w, first_value(angle) OVER w + 360) - angle AS gap FROM d WINDOW w AS (PARTITION BY arc ORDER BY angle)),
m AS (SELECT arc, max([gap, angle]) AS m FROM g GROUP BY arc) SELECT arc, round(360 - m[1], 6) AS span, round((m[2] + m[1] / 2) % 360, 6) AS opening FROM m""")
def geo_arc_gaps(spark, sf_dir):
    angles = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("by"), (F.col("l_quantity") * 7.0 % 360).alias("angle")).distinct()
    return drawing.ring_gaps(angles).select(F.col("by").alias("arc"), F.round("span", 6).alias("span"), F.round("opening", 6).alias("opening"))
