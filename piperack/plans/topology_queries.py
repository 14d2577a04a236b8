"""Queries over chains, clusters and pairs: orders as a piping graph, vectors as strokes and arcs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from piperack.operators import condense, symbols, topology
from piperack.plans import drawing_queries as d
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


# Orders as nodes: each is joined to the customer's next one, the last of every other customer to the first, which makes
# rings, and those of the rarest status to the next of their priority, which makes branches. Dear orders are anchors.
_PIPES = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price FROM orders),
rare AS (SELECT st FROM o GROUP BY st ORDER BY count(*), st LIMIT 1),
e0 AS (
  SELECT 3 * k AS id, k AS a, lead(k) OVER (PARTITION BY c ORDER BY k) AS b, pr, price FROM o
  UNION ALL SELECT 3 * max(k) + 1, max(k), min(k), max_by(pr, k), max_by(price, k) FROM o GROUP BY c HAVING c % 2 = 0 AND count(*) > 2
  UNION ALL SELECT 3 * k + 2, k, lead(k) OVER (PARTITION BY pr ORDER BY k), pr, price FROM o WHERE st = (SELECT st FROM rare)),
edges AS (SELECT id, a, b, CASE substr(pr, 1, 1) WHEN '1' THEN 'bridge' WHEN '2' THEN 'dash' ELSE 'solid' END AS style, floor(price / 100)::DOUBLE AS length FROM e0 WHERE b IS NOT NULL),
anchors AS (SELECT k AS node FROM o WHERE price > 250000)"""


def _pipes(spark, sf_dir):
    o = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.col("o_totalprice").alias("price"))
    rare = o.groupBy("st").count().orderBy("count", "st").limit(1).select("st")
    next_of = lambda by: F.lead("k").over(Window.partitionBy(by).orderBy("k"))
    edges = o.select((3 * F.col("k")).alias("id"), F.col("k").alias("a"), next_of("c").alias("b"), "pr", "price")
    rings = o.groupBy("c").agg(F.max("k").alias("last"), F.min("k").alias("first"), F.max_by("pr", "k").alias("pr"), F.max_by("price", "k").alias("price"), F.count(F.lit(1)).alias("n")).where("c % 2 = 0 and n > 2")
    edges = edges.union(rings.select(3 * F.col("last") + 1, "last", "first", "pr", "price"))
    edges = edges.union(o.join(rare, "st", "left_semi").select(3 * F.col("k") + 2, "k", next_of("pr"), "pr", "price")).where("b is not null")
    style = F.when(F.col("pr").startswith("1"), "bridge").when(F.col("pr").startswith("2"), "dash").otherwise("solid")
    return edges.select("id", "a", "b", style.alias("style"), F.floor(F.col("price") / 100).cast("double").alias("length")), o.where("price > 250000").select(F.col("k").alias("node"))


_CHAINS = f"""WITH RECURSIVE {_PIPES},
ends AS (SELECT a AS node, style FROM edges UNION ALL SELECT b, style FROM edges),
through AS (SELECT node FROM ends GROUP BY node HAVING count(*) = 2 AND count(DISTINCT CASE WHEN style <> 'bridge' THEN style END) <= 1 AND node NOT IN (SELECT node FROM anchors)),
darts AS (SELECT 2 * id AS dart, id AS edge, a AS src, b AS dst, style, length FROM edges UNION ALL SELECT 2 * id + 1, id, b, a, style, length FROM edges),
follow AS (SELECT d.dart, n.dart AS next FROM darts d JOIN through ON node = d.dst JOIN darts n ON n.src = d.dst AND n.dart <> xor(d.dart, 1)),
walk(head, dart, pos) AS (
  SELECT dart, dart, 0 FROM darts WHERE src NOT IN (SELECT node FROM through)
  UNION ALL SELECT head, next, pos + 1 FROM walk JOIN follow USING (dart)),
whole AS (SELECT head, max_by(dart, pos) AS last FROM walk GROUP BY head),
chosen AS (SELECT head, last FROM whole w JOIN darts h ON h.dart = head JOIN darts l ON l.dart = last WHERE [h.src, h.edge, xor(head, 1)] < [l.dst, l.edge, last]),
round_(head, dart, pos) AS (
  SELECT dart, dart, 0 FROM darts WHERE dart NOT IN (SELECT dart FROM walk)
  UNION ALL SELECT r.head, f.next, pos + 1 FROM round_ r JOIN follow f USING (dart) WHERE f.next <> r.head),
turns AS (SELECT r.head, min(d.edge) AS ring, min([d.src, d.dart]) AS least FROM round_ r JOIN darts d USING (dart) GROUP BY r.head),
rings AS (SELECT head FROM turns JOIN darts d ON d.dart = head WHERE [d.src, d.dart] = least QUALIFY row_number() OVER (PARTITION BY ring ORDER BY head) = 1),
members AS (SELECT head, dart, pos, false AS ring FROM walk JOIN chosen USING (head) UNION ALL SELECT head, dart, pos, true FROM round_ JOIN rings USING (head))"""


@_register(f"""{_CHAINS}
SELECT min_by(src, pos) AS a, max_by(dst, pos) AS b, coalesce(min_by(style, pos) FILTER (WHERE style <> 'bridge'), 'solid') AS style, count(*) AS edges, sum(length) AS length, ring FROM members JOIN darts USING (dart) GROUP BY head, ring""")
def geo_chain_runs(spark, sf_dir):
    """Chains of a graph with branches and rings, each a run between anchors."""
    return topology.collapsed_chains(*_pipes(spark, sf_dir))[0].select("a", "b", "style", "edges", "length", "ring")


@_register(f"""{_CHAINS}, n AS (SELECT head, pos, src AS node FROM members JOIN darts USING (dart) UNION ALL SELECT head, max(pos) + 1, max_by(dst, pos) FROM members JOIN darts USING (dart) GROUP BY head)
SELECT first_value(node) OVER w AS a, lead(node, 1) OVER w AS next, pos::BIGINT AS pos, node FROM n WINDOW w AS (PARTITION BY head ORDER BY pos)""")
def geo_chain_nodes(spark, sf_dir):
    """The nodes along every run."""
    along = Window.partitionBy("run").orderBy("pos")
    return topology.collapsed_chains(*_pipes(spark, sf_dir))[1].select(F.first("node").over(along).alias("a"), F.lead("node").over(along).alias("next"), F.col("pos").cast("long").alias("pos"), "node")


# Greedy leaders in SQL: the points of a page in turn, with the leaders so far in a list.
def _led_sql(points: str, order: str, near: str) -> str:
    return f"""turn AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {order}) AS k FROM {points}),
step(page, k, leaders) AS (SELECT DISTINCT page, 0::BIGINT, []::STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[] FROM turn
  UNION ALL SELECT t.page, t.k, CASE WHEN len(list_filter(leaders, lambda l: sqrt((l.x - t.x) * (l.x - t.x) + (l.y - t.y) * (l.y - t.y)) {near})) > 0 THEN leaders ELSE list_append(leaders, {{'k': t.k, 'x': t.x, 'y': t.y}}) END
  FROM step JOIN turn t ON t.page = step.page AND t.k = step.k + 1),
lead AS (SELECT page, unnest(max_by(leaders, k)) AS l FROM step GROUP BY page),
led AS (SELECT t.page, t.k, min(l.k) AS leader FROM turn t JOIN lead ON lead.page = t.page AND l.k <= t.k AND sqrt((l.x - t.x) * (l.x - t.x) + (l.y - t.y) * (l.y - t.y)) {near} GROUP BY ALL)"""


@_register(f"""WITH RECURSIVE {t._POINTS}, {_led_sql("points", "id % 7 DESC, id", "<= 60")}
SELECT a.page, a.id, b.id AS leader FROM led JOIN turn a ON a.page = led.page AND a.k = led.k JOIN turn b ON b.page = led.page AND b.k = leader""")
def geo_leaders(spark, sf_dir):
    """Greedy clusters of every page's points, in an order of their own."""
    return topology.leaders(t._points(spark, sf_dir), 60.0, [-(F.col("id") % 7)])


@_register(f"""WITH RECURSIVE {d._LINES}, pairs AS (SELECT a.page, a.id AS a, b.id AS b, a.ax, a.ay, a.ex - a.ax AS ux, a.ey - a.ay AS uy, b.ex - b.ax AS vx, b.ey - b.ay AS vy, b.ax - a.ax AS wx, b.ay - a.ay AS wy
  FROM lines a JOIN lines b ON a.page = b.page AND a.id < b.id AND sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) <= 90 AND abs(a.angle - b.angle) BETWEEN 30 AND 150),
solved AS (SELECT *, (wx * vy - wy * vx) / (ux * vy - uy * vx) AS t, (wx * uy - wy * ux) / (ux * vy - uy * vx) AS u FROM pairs),
cross_ AS (SELECT page, a, b, ax + t * ux AS x, ay + t * uy AS y, t, u FROM solved WHERE t BETWEEN -0.4 AND 1.4 AND u BETWEEN -0.4 AND 1.4),
{_led_sql("cross_", "a, b", "< 25")},
own AS (SELECT turn.*, leader FROM turn JOIN led ON led.page = turn.page AND led.k = turn.k),
places AS (SELECT page, leader, count(*) AS crossings, round(avg(x), 1) AS x, round(avg(y), 1) AS y, min(t) AS t, min(u) AS u FROM own GROUP BY ALL),
strokes AS (SELECT page, leader, a AS id FROM own UNION SELECT page, leader, b FROM own),
boxes AS (SELECT s.page, leader, count(*) AS strokes, min(least(ax, ex)) AS x0, min(least(ay, ey)) AS y0, max(greatest(ax, ex)) AS x1, max(greatest(ay, ey)) AS y1 FROM strokes s JOIN lines l ON l.page = s.page AND l.id = s.id GROUP BY ALL),
found AS (SELECT * FROM places JOIN boxes USING (page, leader) WHERE strokes <= 8),
bars AS (SELECT vec_id AS seg, label AS page, round(embedding[9]::DOUBLE * 1000, 3) AS ax, round(embedding[10]::DOUBLE * 1000, 3) AS ay, round(embedding[11]::DOUBLE * 1000, 3) AS ex, round(embedding[12]::DOUBLE * 1000, 3) AS ey FROM embeddings),
tips AS (SELECT f.page, f.leader, unnest([{{'x': ax, 'y': ay}}, {{'x': ex, 'y': ey}}]) AS p FROM found f JOIN strokes s ON s.page = f.page AND s.leader = f.leader JOIN lines l ON l.page = s.page AND l.id = s.id WHERE crossings = 1 AND strokes = 2 AND t BETWEEN 0.3 AND 0.7 AND u BETWEEN 0.3 AND 0.7),
bar_tips AS (SELECT page, seg, unnest([{{'x': ax, 'y': ay}}, {{'x': ex, 'y': ey}}]) AS q FROM bars),
barred AS (SELECT DISTINCT page, leader FROM (SELECT t.page, leader, seg FROM tips t JOIN bar_tips b ON b.page = t.page AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < 70 GROUP BY ALL HAVING count(*) >= 2)),
taken AS (SELECT f.* FROM found f LEFT JOIN barred b ON b.page = f.page AND b.leader = f.leader WHERE crossings >= 2 AND strokes >= 3 OR b.leader IS NOT NULL),
sorted AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY strokes DESC, leader) AS k FROM taken),
step2(page, k, kept) AS (SELECT DISTINCT page, 0::BIGINT, []::STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[] FROM sorted
  UNION ALL SELECT t.page, t.k, CASE WHEN len(list_filter(kept, lambda l: sqrt((l.x - t.x) * (l.x - t.x) + (l.y - t.y) * (l.y - t.y)) < 40)) > 0 THEN kept ELSE list_append(kept, {{'k': t.k, 'x': t.x, 'y': t.y}}) END
  FROM step2 JOIN sorted t ON t.page = step2.page AND t.k = step2.k + 1),
stay AS (SELECT page, l.k AS k FROM (SELECT page, unnest(max_by(kept, k)) AS l FROM step2 GROUP BY page)),
rings AS (SELECT label AS page, round(embedding[1]::DOUBLE * 1000, 3) AS x, round(embedding[2]::DOUBLE * 1000, 3) AS y, vec_id % 15 AS r FROM embeddings WHERE vec_id % 15 BETWEEN 5.5 AND 12)
SELECT s.page, x, y, strokes, CASE WHEN x1 - x0 >= y1 - y0 THEN 'H' ELSE 'V' END AS orientation, round(x0, 1) AS x0, round(y0, 1) AS y0, round(x1, 1) AS x1, round(y1, 1) AS y1 FROM sorted s JOIN stay USING (page, k)
WHERE NOT EXISTS (SELECT 1 FROM rings r WHERE r.page = s.page AND sqrt((r.x - s.x) * (r.x - s.x) + (r.y - s.y) * (r.y - s.y)) < r.r + 70)""")
def geo_valves(spark, sf_dir):
    """Valves among the crossings of every page's strokes."""
    at = lambda k: F.round(F.element_at("embedding", k).cast("double") * 1000, 3)
    rows = s.table(spark, sf_dir, "embeddings")
    bars = rows.select(F.col("vec_id").alias("seg"), F.col("label").alias("page"), at(9).alias("ax"), at(10).alias("ay"), at(11).alias("bx"), at(12).alias("by"))
    rings = t._points(spark, sf_dir).withColumn("r", F.col("id") % 15)
    found = symbols.valves(d._lines(spark, sf_dir), bars, rings, 90.0, cluster=25.0, apart=40.0, touch=70.0)
    return found.drop("id")


@_register(f"""WITH RECURSIVE {t._POINTS}, heads AS (SELECT id, page, x, y, 12.0::DOUBLE + id % 9 AS r, ((degrees(atan2(embedding[13]::DOUBLE, embedding[14]::DOUBLE)) % 360) + 360) % 360 AS opening FROM points JOIN embeddings ON vec_id = id WHERE 90 + id % 200 BETWEEN 100 AND 280),
pairs AS (SELECT a.page, a.id AS a, b.id AS b, a.x, a.y, b.x AS ox, b.y AS oy, a.r AS ra, (a.r + b.r) / 2 AS r, a.opening AS oa, b.opening AS ob, degrees(atan2(b.y - a.y, b.x - a.x)) AS axis, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM heads a JOIN heads b ON a.page = b.page AND a.id < b.id AND abs(a.r - b.r) <= greatest(2.0::DOUBLE, a.r * 0.15::DOUBLE)),
turned AS (SELECT *, ((oa - axis) % 360 + 360) % 360 AS da, ((ob - axis - 180) % 360 + 360) % 360 AS db FROM pairs WHERE d BETWEEN ra * 0.5::DOUBLE AND ra * 12),
fit AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY a, b) AS k FROM turned WHERE least(da, 360 - da) <= 55 AND least(db, 360 - db) <= 55),
step(page, k, used, hit) AS (SELECT DISTINCT page, 0::BIGINT, []::BIGINT[], false FROM fit
  UNION ALL SELECT f.page, f.k, CASE WHEN list_contains(used, f.a) OR list_contains(used, f.b) THEN used ELSE list_concat(used, [f.a, f.b]) END, NOT (list_contains(used, f.a) OR list_contains(used, f.b)) FROM step s JOIN fit f ON f.page = s.page AND f.k = s.k + 1)
SELECT page, a, b, round(r, 1) AS r, CASE WHEN flat THEN 'H' ELSE 'V' END AS orientation, round(CASE WHEN flat THEN least(x, ox) ELSE x END - r, 1) AS x0, round(CASE WHEN flat THEN y ELSE least(y, oy) END - r, 1) AS y0,
  round(CASE WHEN flat THEN greatest(x, ox) ELSE x END + r, 1) AS x1, round(CASE WHEN flat THEN y ELSE greatest(y, oy) END + r, 1) AS y1
FROM (SELECT *, abs(ox - x) >= abs(oy - y) AS flat FROM fit JOIN step USING (page, k) WHERE hit)""")
def geo_capsules(spark, sf_dir):
    """Bodies of two arcs, paired one to one."""
    rows = s.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.pmod(F.degrees(F.atan2(F.element_at("embedding", 13).cast("double"), F.element_at("embedding", 14).cast("double"))), F.lit(360.0)).alias("opening"))
    arcs = t._points(spark, sf_dir).join(rows, "id").withColumns({"r": 12.0 + F.col("id") % 9, "span": (90 + F.col("id") % 200).cast("double")})
    return symbols.capsules(arcs)


# The same graph as a plant, a third of it in line; a study node is a customer's vessels and lines.
_KINDS = ("vessel", "valve", "check_valve", "line", "instrument", "pump")
_VIEW = f"""WITH RECURSIVE {_PIPES},
items AS (SELECT 'O' || k AS tag, c, ([{", ".join(f"'{x}'" for x in _KINDS)}])[k % 6 + 1] AS kind FROM o),
flows AS (SELECT id, 'O' || a AS src, 'O' || b AS dst, length % 3 > 0 AS verified, style AS line FROM edges),
pipes AS (SELECT f.* FROM flows f JOIN items x ON x.tag = src JOIN items y ON y.tag = dst WHERE src <> dst AND x.kind <> 'instrument' AND y.kind <> 'instrument'),
links AS (SELECT id, src AS here, dst AS there, verified::INTEGER AS along, 0 AS against, line FROM pipes UNION ALL SELECT id, dst, src, 0, verified::INTEGER, line FROM pipes),
degree AS (SELECT here AS tag, count(*) AS n FROM links GROUP BY here),
told AS (SELECT l.*, i.kind IN ('valve', 'check_valve', 'relief_valve') AS inline, n = 1 AS ends FROM links l JOIN items i ON i.tag = there JOIN degree d ON d.tag = there),
members AS (SELECT c AS node_id, tag FROM items WHERE kind IN ('vessel', 'line')),
walk AS (
  SELECT m.tag AS start, there AS here, inline, ends, []::VARCHAR[] AS via, 1 AS hops, along, against, [line] AS lines FROM (SELECT DISTINCT tag FROM members) m JOIN told ON told.here = m.tag
  UNION ALL SELECT start, t.there, t.inline, t.ends, list_append(via, t.here), hops + 1, w.along + t.along, w.against + t.against, list_append(lines, t.line) FROM walk w JOIN told t ON t.here = w.here WHERE w.inline AND t.there <> start AND NOT list_contains(via, t.there)),
met AS (SELECT node_id, start, here AS other, via, hops, along + against AS verified_hops, list_sort(list_distinct(lines)) AS lines, CASE WHEN along = hops THEN 1 WHEN against = hops THEN -1 ELSE 0 END AS way FROM walk JOIN members ON tag = start WHERE NOT inline OR ends)"""


def _view(spark, sf_dir):
    edges, _ = _pipes(spark, sf_dir)
    o = s.table(spark, sf_dir, "orders")
    tag = lambda c: F.concat(F.lit("O"), F.col(c))
    nodes = o.select(tag("o_orderkey").alias("tag"), F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("equipment_type"), F.col("o_custkey").alias("node_id"))
    flows = edges.select(tag("a").alias("src"), tag("b").alias("dst"), (F.col("length") % 3 > 0).alias("verified"), F.array("style").alias("lines"))
    return condense.view(nodes.where("equipment_type in ('vessel', 'line')").select("node_id", "tag"), flows, nodes.select("tag", "equipment_type"))


@_register(f"""{_VIEW}, turned AS (SELECT node_id, CASE WHEN swap THEN other ELSE start END AS source, CASE WHEN swap THEN start ELSE other END AS target, CASE WHEN swap THEN list_reverse(via) ELSE via END AS via, CASE way WHEN 0 THEN 'unknown' ELSE 'known' END AS direction, verified_hops, hops, lines
  FROM (SELECT *, way = -1 OR way = 0 AND other < start AS swap FROM met))
SELECT node_id, source, target, array_to_string(via, ',') AS via, direction, verified_hops, hops, array_to_string(lines, ',') AS lines FROM turned
QUALIFY row_number() OVER (PARTITION BY node_id, source, target, direction, list_sort(via) ORDER BY via, hops, verified_hops, lines) = 1""")
def n_view_connections(spark, sf_dir):
    """What the items of every study node meet once in-line items are folded away."""
    found = _view(spark, sf_dir).connections
    return found.select("node_id", "source", "target", F.array_join("via", ",").alias("via"), "direction", "verified_hops", "hops", F.array_join("lines", ",").alias("lines"))


@_register(f"""{_VIEW}, seen AS (SELECT node_id, tag, 'member' AS role FROM members UNION ALL SELECT DISTINCT node_id, other, CASE WHEN kind IN ('line', 'valve', 'check_valve', 'relief_valve') THEN 'boundary' ELSE 'neighbour' END FROM met JOIN items ON items.tag = other
  WHERE (node_id, other) NOT IN (SELECT (node_id, tag) FROM members)),
taps AS (SELECT a AS tag, string_agg(DISTINCT b, ',' ORDER BY b) AS instruments FROM (SELECT src AS a, dst AS b FROM flows UNION ALL SELECT dst, src FROM flows) JOIN items ON items.tag = b WHERE kind = 'instrument' GROUP BY a)
SELECT node_id, s.tag, role, kind AS equipment_type, coalesce(instruments, '') AS instruments FROM seen s JOIN items i ON i.tag = s.tag LEFT JOIN taps t ON t.tag = s.tag""")
def n_view_items(spark, sf_dir):
    """The items of every study node's view with their roles and instruments."""
    return _view(spark, sf_dir).items.select("node_id", "tag", "role", "equipment_type", F.array_join("instruments", ",").alias("instruments"))


@_register(f"""WITH RECURSIVE {t._POINTS}, owned AS (SELECT id, page AS sheet, id % 3 AS owner, page * 10 + id % 3 AS page, x, y, CASE WHEN id % 5 = 0 THEN 'N' || id END AS label FROM points),
{_led_sql("owned", "id", "< 90")},
clusters AS (SELECT turn.id, turn.page, leader, label FROM turn JOIN led ON led.page = turn.page AND led.k = turn.k),
kept AS (SELECT page, leader, min([(label IS NULL)::BIGINT, id])[2] AS kept FROM clusters GROUP BY ALL),
named AS (SELECT id, kept FROM clusters JOIN kept USING (page, leader)),
pipes AS (SELECT id, id AS a, lead(id) OVER (PARTITION BY sheet ORDER BY id) AS b FROM owned)
SELECT p.id, x.kept AS a, y.kept AS b FROM pipes p JOIN named x ON x.id = p.a JOIN named y ON y.id = p.b WHERE x.kept <> y.kept""")
def geo_nozzles(spark, sf_dir):
    """Edges between the nozzles that are left once those of one owner that lie together are one."""
    points = t._points(spark, sf_dir)
    nozzles = points.withColumns({"owner": F.col("id") % 3, "label": F.when(F.col("id") % 5 == 0, F.concat(F.lit("N"), "id"))})
    pipes = points.select("id", F.col("id").alias("a"), F.lead("id").over(Window.partitionBy("page").orderBy("id")).alias("b")).where("b is not null")
    return symbols.merged_nozzles(nozzles, pipes, 90.0)[1].select("id", "a", "b")
