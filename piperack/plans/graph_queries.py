"""Graph queries over the whole flow graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from piperack.operators import graph
from piperack.plans import standins as s

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _load(spark, sf_dir):
    return s.nodes(spark, sf_dir), *s.walked(spark, sf_dir)  # walked once a level


def _reach_sql(forward: bool) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"""WITH RECURSIVE {s.GRAPH_SQL},
every(node) AS (SELECT {b} FROM graph, hub WHERE {a} = start UNION SELECT {b} FROM every JOIN graph ON {a} = node),
sure(node) AS (SELECT {b} FROM graph, hub WHERE {a} = start AND verified UNION SELECT {b} FROM sure JOIN graph ON {a} = node WHERE verified)
SELECT node AS tag, equipment_type, CASE WHEN node IN (SELECT node FROM sure) THEN 'verified' ELSE 'unverified' END AS flow
FROM every JOIN nodes ON tag = node WHERE node <> (SELECT start FROM hub)"""


def _reached(spark, sf_dir, forward):
    nodes, edges, walk = _load(spark, sf_dir)
    found = graph.reach(walk, graph.cut(s.hub(edges)), forward).select(F.col("node").alias("tag"), F.when(F.col("verified"), "verified").otherwise("unverified").alias("flow"))
    return nodes.join(found, "tag").select("tag", "equipment_type", "flow")


@_register(_reach_sql(True))
def g_downstream(spark, sf_dir):
    return _reached(spark, sf_dir, True)


@_register(_reach_sql(False))
def g_upstream(spark, sf_dir):
    return _reached(spark, sf_dir, False)


def _relief_sql() -> str:
    go = "JOIN nodes n ON n.tag = node AND (node = start OR n.equipment_type NOT IN ('pump', 'compressor', 'valve', 'control_valve'))"
    return f"""WITH RECURSIVE {s.GRAPH_SQL},
drawn(start, node) AS (SELECT start, start FROM hub UNION SELECT start, dst FROM drawn {go} JOIN graph ON src = node),
sure(start, node) AS (SELECT start, start FROM hub UNION SELECT start, dst FROM sure {go} JOIN graph ON src = node WHERE verified)
SELECT node AS relief_valve, CASE WHEN node IN (SELECT node FROM sure) THEN 'verified' ELSE 'unverified' END AS flow
FROM drawn JOIN nodes ON tag = node WHERE node <> start AND equipment_type = 'relief_valve'"""


@_register(_relief_sql())
def g_relief(spark, sf_dir):
    nodes, edges, walk = _load(spark, sf_dir)
    return graph.relief_paths(walk, nodes, graph.cut(s.hub(edges))).select(F.col("node").alias("relief_valve"), F.when(F.col("verified"), "verified").otherwise("unverified").alias("flow"))


def _isolation_sql() -> str:
    go = "JOIN nodes n ON n.tag = node AND (node = start OR n.equipment_type NOT IN ('valve', 'control_valve'))"
    return f"""WITH RECURSIVE {s.GRAPH_SQL},
down(start, node) AS (SELECT start, start FROM hub UNION SELECT start, dst FROM down {go} JOIN graph ON src = node),
up(start, node) AS (SELECT start, start FROM hub UNION SELECT start, src FROM up {go} JOIN graph ON dst = node)
SELECT node AS tag, side FROM (SELECT *, 'downstream' AS side FROM down UNION ALL SELECT *, 'upstream' FROM up) JOIN nodes ON tag = node
WHERE node <> start AND equipment_type IN ('valve', 'control_valve')"""


@_register(_isolation_sql())
def g_isolation(spark, sf_dir):
    nodes, edges, walk = _load(spark, sf_dir)
    return graph.isolation_boundary(walk, nodes, graph.cut(s.hub(edges))).select(F.col("node").alias("tag"), "side")


_PATHS_SQL = f"""WITH RECURSIVE {s.GRAPH_SQL},
sink AS (SELECT dst AS goal FROM edges, hub WHERE dst <> start GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
walks(node, path, sure) AS (SELECT start, [start], true FROM hub
  UNION ALL SELECT dst, list_append(path, dst), sure AND verified FROM walks JOIN graph ON src = node, sink WHERE len(path) <= 3 AND node <> goal AND NOT list_contains(path, dst)),
paths AS (SELECT path, sure FROM walks, sink WHERE node = goal)"""


def _paths(spark, sf_dir):
    nodes, edges, walk = _load(spark, sf_dir)
    start = graph.cut(s.hub(edges))
    sink = edges.join(start, edges.dst == start.start, "left_anti").groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1)
    ends = start.withColumn("one", F.lit(1)).join(sink.select(F.col("dst").alias("target"), F.lit(1).alias("one")), "one").select(F.col("start").alias("source"), "target")
    return nodes, graph.simple_paths(walk, graph.cut(ends), 3)


@_register(_PATHS_SQL + " SELECT len(path) - 1 AS hops, CASE WHEN sure THEN 'verified' ELSE 'unverified' END AS flow, array_to_string(path, ' → ') AS path FROM paths")
def g_path(spark, sf_dir):
    _, paths = _paths(spark, sf_dir)
    return paths.select((F.size("path") - 1).cast("long").alias("hops"), F.when(F.col("verified"), "verified").otherwise("unverified").alias("flow"), F.array_join("path", " → ").alias("path"))


@_register(_PATHS_SQL + " SELECT row_number() OVER (ORDER BY len(path), path) AS rank, len(path) - 1 AS hops, array_to_string(path, ' → ') AS path FROM paths QUALIFY rank <= 5")
def g_path_first(spark, sf_dir):
    """The answer's five shortest ones of the paths of g_path."""
    _, paths = _paths(spark, sf_dir)
    return graph.first_paths(paths).select(F.col("rank").cast("long").alias("rank"), (F.size("path") - 1).cast("long").alias("hops"), F.array_join("path", " → ").alias("path"))


@_register(_PATHS_SQL + " SELECT DISTINCT tag FROM (SELECT unnest(path) AS tag FROM paths) JOIN nodes USING (tag) WHERE equipment_type = 'check_valve'")
def g_check_valves(spark, sf_dir):
    nodes, paths = _paths(spark, sf_dir)
    return graph.check_valves_between(paths, nodes).select(F.col("node").alias("tag"))


@_register(f"""WITH {s.GRAPH_SQL},
seen AS (SELECT dst AS tag, CASE WHEN verified THEN 'FLOWS_TO (out)' ELSE 'CONNECTED_TO (unknown)' END AS relationship FROM edges, hub WHERE src = start
  UNION ALL SELECT src, CASE WHEN verified THEN 'FLOWS_TO (in)' ELSE 'CONNECTED_TO (unknown)' END FROM edges, hub WHERE dst = start)
SELECT tag, equipment_type, relationship FROM seen JOIN nodes USING (tag)""")
def g_neighbours(spark, sf_dir):
    nodes, edges, _ = _load(spark, sf_dir)
    found = graph.neighbours(edges, graph.cut(s.hub(edges)).select(F.col("start").alias("tag")))
    return found.select(F.col("neighbour").alias("tag"), "relationship").join(nodes, "tag").select("tag", "equipment_type", "relationship")


@_register(f"WITH {s.GRAPH_SQL} SELECT tag, name FROM nodes WHERE equipment_type = 'relief_valve'")
def g_list(spark, sf_dir):
    return s.nodes(spark, sf_dir).where("equipment_type = 'relief_valve'").select("tag", "name")


@_register(f"WITH {s.GRAPH_SQL} SELECT equipment_type, count(*) AS n FROM nodes GROUP BY ALL")
def g_count(spark, sf_dir):
    return s.nodes(spark, sf_dir).groupBy("equipment_type").agg(F.count(F.lit(1)).alias("n"))


@_register(f"""WITH {s.GRAPH_SQL},
ends AS (SELECT src AS tag, dst AS other FROM edges UNION SELECT dst, src FROM edges),
counts AS (SELECT tag, count(*) AS n FROM ends GROUP BY tag)
SELECT tag, unnest(['equipment_type', 'name', 'neighbours']) AS property, unnest([equipment_type, name, coalesce(n, 0)::VARCHAR]) AS value FROM nodes LEFT JOIN counts USING (tag)""")
def g_info(spark, sf_dir):
    nodes, edges, _ = _load(spark, sf_dir)
    ends = edges.select(F.col("src").alias("tag"), F.col("dst").alias("other"))
    counts = ends.union(ends.select("other", "tag")).distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    facts = F.map_from_arrays(F.array(*[F.lit(x) for x in ("equipment_type", "name", "neighbours")]), F.array("equipment_type", "name", F.coalesce("n", F.lit(0)).cast("string")))
    return nodes.join(counts, "tag", "left").select("tag", F.explode(facts).alias("property", "value"))


@_register(f"WITH {s.GRAPH_SQL} SELECT DISTINCT 'P' || o_custkey AS tag, 'P' || o_custkey IN (SELECT tag FROM nodes) AS known FROM orders")
def g_validate_tags(spark, sf_dir):
    tags = s.table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), "o_custkey").alias("tag"))
    return graph.known_tags(tags, s.nodes(spark, sf_dir))


@_register(f"WITH {s.GRAPH_SQL} SELECT src, dst, verified FROM edges WHERE src IN (SELECT tag FROM nodes WHERE equipment_type IN ('vessel', 'tank')) AND dst IN (SELECT tag FROM nodes WHERE equipment_type IN ('vessel', 'tank'))")
def g_induced_edges(spark, sf_dir):
    nodes, edges, _ = _load(spark, sf_dir)
    return graph.induced(edges, nodes.where("equipment_type in ('vessel', 'tank')"))


@_register("SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, max_by(l_linestatus = 'F', [l_orderkey, l_linenumber, (l_quantity * 100)::BIGINT, (l_extendedprice * 100)::BIGINT]) AS verified FROM lineitem GROUP BY ALL")
def g_last_wins_edges(spark, sf_dir):
    ordinal = F.struct("l_orderkey", F.col("l_linenumber").cast("long"), F.round(F.col("l_quantity") * 100).cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    rows = s.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), (F.col("l_linestatus") == "F").alias("verified"), ordinal.alias("at"))
    return graph.last_wins(rows, "at")


@_register(f"""WITH RECURSIVE {s.CHAIN_SQL},
hops AS (SELECT chain * 100 + pos AS id, chain, pos, verified FROM chains WHERE next IS NOT NULL),
links AS (SELECT a.id AS one, b.id AS other FROM hops a JOIN hops b ON b.chain = a.chain AND b.pos = a.pos + 1 JOIN chains i ON i.chain = b.chain AND i.pos = b.pos WHERE i.equipment_type IN ('valve', 'check_valve', 'relief_valve', 'line')),
both_ways AS (SELECT one, other FROM links UNION ALL SELECT other, one FROM links),
known(id) AS (SELECT id FROM hops WHERE verified UNION SELECT other FROM known JOIN both_ways ON one = id)
SELECT id, verified, NOT verified AND id IN (SELECT id FROM known) AS forced FROM hops""")
def g_passthrough(spark, sf_dir):
    found = graph.cut(s.chains(spark, sf_dir))
    item = lambda k: F.concat_ws("-", F.col("chain"), F.col("pos") + k)
    hops = found.where("next is not null").select((F.col("chain") * 100 + F.col("pos")).alias("id"), item(0).alias("src"), item(1).alias("dst"), "verified")
    return graph.pass_through(hops, found.select(item(0).alias("tag"), "equipment_type")).select("id", "verified", "forced")


@_register(f"""WITH {s.CHAIN_SQL},
flagged AS (SELECT *, equipment_type NOT IN ('valve', 'check_valve', 'relief_valve') AS stop FROM chains),
numbered AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY pos) AS part FROM flagged),
parts AS (SELECT chain, part, max(CASE WHEN stop THEN tag END) AS source, coalesce(string_agg(CASE WHEN NOT stop THEN tag END, ',' ORDER BY pos), '') AS via, count(*) AS hops, sum(verified::INTEGER) AS verified_hops FROM numbered WHERE part > 0 GROUP BY chain, part),
linked AS (SELECT *, lead(source) OVER (PARTITION BY chain ORDER BY part) AS target FROM parts)
SELECT chain, part::BIGINT AS part, source, target, via, hops, verified_hops::BIGINT AS verified_hops FROM linked WHERE target IS NOT NULL""")
def g_chain_fold(spark, sf_dir):
    return graph.fold_chains(s.chains(spark, sf_dir))


@_register(f"""WITH RECURSIVE {s.GRAPH_SQL},
inner_edges AS (SELECT src, dst FROM edges WHERE src IN (SELECT tag FROM nodes WHERE equipment_type IN ('pump', 'compressor')) AND dst IN (SELECT tag FROM nodes WHERE equipment_type IN ('pump', 'compressor'))),
both_ways AS (SELECT src, dst FROM inner_edges UNION SELECT dst, src FROM inner_edges),
walks(node, seen) AS (SELECT src, src FROM both_ways UNION SELECT node, dst FROM walks JOIN both_ways ON src = seen)
SELECT node, min(seen) AS component FROM walks GROUP BY node""")
def g_components(spark, sf_dir):
    nodes, edges, _ = _load(spark, sf_dir)
    return graph.components(graph.induced(edges, nodes.where("equipment_type in ('pump', 'compressor')")))


@_register(f"""WITH {s.GRAPH_SQL},
counted AS (SELECT e.src AS item, n.equipment_type, count(*) AS c FROM edges e JOIN nodes n ON n.tag = e.dst GROUP BY ALL)
SELECT item, string_agg(c || ' ' || replace(equipment_type, '_', ' ') || CASE WHEN c > 1 THEN 's' ELSE '' END, ' + ' ORDER BY equipment_type) AS description FROM counted GROUP BY item""")
def g_describe(spark, sf_dir):
    nodes, edges, _ = _load(spark, sf_dir)
    around = edges.select(F.col("src").alias("item"), F.col("dst").alias("tag")).join(nodes, "tag")
    return graph.describe(around, F.col("item")).withColumnRenamed("group", "item")


@_register(f"""WITH {s.GRAPH_SQL},
ends AS (SELECT src AS tag FROM edges UNION SELECT dst FROM edges)
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE verified) AS verified,
  (SELECT count(*) FROM nodes WHERE tag NOT IN (SELECT tag FROM ends)) AS isolated""")
def g_stats(spark, sf_dir):
    nodes, edges, _ = _load(spark, sf_dir)
    ends = edges.select(F.col("src").alias("tag")).union(edges.select("dst")).distinct().withColumn("used", F.lit(1))
    a = nodes.join(ends, "tag", "left").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("used").isNull().cast("long")).alias("isolated"), F.lit(1).alias("k"))
    b = edges.agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("verified").cast("long")).alias("verified"), F.lit(1).alias("k"))
    return a.join(b, "k").select("nodes", "edges", "verified", "isolated")
