"""Contraction, study nodes, questions, streams and formats."""

from __future__ import annotations


from pyspark.sql import functions as F

from piperack.functions import questions
from piperack.functions.plant import IN_LINE
from piperack.checkpoints import shared_folder, stored
from piperack.operators import contraction, graph, studies
from piperack.plans import standins as s
from piperack.sources import exports
from piperack.streaming import telemetry

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@_register(f"""WITH {s.CHAIN_SQL},
flagged AS (SELECT *, equipment_type NOT IN ('valve', 'check_valve', 'relief_valve') AS stop FROM chains),
numbered AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY pos) AS part FROM flagged),
parts AS (SELECT chain, part, max(CASE WHEN stop THEN tag END) AS source, bool_or(verified) AS sure FROM numbered WHERE part > 0 GROUP BY chain, part),
linked AS (SELECT source, sure, lead(source) OVER (PARTITION BY chain ORDER BY part) AS target FROM parts),
pairs AS (SELECT * FROM linked WHERE target IS NOT NULL AND source <> target),
known AS (SELECT DISTINCT source, target FROM pairs WHERE sure)
SELECT source, target, 'known' AS direction FROM known
UNION ALL SELECT DISTINCT least(source, target), greatest(source, target), 'unknown' FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE least(k.source, k.target) = least(p.source, p.target) AND greatest(k.source, k.target) = greatest(p.source, p.target))""")
def g_contract(spark, sf_dir):
    """Each line of an order is a drawn element, terminal unless its item is in line; each order a run of segments."""
    found = stored(s.chains(spark, sf_dir))
    element = lambda k: F.concat_ws("-", F.col("chain"), F.col("pos") + k)
    terminals = found.where(~F.col("equipment_type").isin(*IN_LINE)).select(element(0).alias("id"), "tag")
    lines = found.where("next is not null").select(element(0).alias("a"), element(1).alias("b"), F.array().cast("array<string>").alias("lines"), F.col("verified").cast("int").alias("direction"), F.lit("arrow").alias("source"))
    return contraction.contract(terminals, lines).select("source", "target", "direction")


_STUDY = f"""WITH RECURSIVE {s.GRAPH_SQL},
joining AS (SELECT tag FROM nodes WHERE equipment_type IN ('vessel', 'tank', 'column', 'heat_exchanger')),
inner_edges AS (SELECT src, dst FROM edges WHERE verified AND src IN (SELECT tag FROM joining) AND dst IN (SELECT tag FROM joining)),
both_ways AS (SELECT src, dst FROM inner_edges UNION SELECT dst, src FROM inner_edges),
walks(node, seen) AS (SELECT tag, tag FROM joining UNION SELECT node, dst FROM walks JOIN both_ways ON src = seen),
members AS (SELECT 'PN-' || min(seen) AS node_id, node AS tag FROM walks GROUP BY node)"""


def _members(spark, sf_dir):
    nodes, edges = s.nodes(spark, sf_dir), graph.cut(s.edges(spark, sf_dir))
    return nodes, edges, graph.cut(studies.propose(edges, nodes))


@_register(f"{_STUDY} SELECT node_id, tag FROM members")
def n_propose(spark, sf_dir):
    return _members(spark, sf_dir)[2]


@_register(f"""{_STUDY}, ends AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)
SELECT DISTINCT m.node_id, e.dst AS tag, CASE n.equipment_type WHEN 'line' THEN 'unit boundary' WHEN 'compressor' THEN 'pressure break' WHEN 'pump' THEN 'pressure break' WHEN 'heat_exchanger' THEN 'phase change' ELSE 'adjacent section' END AS kind
FROM members m JOIN ends e ON e.src = m.tag JOIN nodes n ON n.tag = e.dst WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.node_id = m.node_id AND o.tag = e.dst)""")
def n_boundaries(spark, sf_dir):
    nodes, edges, members = _members(spark, sf_dir)
    return studies.boundaries(members, edges, nodes)


@_register(f"""{_STUDY}, ends AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
counted AS (SELECT node_id, equipment_type, count(*) AS n FROM members JOIN nodes USING (tag) GROUP BY ALL),
described AS (SELECT node_id, sum(n)::BIGINT AS members, string_agg(n || ' ' || equipment_type, ' + ' ORDER BY equipment_type) AS described FROM counted GROUP BY node_id),
inside AS (SELECT a.node_id, count(*) AS n FROM edges e JOIN members a ON a.tag = e.src JOIN members b ON b.tag = e.dst AND b.node_id = a.node_id GROUP BY a.node_id),
beyond AS (SELECT m.node_id, count(DISTINCT e.dst) AS n FROM members m JOIN ends e ON e.src = m.tag WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.node_id = m.node_id AND o.tag = e.dst) GROUP BY m.node_id)
SELECT node_id, members, described, coalesce(i.n, 0) AS inner_edges, coalesce(b.n, 0) AS neighbours FROM described LEFT JOIN inside i USING (node_id) LEFT JOIN beyond b USING (node_id)""")
def n_condensed(spark, sf_dir):
    nodes, edges, members = _members(spark, sf_dir)
    return studies.condensed(members, edges, nodes)


# For each line's number the kind that its question must get and the words around the part (@) and the supplier ($).
_WORDINGS = {
    1: ("downstream", "Which vessels are downstream of @?"),
    2: ("upstream", "what feeds @"),
    3: ("path", "show the path from @ to $"),
    4: ("neighbours", "what is connected to @?"),
    5: ("relief", "Is @ protected against overpressure?"),
    6: ("info", "tell me about @"),
    7: ("count", "how many valves are there near @?"),
}
_WORDED = "CASE l_linenumber " + " ".join(f"WHEN {n} THEN '{kind}'" for n, (kind, _) in _WORDINGS.items()) + " END"


@_register(f"""WITH asked AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS question_id, {_WORDED} AS kind, CASE WHEN l_partkey IN (SELECT p_partkey FROM part) THEN 'P-' || l_partkey END AS tag, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier) THEN 'S-' || l_suppkey END AS other, l_linenumber AS n FROM lineitem),
plain AS (SELECT question_id, kind, tag, CASE kind WHEN 'path' THEN other END AS target, CASE n WHEN 1 THEN 'vessel' WHEN 7 THEN 'valve' END AS equipment_type FROM asked)
SELECT * FROM plain UNION ALL SELECT concat_ws(' ', n_nationkey, 0), 'list', NULL, NULL, 'relief_valve' FROM nation UNION ALL SELECT concat_ws(' ', n_nationkey, 1), 'no tag', NULL, NULL, 'compressor' FROM nation
UNION ALL SELECT concat_ws(' ', n_nationkey, 2), NULL, NULL, NULL, NULL FROM nation UNION ALL SELECT concat_ws(' ', n_nationkey, 3), 'ambiguous', NULL, NULL, NULL FROM nation""")
def q_intents(spark, sf_dir):
    """A question of each kind about the parts and suppliers of every line, and some that name no tag or one of several."""
    lines, nations = s.table(spark, sf_dir, "lineitem"), s.table(spark, sf_dir, "nation")
    part, supplier = F.concat(F.lit("p-"), "l_partkey"), F.concat(F.lit("S-"), "l_suppkey")
    wording = F.element_at(F.create_map(*[F.lit(x) for n, (_, words) in _WORDINGS.items() for x in (n, words)]), F.col("l_linenumber").cast("int"))
    asked = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("question_id"), F.replace(F.replace(wording, F.lit("@"), part), F.lit("$"), supplier).alias("question")).distinct()
    for k, words in enumerate(("list all relief valves in @", "what is downstream of the big compressor in @", "good morning to all of you, dear @", "tell me about X1")):
        asked = asked.union(nations.select(F.concat_ws(" ", "n_nationkey", F.lit(str(k))), F.replace(F.lit(words), F.lit("@"), F.translate("n_name", "0123456789", ""))))
    nodes = s.table(spark, sf_dir, "part").select(F.concat(F.lit("P-"), "p_partkey").alias("tag"))
    nodes = nodes.union(s.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S-"), "s_suppkey"))).union(spark.createDataFrame([("A-X1",), ("B-X1",)], "tag string"))
    return questions.intents(asked, nodes).select("question_id", "kind", "tag", "target", "equipment_type")


@_register("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s_telemetry_window(spark, sf_dir):
    """The stream's windows over the whole table, in its batch form."""
    found = telemetry.windowed(s.table(spark, sf_dir, "events"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_register("SELECT event_type AS kind, user_id AS actor, count(*) AS n FROM events GROUP BY ALL")
def x_jsonl_roundtrip(spark, sf_dir):
    """Events appended as JSON lines in two writes, read back with a schema, and counted."""
    events = s.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("actor"), "value")
    from uuid import uuid4

    folder = f"{shared_folder(spark)}/jsonl-{uuid4().hex}"
    for half in (events.where("value >= 50"), events.where("value < 50 or value is null")):
        exports.append_jsonl(half, folder)
    return spark.read.schema("kind string, actor long, value double").option("mode", "FAILFAST").json(folder).groupBy("kind", "actor").agg(F.count(F.lit(1)).alias("n"))


@_register("""SELECT l_orderkey AS node_id, l_returnflag AS deviation, len(list(l_partkey)) AS findings, sum(l_linenumber)::BIGINT AS ordinals FROM lineitem GROUP BY ALL""")
def x_worksheet_json(spark, sf_dir):
    """Findings nested to JSON rows, read back and counted."""
    findings = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_returnflag").alias("deviation"), F.col("l_linestatus").alias("kind"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit('"P'), F.col("l_partkey"), F.lit('"\n')).alias("text"), F.col("l_discount").alias("confidence"))
    rows = exports.worksheet_json(findings).select(F.from_json("row", "node_id long, deviation string, findings array<struct<ordinal:int>>").alias("r")).select("r.*")
    return rows.select("node_id", "deviation", F.size("findings").cast("long").alias("findings"), F.aggregate("findings", F.lit(0).cast("long"), lambda n, f: n + f["ordinal"]).alias("ordinals"))


_SAID = """CASE n WHEN 1 THEN 'MATCH ' || st || '-[:FLOWS_TO*1..12]->(found:PlantItem) WHERE found.equipment_type = "vessel" RETURN DISTINCT found.tag, found.equipment_type'
  WHEN 2 THEN 'MATCH (found:PlantItem)-[:FLOWS_TO*1..12]->' || st || ' RETURN DISTINCT found.tag, found.equipment_type'
  WHEN 3 THEN 'MATCH way = ' || st || '-[:FLOWS_TO*1..12]->(goal:PlantItem {tag: "S-' || l_suppkey || '"}) RETURN way ORDER BY length(way)'
  WHEN 4 THEN 'MATCH ' || st || '-[way:FLOWS_TO|CONNECTED_TO]-(found:PlantItem) RETURN found.tag, type(way)'
  WHEN 5 THEN 'MATCH way = ' || st || '-[:FLOWS_TO*1..12]->(found:PlantItem) WHERE found.equipment_type = "relief_valve" RETURN way'
  WHEN 6 THEN 'MATCH ' || st || ' RETURN start' ELSE 'MATCH (found:PlantItem) WHERE found.equipment_type = "valve" RETURN found.equipment_type, count(found)' END"""


@_register(f"""SELECT l_orderkey, l_linenumber, l_partkey, {_SAID} AS statement FROM (SELECT *, l_linenumber AS n, '(start:PlantItem {{tag: "P-' || l_partkey || '"}})' AS st FROM lineitem)""")
def x_intent_cypher(spark, sf_dir):
    """An intent of each kind about every line's part, as a statement for a graph store."""
    n = F.col("l_linenumber")
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in _WORDINGS.values()]), n.cast("int"))
    lines = s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"), F.concat(F.lit("P-"), "l_partkey").alias("tag"), F.concat(F.lit("S-"), "l_suppkey").alias("target"), F.when(n == 1, "vessel").when(n == 7, "valve").alias("equipment_type"))
    return exports.intent_cypher(lines).select("l_orderkey", "l_linenumber", "l_partkey", "statement")
