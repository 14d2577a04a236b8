"""Tag references, requirements, judged events, tallies and the rows of a study, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from piperack.functions.plant import GUIDEWORDS, PARAMETERS
from piperack.operators import graph, plants, records, studies
from piperack.plans import standins as s
from piperack.plans.study_queries import _MATRIX, _STUDIED

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put




@_register(f"""WITH texts AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS text_id, l_partkey, l_suppkey, l_linenumber FROM lineitem),
found AS (SELECT text_id, 'P-' || l_partkey AS tag FROM texts WHERE length(l_partkey::VARCHAR) <= 5 UNION SELECT text_id, 'TK-' || l_linenumber || 'B' FROM texts
  UNION SELECT text_id, 'X' || l_suppkey FROM texts WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION SELECT text_id, 'P-' || l_partkey FROM texts WHERE l_partkey IN (SELECT p_partkey FROM part))
SELECT text_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM found GROUP BY text_id""")
def au_tags(spark, sf_dir):
    """Texts that name a part by its shape, a supplier of good standing by its literal tag, and a standard."""
    lines = s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    number = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("Open P-"), number("l_partkey"), F.lit(" by X"), number("l_suppkey"), F.lit("-A, see IEC-"), number("l_linenumber"), F.lit(" and TK-"), number("l_linenumber"), F.lit("B."))
    texts = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("text_id"), text.alias("text"))
    known = s.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("X"), "s_suppkey").alias("tag"))
    known = known.union(s.table(spark, sf_dir, "part").select(F.concat(F.lit("P-"), "p_partkey")))
    return records.tag_references(texts, known).select("text_id", F.array_join("tags", ",").alias("tags"))


@_register("""SELECT conv_id, turn, CASE WHEN lower(trim(v)) NOT IN ('', 'null', 'none', 'nil', 'n/a', 'na', '-') THEN trim(v) END AS value
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '  None ' WHEN 1 THEN ' - ' WHEN 2 THEN ' ' || role || '  ' END AS v FROM conversations)""")
def x_value_or_null(spark, sf_dir):
    at = F.col("turn") % 4
    said = F.when(at == 0, "  None ").when(at == 1, " - ").when(at == 2, F.concat(F.lit(" "), "role", F.lit("  ")))
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", records.value_or_null(said).alias("value"))


_REQUIREMENT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'done' WHEN '2-HIGH' THEN 'partial' WHEN '5-LOW' THEN 'out_of_scope' WHEN '3-MEDIUM' THEN 'pending' ELSE 'todo' END"


def _requirements(spark, sf_dir):
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "done").when(p == "2-HIGH", "partial").when(p == "5-LOW", "out_of_scope").when(p == "3-MEDIUM", "pending").otherwise("todo")
    return s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("requirement_id"), F.col("o_orderstatus").alias("section"), status.alias("status"), F.lit("").alias("notes"), "o_custkey")


@_register(f"""WITH r AS (SELECT o_custkey AS requirement_id, {_REQUIREMENT} AS status FROM orders)
SELECT requirement_id, 'repeated' AS fault FROM r GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT requirement_id, 'status' FROM r GROUP BY requirement_id HAVING bool_or(status = 'pending')""".replace("SELECT requirement_id, 'repeated' AS fault FROM r GROUP BY ALL", "SELECT requirement_id, 'repeated' AS fault FROM r GROUP BY requirement_id"))
def rtm_faults(spark, sf_dir):
    """Orders as requirements numbered by customer, so that numbers repeat and some states are unknown."""
    return records.requirement_faults(_requirements(spark, sf_dir).select(F.col("o_custkey").alias("requirement_id"), "status"))


@_register(f"""WITH r AS (SELECT o_orderkey AS requirement_id, o_orderstatus AS section, {_REQUIREMENT} AS status FROM orders),
c AS (SELECT l_orderkey AS requirement_id, max(CASE WHEN l_linenumber = 1 AND l_linestatus = 'F' THEN 'done' END) AS status, 'lines ' || count(*) AS notes FROM lineitem GROUP BY ALL)
SELECT requirement_id, section, coalesce(c.status, r.status) AS status, coalesce(notes, '') AS notes FROM r LEFT JOIN c USING (requirement_id)""")
def rtm_updated(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem")
    done = F.max(F.when((F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "F"), "done"))
    changes = lines.groupBy(F.col("l_orderkey").alias("requirement_id")).agg(done.alias("status"), F.concat(F.lit("lines "), F.count(F.lit(1)).cast("string")).alias("notes"))
    bad = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("requirement_id"), F.lit("finished").alias("status"), F.lit("no such state").alias("notes"))
    return records.updated(_requirements(spark, sf_dir).drop("o_custkey"), changes.union(bad))


@_register(f"""WITH r AS (SELECT o_orderkey AS requirement_id, o_orderstatus AS section, {_REQUIREMENT} AS status FROM orders),
h AS (SELECT requirement_id, file, line, row_number() OVER (PARTITION BY requirement_id ORDER BY file, line) AS n FROM (SELECT DISTINCT l_orderkey AS requirement_id, l_suppkey AS file, l_linenumber AS line FROM lineitem)),
l AS (SELECT requirement_id, count(*) AS cited, string_agg(file || ':' || line, ' ' ORDER BY n) AS citations FROM h WHERE n <= 3 GROUP BY ALL)
SELECT requirement_id, section, status, coalesce(cited, 0) AS cited, coalesce(citations, '') AS citations FROM r LEFT JOIN l USING (requirement_id)""")
def rtm_view(spark, sf_dir):
    hits = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("requirement_id"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"))
    return records.requirement_view(_requirements(spark, sf_dir), hits, most=3).withColumn("citations", F.array_join("citations", " "))


@_register("""WITH e AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'edited' WHEN 'error' THEN 'rejected' ELSE event_type END AS action, CASE WHEN value >= 50 THEN 'text' END AS edited_text, CASE WHEN user_id % 7 <> 0 THEN user_id::VARCHAR END AS u FROM events),
f AS (SELECT *, CASE WHEN action NOT IN ('accepted', 'edited', 'rejected') THEN 'unknown action' WHEN action = 'edited' AND edited_text IS NULL THEN 'edited without text' WHEN u IS NULL THEN 'no user' END AS fault FROM e)
SELECT event_id, fault, CASE WHEN fault IS NULL AND action = 'accepted' THEN 'ai_generated_human_approved' WHEN fault IS NULL AND action = 'edited' THEN 'ai_generated_human_modified' END AS provenance FROM f""")
def tl_judged(spark, sf_dir):
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "accepted").when(kind == "click", "edited").when(kind == "error", "rejected").otherwise(kind)
    events = s.table(spark, sf_dir, "events").select("event_id", action.alias("action"), F.when(F.col("value") >= 50, "text").alias("edited_text"), F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")).alias("user"))
    return records.judged_events(events).select("event_id", "fault", "provenance")


@_register("SELECT l_suppkey AS supplier, count(*) FILTER (WHERE r) AS rejected, count(*) FILTER (WHERE NOT r) AS accepted, round(count(*) FILTER (WHERE r)::DOUBLE / count(*), 6) AS rate FROM (SELECT l_suppkey, l_returnflag = 'R' AS r FROM lineitem) GROUP BY ALL")
def au_hallucination(spark, sf_dir):
    return records.hallucination(s.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_returnflag") == "R").alias("rejected")), "supplier")


@_register("SELECT event_type, event_id AS label, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1")
def au_worst(spark, sf_dir):
    timings = s.table(spark, sf_dir, "events").where("value is not null").select("event_type", F.col("event_id").alias("ordinal"), F.col("event_id").alias("label"), "value")
    return records.worst(timings, "event_type")


@_register(f"""WITH {s.GRAPH_SQL}, pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(verified::INTEGER) AS v FROM edges GROUP BY ALL), ends AS (SELECT src AS tag FROM edges UNION SELECT dst FROM edges)
SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'verified', count(*) FROM edges WHERE verified UNION ALL SELECT 'drawn', count(*) FROM edges WHERE NOT verified
UNION ALL SELECT 'connections', count(*) FROM pairs UNION ALL SELECT 'directed connections', count(*) FROM pairs WHERE v > 0 UNION ALL SELECT 'anti-parallel pairs', count(*) FROM pairs WHERE v = 2 AND a <> b UNION ALL SELECT 'loops', count(*) FROM edges WHERE src = dst
UNION ALL SELECT 'isolated', count(*) FROM nodes WHERE tag NOT IN (SELECT tag FROM ends) UNION ALL SELECT 'unknown ends', count(*) FROM ends WHERE tag NOT IN (SELECT tag FROM nodes)""")
def g_overview(spark, sf_dir):
    return records.graph_overview(s.nodes(spark, sf_dir), s.edges(spark, sf_dir))


_LISTS = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@_register(f"""WITH {s.GRAPH_SQL}, matrix(parameter, i, guideword, g) AS (VALUES {_MATRIX}),
spread AS (SELECT tag AS node_id, unnest({_STUDIED}) AS parameter, unnest(range(len({_STUDIED}))) AS place FROM nodes),
evidence AS (SELECT ({_LISTS(PARAMETERS)})[(o_custkey % {len(PARAMETERS)})::INTEGER + 1] AS parameter, ({_LISTS(GUIDEWORDS)})[(o_orderkey % {len(GUIDEWORDS)})::INTEGER + 1] AS guideword, o_orderkey AS evidence_id, o_totalprice AS score FROM orders),
best AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY parameter, guideword ORDER BY score DESC, evidence_id) <= 5),
said AS (SELECT DISTINCT l_orderkey AS evidence_id, l_linenumber, l_partkey, l_suppkey, (['cause', 'consequence', 'safeguard'])[l_linenumber % 3 + 1] AS kind, l_partkey IN (SELECT p_partkey FROM part WHERE p_retailprice < 1500) AS grounded, CASE WHEN l_discount > 0.07 THEN 'contradicted' WHEN l_discount > 0.02 THEN 'supported' ELSE 'insufficient' END AS verdict FROM lineitem),
judged AS (SELECT *, grounded AND verdict <> 'contradicted' AS ok FROM said),
found AS (SELECT parameter, guideword, count(*) FILTER (WHERE ok AND kind = 'cause') AS a, count(*) FILTER (WHERE ok AND kind = 'consequence') AS b, count(*) FILTER (WHERE ok AND kind = 'safeguard') AS c, count(*) FILTER (WHERE NOT ok) AS rejected, min(CASE WHEN ok THEN CASE verdict WHEN 'supported' THEN 0.55::DOUBLE ELSE 0.3::DOUBLE END END) AS confidence FROM best JOIN judged USING (evidence_id) GROUP BY ALL)
SELECT node_id, parameter, guideword, (place * 100 + g)::INTEGER AS ordinal, coalesce(a, 0) AS causes, coalesce(b, 0) AS consequences, coalesce(c, 0) AS safeguards, coalesce(rejected, 0) AS rejected, coalesce(confidence, 0) AS confidence,
  concat_ws(',', CASE WHEN coalesce(a, 0) = 0 THEN 'causes' END, CASE WHEN coalesce(b, 0) = 0 THEN 'consequences' END, CASE WHEN coalesce(c, 0) = 0 THEN 'safeguards' END) AS missing
FROM spread JOIN matrix USING (parameter) LEFT JOIN found USING (parameter, guideword)""")
def ws_pipeline(spark, sf_dir):
    """Every item as a node; orders are evidence for a deviation, their lines the findings on it."""
    strings = lambda *x: F.array(*[F.lit(v) for v in x])
    kind = F.col("equipment_type")
    studied = F.when(kind.isin("pump", "compressor", "line"), strings("flow", "pressure")).when(kind.isin("vessel", "tank", "column"), strings("level", "pressure", "temperature", "composition")).otherwise(strings("flow"))
    nodes = s.nodes(spark, sf_dir).select(F.col("tag").alias("node_id"), studied.alias("parameters"))
    pick = lambda names, c: F.element_at(strings(*names), (F.col(c) % len(names) + 1).cast("int"))
    evidence = s.table(spark, sf_dir, "orders").select(pick(PARAMETERS, "o_custkey").alias("parameter"), pick(GUIDEWORDS, "o_orderkey").alias("guideword"), F.col("o_orderkey").alias("evidence_id"), F.col("o_totalprice").alias("score"))
    off = F.col("l_discount")
    verdict = F.when(off > 0.07, "contradicted").when(off > 0.02, "supported").otherwise("insufficient")
    lines = s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdict.alias("verdict")).distinct()
    findings = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "verdict").alias("finding_id"), F.col("l_orderkey").alias("evidence_id"), pick(("cause", "consequence", "safeguard"), "l_linenumber").alias("kind"), F.array(F.concat(F.lit("P"), "l_partkey")).alias("tags"), "verdict")
    known = s.table(spark, sf_dir, "part").where("p_retailprice < 1500").select(F.concat(F.lit("P"), "p_partkey").alias("tag"))
    return records.study_rows(nodes, evidence, findings, known).withColumn("missing", F.array_join("missing", ","))


_FOLDED = f"""WITH {s.CHAIN_SQL}, items AS (SELECT chain || '/' || pos AS tag, chain, pos, equipment_type, verified, next IS NOT NULL AS goes_on FROM chains),
stops AS (SELECT *, count(*) FILTER (WHERE NOT (verified AND goes_on)) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS drawn_before FROM items),
majors AS (SELECT * FROM stops WHERE equipment_type NOT IN ('valve', 'check_valve', 'relief_valve')),
hops AS (SELECT tag, equipment_type, lead(tag) OVER w AS other, lead(equipment_type) OVER w AS other_type, lead(drawn_before) OVER w = drawn_before AS sure FROM majors WINDOW w AS (PARTITION BY chain ORDER BY pos)),
met AS (SELECT * FROM hops WHERE other IS NOT NULL AND equipment_type <> 'instrument' AND other_type <> 'instrument'),
folded AS (SELECT tag, other, CASE WHEN sure THEN 'out' ELSE 'unknown' END AS flow FROM met UNION ALL SELECT other, tag, CASE WHEN sure THEN 'in' ELSE 'unknown' END FROM met)"""


def _lines(spark, sf_dir):
    """Each line of an order as an item of its own, connected with the order's next one; each order a plant."""
    chains = graph.cut(s.chains(spark, sf_dir))
    at = lambda k: F.concat_ws("/", F.col("chain").cast("string"), (F.col("pos") + k).cast("string"))
    plant = F.col("chain").alias("plant")
    nodes = chains.select(plant, at(0).alias("tag"), "equipment_type")
    edges = chains.where("next is not null").select(plant, at(0).alias("src"), at(1).alias("dst"), "verified")
    return nodes, edges


@_register(f"{_FOLDED} SELECT * FROM folded")
def n_folded(spark, sf_dir):
    nodes, edges = _lines(spark, sf_dir)
    return plants.folded_neighbours(nodes, edges).drop("plant")


_RULED = f"""{_FOLDED},
candidates AS (SELECT tag, equipment_type IN ('pump', 'compressor', 'heat_exchanger') AS breaks, chain, pos FROM majors WHERE equipment_type NOT IN ('instrument', 'line') AND tag IN (SELECT tag FROM folded)),
before AS (SELECT m.other AS tag, m.tag AS prev, m.sure FROM met m),
linked AS (SELECT c.*, coalesce(CASE WHEN c.breaks THEN b.sure AND p.tag IS NOT NULL ELSE NOT p.breaks END, false) AS joins FROM candidates c LEFT JOIN before b ON b.tag = c.tag LEFT JOIN candidates p ON p.tag = b.prev),
islands AS (SELECT *, sum((NOT joins)::INTEGER) OVER (PARTITION BY chain ORDER BY pos) AS island FROM linked),
headed AS (SELECT *, first_value(breaks) OVER (PARTITION BY chain, island ORDER BY pos) AS alone FROM islands),
placed AS (SELECT tag, CASE WHEN alone THEN tag ELSE min(tag) OVER (PARTITION BY chain, island) END AS first, CASE WHEN NOT breaks THEN 'grouped' WHEN alone THEN 'standalone' ELSE 'attached' END AS placed FROM headed)"""


@_register(f"{_RULED} SELECT 'PN-' || first AS node_id, tag, placed FROM placed")
def n_rules(spark, sf_dir):
    nodes, edges = _lines(spark, sf_dir)
    return studies.propose_by_rules(graph.cut(plants.folded_neighbours(nodes, edges)), nodes, by_plant=plants.components)


@_register(f"""{_RULED} SELECT 'PN-' || p.first AS node_id, p.tag AS at_member, f.other AS tag, f.flow,
  CASE i.equipment_type WHEN 'line' THEN 'unit boundary' WHEN 'compressor' THEN 'pressure break' WHEN 'pump' THEN 'pressure break' WHEN 'heat_exchanger' THEN 'phase change' ELSE 'adjacent section' END AS kind
FROM placed p JOIN folded f ON f.tag = p.tag JOIN items i ON i.tag = f.other LEFT JOIN placed o ON o.tag = f.other WHERE o.first IS NULL OR o.first <> p.first""")
def n_rule_boundaries(spark, sf_dir):
    nodes, edges = _lines(spark, sf_dir)
    neighbours = graph.cut(plants.folded_neighbours(nodes, edges))
    return studies.folded_boundaries(studies.propose_by_rules(neighbours, nodes, by_plant=plants.components), neighbours, nodes)


_ORDER_PATHS = f"""WITH {s.CHAIN_SQL}, items AS (SELECT chain || '/' || pos AS tag, chain, pos, equipment_type, verified OR next IS NULL AS sure FROM chains),
paths AS (SELECT chain, count(*) - 1 AS hops, bool_and(sure) AS sure, string_agg(tag, ' → ' ORDER BY pos) AS path FROM items GROUP BY chain HAVING count(*) BETWEEN 2 AND 13)"""


def _order_paths(spark, sf_dir):
    nodes, edges = _lines(spark, sf_dir)
    spread = nodes.select("plant", F.split_part("tag", F.lit("/"), F.lit(2)).cast("int").alias("pos"))
    at = lambda pos: F.concat_ws("/", F.col("plant").cast("string"), pos.cast("string"))
    ends = spread.groupBy("plant").agg(F.max("pos").alias("n")).where("n > 1").select("plant", at(F.lit(1)).alias("source"), at(F.col("n")).alias("target"))
    return nodes, plants.simple_paths(nodes, edges, ends)


@_register(f"{_ORDER_PATHS} SELECT chain::VARCHAR AS chain, hops, CASE WHEN sure THEN 'verified' ELSE 'unverified' END AS flow, path FROM paths")
def g_path_orders(spark, sf_dir):
    """From each order's first line to its last one, with the operator's own cutoff of 12 edges."""
    _, paths = _order_paths(spark, sf_dir)
    return paths.select(F.split_part("source", F.lit("/"), F.lit(1)).alias("chain"), (F.size("path") - 1).cast("long").alias("hops"), F.when(F.col("verified"), "verified").otherwise("unverified").alias("flow"), F.array_join("path", " → ").alias("path"))


@_register(f"{_ORDER_PATHS} SELECT chain::VARCHAR AS chain, tag FROM items JOIN paths USING (chain) WHERE equipment_type = 'check_valve'")
def g_check_valves_orders(spark, sf_dir):
    nodes, paths = _order_paths(spark, sf_dir)
    return graph.check_valves_between(paths, nodes).select(F.split_part("source", F.lit("/"), F.lit(1)).alias("chain"), F.col("node").alias("tag"))


@_register(f"""WITH {s.CHAIN_SQL}, ends AS (SELECT chain, min(pos) FILTER (WHERE pos > 1 AND equipment_type IN ('pump', 'compressor', 'valve', 'control_valve')) AS block, min(pos) FILTER (WHERE NOT verified AND next IS NOT NULL) AS drawn, count(*) FILTER (WHERE pos > 1 AND equipment_type = 'relief_valve') AS valves FROM chains GROUP BY chain),
free AS (SELECT chain, bool_or(pos <= coalesce(drawn, 1e9)) AS sure FROM chains JOIN ends USING (chain) WHERE equipment_type = 'relief_valve' AND pos > 1 AND pos <= coalesce(block, 1e9) GROUP BY chain)
SELECT chain::VARCHAR AS chain, CASE WHEN sure THEN 'verified' WHEN sure IS NOT NULL THEN 'drawn' WHEN valves > 0 THEN 'not credited' ELSE 'none' END AS outcome, valves FROM ends LEFT JOIN free USING (chain)""")
def g_relief_orders(spark, sf_dir):
    """The answer on relief for the first line of each order."""
    nodes, edges = _lines(spark, sf_dir)
    starts = nodes.where(F.col("tag").endswith("/1")).select("plant", F.col("tag").alias("start"))
    found = plants.relief_outcomes(nodes, edges, starts)
    return found.select(F.split_part("start", F.lit("/"), F.lit(1)).alias("chain"), "outcome", "valves")
