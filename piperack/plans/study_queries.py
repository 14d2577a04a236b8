"""Worksheet, screening, audit and reporting queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from piperack.functions.plant import PARAMETER_GUIDEWORDS, PARAMETERS, STOP_WORDS, content_words
from piperack.operators import audit, worksheet
from piperack.plans import standins as s

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


_MATRIX = ", ".join(f"('{p}', {i}, '{g}', {j})" for i, p in enumerate(PARAMETERS) for j, g in enumerate(("NO", "MORE", "LESS", "AS_WELL_AS", "PART_OF", "REVERSE", "OTHER_THAN", "EARLY", "LATE", "BEFORE", "AFTER")) if g in PARAMETER_GUIDEWORDS[p])
_STUDIED = "CASE WHEN equipment_type IN ('pump', 'compressor', 'line') THEN ['flow', 'pressure'] WHEN equipment_type IN ('vessel', 'tank', 'column') THEN ['level', 'pressure', 'temperature', 'composition'] ELSE ['flow'] END"


@_register(f"""WITH {s.GRAPH_SQL}, matrix(parameter, i, guideword, g) AS (VALUES {_MATRIX}),
spread AS (SELECT tag AS node_id, unnest({_STUDIED}) AS parameter, unnest(range(len({_STUDIED}))) AS place FROM nodes)
SELECT node_id, parameter, guideword, (place * 100 + g)::INTEGER AS ordinal FROM spread JOIN matrix USING (parameter)""")
def ws_matrix(spark, sf_dir):
    strings = lambda *x: F.array(*[F.lit(v) for v in x])
    kind = F.col("equipment_type")
    studied = F.when(kind.isin("pump", "compressor", "line"), strings("flow", "pressure")).when(kind.isin("vessel", "tank", "column"), strings("level", "pressure", "temperature", "composition")).otherwise(strings("flow"))
    return worksheet.deviations(s.nodes(spark, sf_dir).select(F.col("tag").alias("node_id"), studied.alias("parameters")))


@_register("""WITH known AS (SELECT 'P' || p_partkey AS tag FROM part WHERE p_retailprice < 1500),
refs AS (SELECT l_orderkey AS finding_id, 'P' || l_partkey AS tag FROM lineitem),
bad AS (SELECT finding_id, list_sort(list(DISTINCT tag)) AS tags FROM refs WHERE tag NOT IN (SELECT tag FROM known) GROUP BY finding_id)
SELECT f.finding_id, coalesce(array_to_string(tags, ','), '') AS invalid_tags, tags IS NULL AS grounded FROM (SELECT DISTINCT finding_id FROM refs) f LEFT JOIN bad USING (finding_id)""")
def ws_stage_a(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem")
    findings = lines.groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.collect_set(F.concat(F.lit("P"), "l_partkey")).alias("tags"))
    known = s.table(spark, sf_dir, "part").where("p_retailprice < 1500").select(F.concat(F.lit("P"), "p_partkey").alias("tag"))
    return worksheet.stage_a(findings, known).select("finding_id", F.array_join("invalid_tags", ",").alias("invalid_tags"), "grounded")


_STAGE_B = """cited AS (SELECT l_orderkey AS finding_id, CASE l_returnflag WHEN 'R' THEN 'contradicted' WHEN 'A' THEN 'supported' ELSE 'insufficient' END AS verdict, 0.95 - l_discount AS confidence FROM lineitem),
summed AS (SELECT finding_id, count(*) AS cited, sum((verdict = 'supported')::INTEGER) AS k, bool_or(verdict = 'contradicted') AS bad, max(confidence) AS old FROM cited GROUP BY ALL),
gated AS (SELECT finding_id, CASE WHEN bad THEN 'rejected' WHEN k = 0 THEN 'unsupported inference' WHEN k < cited THEN 'stripped' ELSE 'released' END AS outcome, CASE WHEN bad THEN 0 ELSE k END::BIGINT AS kept,
  CASE WHEN bad THEN NULL WHEN k < cited THEN round(least(old, CASE WHEN k > 0 THEN 0.4 + 0.15 * k ELSE 0.3 END), 3) ELSE old END::DOUBLE AS confidence FROM summed)"""


def _verdicts(spark, sf_dir):
    flag = F.col("l_returnflag")
    verdict = F.when(flag == "R", "contradicted").when(flag == "A", "supported").otherwise("insufficient")
    return s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), verdict.alias("verdict"), (0.95 - F.col("l_discount")).alias("confidence"))


@_register(f"WITH {_STAGE_B} SELECT finding_id, outcome, kept, round(confidence, 6) AS confidence FROM gated")
def ws_stage_b(spark, sf_dir):
    return worksheet.stage_b(_verdicts(spark, sf_dir)).select("finding_id", "outcome", F.col("kept").cast("long").alias("kept"), F.round("confidence", 6).alias("confidence"))


@_register("SELECT l_orderkey AS finding_id, count(*) AS citations, round(least(0.95, 0.4 + 0.15 * count(*)), 3)::DOUBLE AS confidence FROM lineitem GROUP BY ALL")
def ws_confidence(spark, sf_dir):
    counted = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.count(F.lit(1)).alias("citations"))
    return counted.select("finding_id", "citations", worksheet.confidence(F.col("citations")).alias("confidence"))


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN ({1}))"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@_register(f"""WITH told AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
sized AS (SELECT conv_id, turn, {_WORDS.format("coalesce(text, '')", _STOPS)} AS a, {_WORDS.format("coalesce(before, '')", _STOPS)} AS b FROM told),
shared AS (SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END AS share FROM sized)
SELECT conv_id, turn, round(share, 6) AS share, CASE WHEN share >= 0.5 THEN 'supported' ELSE 'insufficient' END AS verdict FROM shared""")
def ws_lexical_overlap(spark, sf_dir):
    told = s.table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    share, verdict = worksheet.lexical_verdict(F.col("text"), F.col("before"))
    return told.select("conv_id", "turn", F.round(share, 6).alias("share"), verdict.alias("verdict"))


@_register(f"""WITH told AS (SELECT conv_id, role, len({_WORDS.format("coalesce(text, '')", _STOPS)}) AS n FROM conversations)
SELECT role, count(*) AS turns, sum(n)::BIGINT AS words, round(avg(n), 6) AS mean_words FROM told GROUP BY ALL""")
def ws_content_words(spark, sf_dir):
    n = F.size(content_words(F.col("text")))
    return s.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(n).alias("words"), F.round(F.avg(n), 6).alias("mean_words"))


@_register("""SELECT o_orderpriority AS priority, count(*) AS rows, sum((a = 0)::INTEGER)::BIGINT AS without_causes, sum((n = 0)::INTEGER)::BIGINT AS without_consequences, sum((r = 0)::INTEGER)::BIGINT AS without_safeguards,
  sum((c < 0.5)::INTEGER)::BIGINT AS low_confidence, round(min(c), 6) AS min_confidence
FROM (SELECT o_orderkey, o_orderpriority, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, coalesce(max(l_discount) * 9, 0) AS c
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY ALL""")
def ws_critic(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem")
    flagged = lambda f: F.sum((F.col("l_returnflag") == f).cast("int"))
    sums = lines.groupBy("l_orderkey").agg(flagged("A").alias("n_causes"), flagged("N").alias("n_consequences"), flagged("R").alias("n_safeguards"), (F.max("l_discount") * 9).alias("confidence"))
    orders = s.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("group"))
    found = worksheet.critic(orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    return found.withColumnRenamed("group", "priority").withColumn("min_confidence", F.round("min_confidence", 6))


@_register("""WITH r AS (SELECT o_custkey AS g, o_orderkey AS label, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, max(l_discount) * 9 AS c
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
found AS (SELECT 'without causes' AS kind, g, label FROM r WHERE a = 0 UNION SELECT 'without consequences', g, label FROM r WHERE n = 0 UNION SELECT 'without safeguards', g, label FROM r WHERE r = 0 UNION SELECT 'low confidence', g, label FROM r WHERE coalesce(c, 0) < 0.5
  UNION SELECT 'missing', o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) NOT IN (SELECT (g, label) FROM r))
SELECT kind, g AS customer, string_agg(label::VARCHAR, ',' ORDER BY label) AS labels FROM found GROUP BY ALL""".replace("(o_custkey, o_orderkey) NOT IN (SELECT (g, label) FROM r)", "NOT EXISTS (SELECT 1 FROM r WHERE g = o_custkey AND label = o_orderkey)"))
def ws_critic_report(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem")
    flagged = lambda f: F.sum((F.col("l_returnflag") == f).cast("int"))
    sums = lines.groupBy("l_orderkey").agg(flagged("A").alias("n_causes"), flagged("N").alias("n_consequences"), flagged("R").alias("n_safeguards"), (F.max("l_discount") * 9).alias("confidence"))
    orders = s.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("label")).distinct()
    rows = orders.join(sums, F.col("label") == F.col("l_orderkey")).drop("l_orderkey")
    found = worksheet.critic_report(rows, orders)
    return found.select("kind", F.col("group").alias("customer"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@_register(f"""WITH {s.GRAPH_SQL}, cases AS (SELECT tag AS case_id, equipment_type, CASE WHEN p_size % 3 = 0 THEN 'reverse_flow' WHEN equipment_type = 'heat_exchanger' THEN 'no_flow' ELSE 'blocked_outlet' END AS deviation, p_retailprice AS p, p_size FROM nodes JOIN part ON 'P' || p_partkey = tag)
SELECT case_id, equipment_type, deviation,
  CASE WHEN deviation = 'reverse_flow' THEN 'reverse_flow' WHEN deviation = 'no_flow' THEN 'heating_medium' WHEN equipment_type = 'pump' AND p_size % 2 = 0 THEN 'pump_shutoff' WHEN equipment_type = 'pump' THEN 'pump_deadhead'
    WHEN equipment_type = 'compressor' THEN 'compressor_relief' WHEN equipment_type IN ('vessel', 'tank') THEN 'source_pressure' ELSE 'no rule' END AS rule,
  CASE WHEN deviation = 'reverse_flow' THEN NULL WHEN deviation = 'no_flow' OR equipment_type IN ('compressor', 'vessel', 'tank') OR (equipment_type = 'pump' AND p_size % 2 = 0) THEN p WHEN equipment_type = 'pump' THEN round(1.2::DOUBLE * p, 3) END AS low,
  CASE WHEN deviation = 'reverse_flow' THEN NULL WHEN deviation = 'no_flow' OR equipment_type IN ('compressor', 'vessel', 'tank') OR (equipment_type = 'pump' AND p_size % 2 = 0) THEN p WHEN equipment_type = 'pump' THEN round(1.5::DOUBLE * p, 3) END AS high
FROM cases""")
def sc_rules(spark, sf_dir):
    parts = s.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("tag"), "p_size", "p_retailprice")
    cases = s.nodes(spark, sf_dir).join(parts, "tag")
    deviation = F.when(F.col("p_size") % 3 == 0, "reverse_flow").when(F.col("equipment_type") == "heat_exchanger", "no_flow").otherwise("blocked_outlet")
    names = ("normal_discharge_pressure", "relief_set_pressure", "max_source_pressure", "heating_medium_temperature")
    conditions = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*["p_retailprice"] * len(names)))
    shutoff = F.when(F.col("p_size") % 2 == 0, F.map_concat(conditions, F.create_map(F.lit("shutoff_pressure"), F.col("p_retailprice")))).otherwise(conditions)
    return worksheet.screen(cases.select(F.col("tag").alias("case_id"), "equipment_type", deviation.alias("deviation"), shutoff.alias("conditions")))


@_register("""SELECT source, count(*) AS expected, count(*) FILTER (WHERE n_chars >= 1000) AS found, round(count(*) FILTER (WHERE n_chars >= 1000)::DOUBLE / count(*), 6) AS recall
FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) GROUP BY ALL""")
def au_gold_recall(spark, sf_dir):
    docs = s.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    good = s.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return audit.recall(docs.join(good, "doc_id", "left_semi"), docs.where("n_chars >= 1000"), "doc_id", "source")


@_register("""WITH refs AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT count(*) AS "references", count(*) FILTER (WHERE g) AS grounded, round(count(*) FILTER (WHERE g)::DOUBLE / count(*), 6) AS precision FROM (SELECT l_partkey IN (SELECT p_partkey FROM part WHERE p_retailprice < 1500) AS g FROM refs)""")
def au_grounding(spark, sf_dir):
    texts = s.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("tags"))
    known = s.table(spark, sf_dir, "part").where("p_retailprice < 1500").select(F.col("p_partkey").alias("tag"))
    return audit.grounding_precision(texts, known)


@_register("""WITH f AS (SELECT l_suppkey AS supplier, l_linestatus = 'F' AS checked, l_returnflag <> 'A' AS failed, l_returnflag = 'R' AS refused, l_returnflag = 'A' AND l_linestatus = 'F' AS verified FROM lineitem)
SELECT supplier, count(*) AS citation_bearing, count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE checked AND failed) AS failures, count(*) FILTER (WHERE refused) AS refused, count(*) FILTER (WHERE NOT refused) AS released,
  count(*) FILTER (WHERE NOT refused AND NOT verified) AS unverified, round(coalesce(count(*) FILTER (WHERE checked AND failed)::DOUBLE / nullif(count(*) FILTER (WHERE checked), 0), 0), 6) AS failure_rate,
  round(coalesce(count(*) FILTER (WHERE NOT refused AND NOT verified)::DOUBLE / nullif(count(*) FILTER (WHERE NOT refused), 0), 0), 6) AS unverified_rate FROM f GROUP BY ALL""")
def au_fabrication(spark, sf_dir):
    flag, done = F.col("l_returnflag"), F.col("l_linestatus") == "F"
    findings = s.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), done.alias("checked"), (flag != "A").alias("failed"), (flag == "R").alias("refused"), ((flag == "A") & done).alias("verified"))
    return audit.fabrication(findings, "supplier")


@_register("SELECT event_type, count(value) AS n, quantile_disc(value, 0.95) AS percentile FROM events GROUP BY ALL")
def au_p95(spark, sf_dir):
    return audit.nearest_rank(s.table(spark, sf_dir, "events"), "event_type", "value", 0.95)


@_register("""WITH seeded AS (SELECT CASE WHEN quality = 0 THEN 'dropped' ELSE 'blanked' END AS kind, doc_id FROM labels),
reported AS (SELECT CASE WHEN n_chars < 2000 THEN 'dropped' ELSE 'blanked' END AS kind, doc_id FROM documents)
SELECT s.kind, count(*) AS seeded, count(r.doc_id) AS detected, round(count(r.doc_id)::DOUBLE / count(*), 6) AS rate FROM seeded s LEFT JOIN reported r ON r.kind = s.kind AND r.doc_id = s.doc_id GROUP BY ALL""")
def au_omission_detection(spark, sf_dir):
    seeded = s.table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 0, "dropped").otherwise("blanked").alias("kind"), F.col("doc_id").alias("label"))
    reported = s.table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") < 2000, "dropped").otherwise("blanked").alias("kind"), F.col("doc_id").alias("label"))
    return audit.omission_detection(seeded, reported)


@_register("""SELECT gate, value, target, CASE WHEN gate = 'latency' THEN value <= target ELSE value >= target END AS passed FROM (
  SELECT 'coverage' AS gate, round((SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))::DOUBLE / (SELECT count(*) FROM labels), 6) AS value, 0.85::DOUBLE AS target
  UNION ALL SELECT 'grounding', round(avg((l_partkey IN (SELECT p_partkey FROM part WHERE p_retailprice < 1500))::INTEGER), 6), 0.98::DOUBLE FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT 'latency', round(quantile_disc(value, 0.95), 6), 10::DOUBLE FROM events)""")
def au_scorecard(spark, sf_dir):
    labels, docs = s.table(spark, sf_dir, "labels").select("doc_id"), s.table(spark, sf_dir, "documents").select("doc_id")
    covered = audit.recall(labels.withColumn("all", F.lit("all")), docs, "doc_id", "all").select(F.lit("coverage").alias("gate"), F.col("recall").alias("value"), F.lit(0.85).alias("target"))
    grounded = au_grounding(spark, sf_dir).select(F.lit("grounding"), "precision", F.lit(0.98))
    slow = audit.nearest_rank(s.table(spark, sf_dir, "events").withColumn("all", F.lit("all")), "all", "value", 0.95).select(F.lit("latency"), F.round("percentile", 6), F.lit(10.0))
    gates = covered.union(grounded).union(slow)
    return gates.select("*", F.when(F.col("gate") == "latency", F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target")).alias("passed"))


_EVENTS = """e AS (SELECT event_id, user_id, ts, value, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'edited' WHEN 'error' THEN 'rejected' END AS action,
  (['cause', 'consequence', 'safeguard'])[(props ->> '$.k')::INTEGER % 3 + 1] AS kind FROM events WHERE event_type IN ('purchase', 'click', 'error'))"""


def _decided(spark, sf_dir):
    kinds = F.array(F.lit("cause"), F.lit("consequence"), F.lit("safeguard"))
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "accepted").when(kind == "click", "edited").when(kind == "error", "rejected")
    events = s.table(spark, sf_dir, "events").where("event_type in ('purchase', 'click', 'error')")
    return events.select("event_id", "user_id", "ts", "value", action.alias("action"), F.element_at(kinds, F.get_json_object("props", "$.k").cast("int") % 3 + 1).alias("kind"))


@_register(f"WITH {_EVENTS} SELECT action, kind, count(*) AS n FROM e GROUP BY GROUPING SETS ((action, kind), (action), (kind), ())")
def tl_summary(spark, sf_dir):
    return audit.decisions(_decided(spark, sf_dir).select("action", "kind"))


@_register(f"WITH {_EVENTS} SELECT kind, round(count(*) FILTER (WHERE action = 'accepted')::DOUBLE / count(*), 6) AS accepted, round(count(*) FILTER (WHERE action = 'edited')::DOUBLE / count(*), 6) AS edited, round(count(*) FILTER (WHERE action = 'rejected')::DOUBLE / count(*), 6) AS rejected FROM e GROUP BY ALL")
def tl_rates(spark, sf_dir):
    share = lambda a: F.round(audit.rate(F.sum((F.col("action") == a).cast("long")), F.count(F.lit(1)), 0.0), 6).alias(a)
    return _decided(spark, sf_dir).groupBy("kind").agg(share("accepted"), share("edited"), share("rejected"))


@_register(f"WITH {_EVENTS} SELECT ts::DATE::VARCHAR AS day, action, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ROLLUP (ts::DATE::VARCHAR, action)")
def tl_rollup(spark, sf_dir):
    return _decided(spark, sf_dir).rollup(F.to_date("ts").cast("string").alias("day"), "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_register(f"WITH {_EVENTS} SELECT user_id, event_id, action, kind FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def tl_latest(spark, sf_dir):
    return audit.latest(_decided(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("event_id")], ["event_id", "action", "kind"])


_STATUS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'done' WHEN '2-HIGH' THEN 'partial' WHEN '5-LOW' THEN 'out_of_scope' ELSE 'todo' END"


@_register(f"""SELECT section, count(*) AS total, round(coalesce(sum(CASE status WHEN 'done' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'todo' THEN 0.0 END)::DOUBLE / nullif(count(*) FILTER (WHERE status <> 'out_of_scope'), 0), 1), 3) AS progress
FROM (SELECT o_orderstatus AS section, {_STATUS} AS status FROM orders) GROUP BY ROLLUP (section)""")
def rtm_rollup(spark, sf_dir):
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "done").when(p == "2-HIGH", "partial").when(p == "5-LOW", "out_of_scope").otherwise("todo")
    return audit.traceability(s.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("section"), status.alias("status")))


@_register("""WITH hits AS (SELECT DISTINCT l_partkey AS part, l_orderkey AS file, l_linenumber AS line FROM lineitem)
SELECT part, file, line, row_number() OVER (PARTITION BY part ORDER BY file, line) AS rank FROM hits QUALIFY rank <= 12""")
def rtm_citations(spark, sf_dir):
    hits = s.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    return audit.first_hits(hits, "part", ["file", "line"]).withColumn("rank", F.col("rank").cast("long"))
