"""What sheets show: areas, axes, classes, tags and directions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from piperack.functions import sheets
from piperack.plans import standins as s

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


@_register("""SELECT l_linenumber AS way, count(*) AS n, count(*) FILTER (WHERE x BETWEEN 200 AND 2200 AND y BETWEEN 200 AND 1450 AND NOT (x BETWEEN 1795 AND 2350 AND y BETWEEN 1295 AND 1470)) AS inside
FROM (SELECT l_linenumber, l_partkey % 2500 AS x, l_suppkey * 37 % 1700 AS y FROM lineitem) GROUP BY ALL""")
def geo_content(spark, sf_dir):
    places = s.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("way"), (F.col("l_partkey") % 2500).alias("x"), (F.col("l_suppkey") * 37 % 1700).alias("y"))
    return places.groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.sum(sheets.in_content(F.col("x"), F.col("y")).cast("long")).alias("inside"))


@_register("""WITH a AS (SELECT l_quantity::DOUBLE - 25.5 AS dx, l_linenumber * 9.0 - 31 AS dy FROM lineitem), d AS (SELECT dx, dy, (degrees(atan2(dy, dx)) + 360) % 180 AS g FROM a)
SELECT dx, dy, CASE WHEN g < 15 OR g > 165 THEN 'H' WHEN g > 75 AND g < 105 THEN 'V' ELSE 'D' END AS axis, count(*) AS n FROM d GROUP BY ALL""")
def geo_axis(spark, sf_dir):
    arrows = s.table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("double") - 25.5).alias("dx"), (F.col("l_linenumber") * 9.0 - 31).alias("dy"))
    return arrows.groupBy("dx", "dy", sheets.axis(F.col("dx"), F.col("dy")).alias("axis")).agg(F.count(F.lit(1)).alias("n"))


@_register(f"""WITH {s.GRAPH_SQL}, v AS (SELECT tag, equipment_type, (['gate', 'ball', 'check', 'safety', 'angle', 'odd', NULL])[p_size % 7 + 1] AS sub, p_size % 2 = 0 AS ball, CASE WHEN p_size % 5 = 0 THEN 'PSV ' || p_partkey WHEN p_size % 5 = 1 THEN 'PT ' || p_partkey END AS mark FROM nodes JOIN part ON 'P' || p_partkey = tag),
c AS (SELECT *, coalesce(CASE sub WHEN 'gate' THEN 'GateValve' WHEN 'ball' THEN 'BallValve' WHEN 'check' THEN 'CheckValve' WHEN 'safety' THEN 'SafetyValve' WHEN 'angle' THEN 'AngleValve' END, CASE WHEN ball THEN 'BallValve' ELSE 'GateValve' END) AS cls FROM v)
SELECT tag, cls AS valve_class, CASE cls WHEN 'CheckValve' THEN 'check_valve' WHEN 'SafetyValve' THEN 'relief_valve' ELSE 'valve' END AS valve_type, CASE WHEN coalesce(mark, '') LIKE 'PSV%' THEN 'SafetyValveOrFitting' ELSE 'ProcessInstrumentationFunction' END AS instrument_class,
  CASE equipment_type WHEN 'check_valve' THEN 'CheckValve' WHEN 'relief_valve' THEN 'ReliefValve' WHEN 'control_valve' THEN 'ControlValve' WHEN 'heat_exchanger' THEN 'HeatExchanger' ELSE upper(equipment_type[1]) || equipment_type[2:] END AS label FROM c""")
def x_classes(spark, sf_dir):
    size = F.col("p_size")
    parts = s.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("tag"), "p_partkey", "p_size")
    sub = F.get(F.array(*[F.lit(x) for x in ("gate", "ball", "check", "safety", "angle", "odd", None)]), size % 7)
    mark = F.when(size % 5 == 0, F.concat(F.lit("PSV "), "p_partkey")).when(size % 5 == 1, F.concat(F.lit("PT "), "p_partkey"))
    made = s.nodes(spark, sf_dir).join(parts, "tag").select("tag", "equipment_type", sheets.valve_class(sub, size % 2 == 0).alias("valve_class"), sheets.instrument_class(mark).alias("instrument_class"))
    return made.select("tag", "valve_class", sheets.type_of_class(F.col("valve_class")).alias("valve_type"), "instrument_class", sheets.class_label(F.col("equipment_type")).alias("label"))


@_register("""WITH l AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS pos, l_partkey, l_suppkey FROM lineitem),
p AS (SELECT page, l_suppkey AS prefix FROM l WHERE l_partkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY page ORDER BY pos, l_suppkey::VARCHAR) = 1)
SELECT l.page, CASE WHEN l_suppkey % 4 = 0 THEN 'PT' ELSE 'PT  x ' || l_partkey END AS tag, CASE WHEN l_suppkey % 4 <> 0 THEN prefix || '-PT-' || l_partkey END AS full_tag FROM l LEFT JOIN p USING (page)""")
def geo_full_tags(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey").distinct()
    spans = lines.select("page", "pos", F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("see "), "l_suppkey", F.lit("-PID"))).otherwise("note").alias("text"))
    tags = lines.select("page", F.when(F.col("l_suppkey") % 4 == 0, "PT").otherwise(F.concat(F.lit("PT  x "), "l_partkey")).alias("tag"))
    return sheets.full_tags(tags, spans, r"(\d+)-PID")


@_register("SELECT l_orderkey AS page, count(*) AS runs, count(*) FILTER (WHERE l_linestatus = 'F') AS directed, count(*) FILTER (WHERE l_returnflag = 'R') AS conflicts FROM lineitem GROUP BY ALL")
def geo_direction_stats(spark, sf_dir):
    runs = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linestatus") == "F").alias("directed"), (F.col("l_returnflag") == "R").alias("conflict"))
    return sheets.direction_stats(runs, "page")


@_register("""SELECT l_orderkey AS finding_id, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_retailprice < 1500)), '') AS cited FROM lineitem GROUP BY ALL""")
def ws_cited(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    findings = lines.groupBy(F.col("l_orderkey").alias("finding_id")).agg(ids.alias("evidence_ids"))
    evidence = s.table(spark, sf_dir, "part").where("p_retailprice < 1500").select(F.col("p_partkey").alias("evidence_id"))
    return sheets.cited_evidence(findings, evidence).select("finding_id", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"))
