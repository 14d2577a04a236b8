"""Sinks: graph statements, JSON lines and nested worksheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """statement: idempotent MERGE text, one row for each node and edge; strings are written as JSON."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(c), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    items = nodes.select(F.concat(F.lit("MERGE (n:PlantItem {tag: "), quoted("tag"), F.lit("}) SET n.equipment_type = "), quoted("equipment_type")).alias("statement"))
    kind = F.when(F.col("verified"), "FLOWS_TO").otherwise("CONNECTED_TO")
    flows = edges.select(F.concat(F.lit("MATCH (a:PlantItem {tag: "), quoted("src"), F.lit("}), (b:PlantItem {tag: "), quoted("dst"), F.lit("}) MERGE (a)-[:"), kind, F.lit("]->(b)")).alias("statement"))
    return items.union(flows)


def intent_cypher(intents: DataFrame, hops: int = 12) -> DataFrame:
    """``intents`` (kind, tag, target, equipment_type, ...) with statement: the same question to a graph store that ``cypher``
    has filled; null for what is no question."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(c), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    item = lambda name, c: F.concat(F.lit(f"({name}:PlantItem {{tag: "), quoted(c), F.lit("})"))
    typed = F.coalesce(F.concat(F.lit(" WHERE found.equipment_type = "), quoted("equipment_type")), F.lit(""))
    found, all_found, start, kind = "(found:PlantItem)", F.lit(" RETURN DISTINCT found.tag, found.equipment_type"), item("start", "tag"), F.col("kind")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    statement = (
        F.when(kind == "downstream", say("MATCH ", start, f"-[:FLOWS_TO*1..{hops}]->{found}", typed, all_found))
        .when(kind == "upstream", say(f"MATCH {found}-[:FLOWS_TO*1..{hops}]->", start, typed, all_found))
        .when(kind == "neighbours", say("MATCH ", start, f"-[way:FLOWS_TO|CONNECTED_TO]-{found}", typed, " RETURN found.tag, type(way)"))
        .when(kind == "relief", say("MATCH way = ", start, f"-[:FLOWS_TO*1..{hops}]->{found} WHERE found.equipment_type = \"relief_valve\" RETURN way"))
        .when(kind == "path", say("MATCH way = ", start, f"-[:FLOWS_TO*1..{hops}]->", item("goal", "target"), " RETURN way ORDER BY length(way)"))
        .when(kind == "info", say("MATCH ", start, " RETURN start"))
        .when(kind == "list", say(f"MATCH {found}", typed, " RETURN found.tag, found.name ORDER BY found.tag"))
        .when(kind == "count", say(f"MATCH {found}", typed, " RETURN found.equipment_type, count(found)"))
    )
    return intents.withColumn("statement", statement)


def append_jsonl(events: DataFrame, path: str) -> None:
    """Events appended as JSON lines; each write adds files and rewrites none."""
    events.write.mode("append").json(path)


def worksheet_json(findings: DataFrame) -> DataFrame:
    """node_id, deviation, row (JSON) with the findings of each kind nested, for findings(node_id, deviation, kind, ordinal, text, confidence)."""
    listed = findings.groupBy("node_id", "deviation").agg(F.sort_array(F.collect_list(F.struct("kind", "ordinal", "text", "confidence"))).alias("findings"))
    return listed.select("node_id", "deviation", F.to_json(F.struct("node_id", "deviation", "findings")).alias("row"))


def audit_sheet_json(counters: DataFrame, sample: DataFrame, by: str) -> DataFrame:
    """``by``, row (JSON): the counters of each group with its sampled findings (sample_id, ...) nested, in the order of sample_id."""
    fields = [c for c in sample.columns if c != by]
    listed = sample.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("sample_id", *[c for c in fields if c != "sample_id"]))).alias("sample"))
    joined = counters.join(listed, by, "left")
    return joined.select(by, F.to_json(F.struct(by, F.struct(*[c for c in counters.columns if c != by]).alias("proxies"), F.coalesce("sample", F.array().cast(listed.schema["sample"].dataType)).alias("sample"))).alias("row"))
