"""Expressions over what a drawing sheet shows, and over the classes of what stands on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The area of a sheet that is drawn on, the title block that reaches into it, classes of valves and the
# types they stand for.
CONTENT, TITLE_BLOCK = (200, 200, 2200, 1450), (1795, 1295, 2350, 1470)
VALVE_CLASSES = {"gate": "GateValve", "ball": "BallValve", "check": "CheckValve", "safety": "SafetyValve", "angle": "AngleValve"}
TYPE_OF_CLASS = {"CheckValve": "check_valve", "SafetyValve": "relief_valve"}


def _looked_up(table: dict[str, str], key: Column, default: Column | str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default) if isinstance(default, str) else default)


def _inside(x: Column, y: Column, box: tuple[int, int, int, int]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def in_content(x: Column, y: Column) -> Column:
    """If a place is in the drawn area and not in the title block."""
    return _inside(x, y, CONTENT) & ~_inside(x, y, TITLE_BLOCK)


def axis(dx: Column, dy: Column) -> Column:
    """H or V for a direction within 15 degrees of an axis, else D."""
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
    return F.when((angle < 15) | (angle > 165), "H").when((angle > 75) & (angle < 105), "V").otherwise("D")


def valve_class(subclass: Column, ball: Column) -> Column:
    """The class of a valve by its subclass, else by its ball; a gate valve where nothing tells."""
    return _looked_up(VALVE_CLASSES, F.coalesce(subclass, F.lit("")), F.when(F.coalesce(ball, F.lit(False)), "BallValve").otherwise("GateValve"))


def type_of_class(valve: Column) -> Column:
    return _looked_up(TYPE_OF_CLASS, F.coalesce(valve, F.lit("")), "valve")


def instrument_class(tag: Column) -> Column:
    """Safety valves by the letters of the tag, all else a function."""
    return F.when(F.coalesce(F.ltrim(tag), F.lit("")).startswith("PSV"), "SafetyValveOrFitting").otherwise("ProcessInstrumentationFunction")


def class_label(equipment_type: Column) -> Column:
    """heat_exchanger as HeatExchanger."""
    return F.array_join(F.transform(F.split(equipment_type, "_"), F.initcap), "")


def page_numbers(spec: str | None, pages: int) -> list[int]:
    """The pages that "all" or "4-12, 15" means of so many, in order and each once; a range that runs backwards has none."""
    if not (spec or "").strip() or spec.strip().lower() == "all":
        return list(range(1, pages + 1))
    ends = [[int(n) for n in part.split("-", 1)] for part in spec.replace(" ", "").split(",") if part]
    return sorted({n for e in ends for n in range(max(1, e[0]), min(pages, e[-1]) + 1)})


def full_tags(tags: DataFrame, spans: DataFrame, pattern: str) -> DataFrame:
    """page, tag, full_tag for tags(page, tag) and spans(page, pos, text): the prefix that the first span with ``pattern``
    (one group) shows on the page, and the first and last word of the tag; null without a prefix or for a single word."""
    found = spans.withColumn("prefix", F.regexp_extract("text", pattern, 1)).where("prefix <> ''")
    prefix = found.groupBy("page").agg(F.min(F.struct("pos", "prefix")).alias("p")).select("page", "p.prefix")
    words = F.filter(F.split("tag", r"\s+"), lambda w: w != "")
    whole = F.concat("prefix", F.lit("-"), F.element_at(words, 1), F.lit("-"), F.element_at(words, -1))
    return tags.join(prefix, "page", "left").select("page", "tag", F.when(F.size(words) > 1, whole).alias("full_tag"))


def direction_stats(runs: DataFrame, by: str) -> DataFrame:
    """by, runs, directed, conflicts over runs(by, directed, conflict)."""
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), count("directed").alias("directed"), count("conflict").alias("conflicts"))


def cited_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_id, cited: the ids of findings(finding_id, evidence_ids) that are in ``evidence`` (evidence_id), in their order."""
    spread = findings.select("finding_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    known = spread.join(evidence.select("evidence_id").distinct(), "evidence_id").groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))).alias("c"))
    return findings.select("finding_id").join(known, "finding_id", "left").select("finding_id", F.coalesce(F.transform("c", lambda x: x["evidence_id"]), F.array()).alias("cited"))
