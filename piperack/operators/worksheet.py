"""Worksheet operators: generated findings, grounding and evidence gates, safeguards, the critic and screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.functions.plant import content_words, deviation_matrix


def deviations(nodes: DataFrame) -> DataFrame:
    """node_id, parameter, guideword, ordinal for nodes(node_id, parameters), in the order of parameters and guidewords."""
    spread = nodes.select("node_id", F.posexplode("parameters").alias("at", "parameter"))
    return spread.join(F.broadcast(deviation_matrix(nodes.sparkSession)), "parameter").select("node_id", "parameter", "guideword", (F.col("at") * 100 + F.col("guideword_pos")).alias("ordinal"))


def confidence(supporting: Column) -> Column:
    """Confidence of a finding with so many citations that hold."""
    return F.round(F.least(F.lit(0.95), 0.4 + 0.15 * supporting), 3)


def stage_a(findings: DataFrame, known: DataFrame) -> DataFrame:
    """findings(finding_id, tags) with invalid_tags and grounded: any tag that isn't ``known`` (tag) rejects."""
    refs = findings.select("finding_id", F.explode(F.array_distinct("tags")).alias("tag"))
    invalid = refs.join(known.select("tag").distinct(), "tag", "left_anti").groupBy("finding_id").agg(F.sort_array(F.collect_set("tag")).alias("invalid_tags"))
    joined = findings.join(invalid, "finding_id", "left")
    return joined.select(*findings.columns, F.coalesce("invalid_tags", F.expr("cast(array() as array<string>)")).alias("invalid_tags"), F.col("invalid_tags").isNull().alias("grounded"))


def stage_b(citations: DataFrame) -> DataFrame:
    """outcome, kept, unchecked and confidence for citations(finding_id, verdict, confidence).

    A contradicted citation rejects the finding; others that aren't supported are stripped, and only then does the
    confidence fall to what the rest supports, or to 0.3 where nothing is left. A citation without a verdict is
    unchecked: it stays and supports nothing, and a finding of such citations alone is unchecked itself.
    """
    is_ = lambda v: F.sum(F.coalesce(F.col("verdict") == v, F.lit(False)).cast("int"))
    sums = citations.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("cited"),
        is_("supported").alias("kept"),
        F.sum(F.col("verdict").isNull().cast("int")).alias("unchecked"),
        (is_("contradicted") > 0).alias("bad"),
        F.max("confidence").alias("old"),
    )
    lost = F.col("kept") + F.col("unchecked") < F.col("cited")
    fallen = F.round(F.least("old", F.when(F.col("kept") > 0, 0.4 + 0.15 * F.col("kept")).otherwise(0.3)), 3)
    return sums.select(
        "finding_id",
        F.when(F.col("bad"), "rejected").when(F.col("unchecked") == F.col("cited"), "unchecked").when((F.col("kept") == 0) & lost, "unsupported inference").when(lost, "stripped").otherwise("released").alias("outcome"),
        F.when(F.col("bad"), 0).otherwise(F.col("kept")).alias("kept"),
        F.col("unchecked").cast("long").alias("unchecked"),
        F.when(F.col("bad"), F.lit(None)).when(lost, fallen).otherwise(F.col("old")).alias("confidence"),
    )


def lexical_verdict(claim: Column, evidence: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """The share of a claim's content words that the evidence has, and the verdict; an empty claim has none."""
    words = content_words(claim)
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, content_words(evidence))) / F.size(words)).otherwise(0.0)
    return share, F.when(share >= threshold, "supported").otherwise("insufficient")


def critic(rows: DataFrame) -> DataFrame:
    """Counts of what a reviewer must look at, for rows(group, n_causes, n_consequences, n_safeguards, confidence)."""
    none = lambda c: F.sum((F.coalesce(F.col(c), F.lit(0)) == 0).cast("int"))
    return rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("rows"),
        none("n_causes").alias("without_causes"),
        none("n_consequences").alias("without_consequences"),
        none("n_safeguards").alias("without_safeguards"),
        F.sum((F.coalesce("confidence", F.lit(0.0)) < 0.5).cast("int")).alias("low_confidence"),
        F.min(F.coalesce("confidence", F.lit(0.0))).alias("min_confidence"),
    )


def critic_report(rows: DataFrame, expected: DataFrame, low: float = 0.5) -> DataFrame:
    """The labels that a reviewer must look at, by kind and in their order: kind, group, labels, for rows(group, label,
    n_causes, n_consequences, n_safeguards, confidence) against expected(group, label). A kind without labels has no row."""
    lacks = {f"without {k}": F.coalesce(F.col(f"n_{k}"), F.lit(0)) == 0 for k in ("causes", "consequences", "safeguards")} | {"low confidence": F.coalesce("confidence", F.lit(0.0)) < low}
    kinds = F.filter(F.array(*[F.when(c, name) for name, c in lacks.items()]), lambda k: k.isNotNull())
    found = rows.select("group", "label", F.explode(kinds).alias("kind"))
    missing = expected.select("group", "label").distinct().join(rows.select("group", "label"), ["group", "label"], "left_anti").withColumn("kind", F.lit("missing"))
    return found.unionByName(missing).groupBy("kind", "group").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def screen(cases: DataFrame) -> DataFrame:
    """cases(case_id, equipment_type, deviation, conditions map) with rule, low and high estimates; null: unquantified."""
    value = lambda k: F.try_element_at("conditions", F.lit(k))
    at = lambda kinds, deviation: F.col("equipment_type").isin(*kinds) & (F.col("deviation") == deviation)
    rules = (
        (F.col("deviation") == "reverse_flow", "reverse_flow", F.lit(None), F.lit(None)),
        (at(("pump",), "blocked_outlet") & value("shutoff_pressure").isNotNull(), "pump_shutoff", value("shutoff_pressure"), value("shutoff_pressure")),
        (at(("pump",), "blocked_outlet"), "pump_deadhead", F.round(1.2 * value("normal_discharge_pressure"), 3), F.round(1.5 * value("normal_discharge_pressure"), 3)),
        (at(("compressor",), "blocked_outlet"), "compressor_relief", value("relief_set_pressure"), value("relief_set_pressure")),
        (at(("vessel", "tank"), "blocked_outlet"), "source_pressure", value("max_source_pressure"), value("max_source_pressure")),
        (at(("heat_exchanger",), "no_flow"), "heating_medium", value("heating_medium_temperature"), value("heating_medium_temperature")),
    )
    rule, low, high = F.lit("no rule"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for holds, name, a, b in reversed(rules):
        rule, low, high = F.when(holds, name).otherwise(rule), F.when(holds, a).otherwise(low), F.when(holds, b).otherwise(high)
    return cases.select("case_id", "equipment_type", "deviation", rule.alias("rule"), low.cast("double").alias("low"), high.cast("double").alias("high"))
