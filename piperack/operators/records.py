"""Records beside the worksheet: tag references in texts, requirements, decisions on suggestions, tallies, and the chain
from a study node to its gated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piperack.checkpoints import cut, stored
from piperack.operators import worksheet
from piperack.operators.audit import rate

# Prefixes of standards, whose clauses look like tags; words that stand for no value; the states of a
# requirement; what a decision makes of a suggestion.
STANDARDS = ("IEC", "ISO", "ISA", "API", "ANSI", "OSHA", "NFPA", "CFR", "ASME", "IEEE", "EN", "DIN", "DN", "PN", "UL", "ATEX")
NO_VALUE = ("", "null", "none", "nil", "n/a", "na", "-")
STATUSES = ("done", "partial", "todo", "blocked", "out_of_scope")
PROVENANCE = {"accepted": "ai_generated_human_approved", "edited": "ai_generated_human_modified"}
# Fixed value: the shape of a tag, which results depend on; digits and edges are those of ASCII words, so that it reads alike
# in Java's and in DuckDB's expressions.
TAG = r"(?<![A-Za-z0-9_])[A-Z]{1,4}-[A-Z]{0,3}[0-9]{1,5}[A-Z]{0,2}(?![A-Za-z0-9_])"

#: Words that are broadcast: the commonest of all texts.
COMMON = 10_000


def tag_references(texts: DataFrame, known: DataFrame) -> DataFrame:
    """text_id, tags (sorted, distinct) for texts(text_id, text): what is shaped like a tag and cites no standard, and the
    ``known`` tags (tag; letters, digits and hyphens) that stand in the text between other characters.

    Each distinct word is read once: known tags are found by a join with the runs of its hyphened parts, so no text is held
    against every tag. The commonest words meet the texts as a broadcast, and only rarer ones are shuffled, with their text's id.
    """
    word = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"), F.lit(0)))).alias("word")
    words = texts.select("text_id", word)
    counted = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    parts = counted.select("word", F.split("word", "-").alias("p"))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.transform(F.sequence(F.lit(1), F.size("p") - i + 1), lambda n: F.array_join(F.slice("p", i, n), "-"))))
    runs = F.when(F.size("p") == 1, F.array("word")).otherwise(every)
    holds = stored(parts.select("word", F.explode(runs).alias("tag")).join(known.select("tag").distinct(), "tag").groupBy("word").agg(F.collect_set("tag").alias("tags")))
    common = cut(counted.orderBy(F.desc("n"), "word").limit(COMMON).select("word").join(holds, "word", "left").withColumn("common", F.lit(True)))
    met = words.join(F.broadcast(common), "word", "left").where("common is null or tags is not null")
    rare = met.where("common is null").select("text_id", "word").join(holds, "word").select("text_id", "tags")
    standards = lambda tag: F.substring_index(tag, "-", 1).isin(*STANDARDS)
    shaped = F.filter(F.regexp_extract_all("text", F.lit(TAG), F.lit(0)), lambda tag: ~standards(tag))
    found = texts.select("text_id", shaped.alias("tags"), F.lit(1).alias("row")).union(rare.union(met.where("common").select("text_id", "tags")).select("text_id", "tags", F.lit(0)))
    one = found.groupBy("text_id").agg(F.flatten(F.collect_list("tags")).alias("tags"), F.sum("row").cast("int").alias("rows"))
    # as many rows as texts of an id
    return one.select("text_id", F.array_sort(F.array_distinct("tags")).alias("tags"), F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("col")


def value_or_null(value: Column) -> Column:
    """``value`` without white space at its ends; null where it says that there is none."""
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(~F.lower(bare).isin(*NO_VALUE), bare)


def requirement_faults(requirements: DataFrame) -> DataFrame:
    """requirement_id, fault for requirements(requirement_id, status): an unknown status, or an id that occurs again."""
    counted = requirements.groupBy("requirement_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).alias("odd"))
    faults = F.filter(F.array(F.when(F.col("odd"), "status"), F.when(F.col("n") > 1, "repeated")), lambda f: f.isNotNull())
    return counted.select("requirement_id", F.explode(faults).alias("fault"))


def updated(requirements: DataFrame, changes: DataFrame) -> DataFrame:
    """``requirements`` (requirement_id, status, notes, ...) with what ``changes`` (requirement_id, status, notes) set;
    null changes nothing, and a change of an unknown id or to an unknown status is left out."""
    one = changes.where(F.col("status").isNull() | F.col("status").isin(*STATUSES)).select("requirement_id", F.col("status").alias("__status"), F.col("notes").alias("__notes"))
    both = requirements.join(one, "requirement_id", "left")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in ("status", "notes") else F.col(c) for c in requirements.columns])


def requirement_view(requirements: DataFrame, hits: DataFrame, most: int = 12) -> DataFrame:
    """requirement_id, section, status, cited, citations for hits(requirement_id, file, line): the first ``most`` as file:line."""
    ranked = hits.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("requirement_id").orderBy("file", "line"))).where(F.col("rank") <= most)
    place = F.concat_ws(":", F.col("file").cast("string"), F.col("line").cast("string"))
    listed = ranked.groupBy("requirement_id").agg(F.count(F.lit(1)).alias("cited"), F.array_sort(F.collect_list(F.struct("rank", place.alias("at")))).alias("c"))
    listed = listed.select("requirement_id", "cited", F.transform("c", lambda x: x["at"]).alias("citations"))
    return requirements.join(listed, "requirement_id", "left").select("requirement_id", "section", "status", F.coalesce("cited", F.lit(0)).cast("long").alias("cited"), F.coalesce("citations", F.expr("cast(array() as array<string>)")).alias("citations"))


def judged_events(events: DataFrame) -> DataFrame:
    """``events`` (action, user, edited_text) with fault, null for a good one, and the provenance that the decision gives."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    known = F.coalesce(F.col("action").isin("accepted", "edited", "rejected"), F.lit(False))
    fault = F.when(~known, "unknown action").when((F.col("action") == "edited") & blank("edited_text"), "edited without text").when(blank("user"), "no user")
    return events.withColumn("fault", fault).withColumn("provenance", F.when(fault.isNull(), F.element_at(F.create_map(*[F.lit(x) for kv in PROVENANCE.items() for x in kv]), F.col("action"))))


def hallucination(findings: DataFrame, by: str) -> DataFrame:
    """by, rejected, accepted, rate over findings(by, rejected boolean): what the grounding gate turned away; of nothing 0."""
    sums = findings.groupBy(by).agg(F.sum(F.col("rejected").cast("long")).alias("rejected"), F.sum((~F.col("rejected")).cast("long")).alias("accepted"))
    return sums.select(by, "rejected", "accepted", F.round(rate(F.col("rejected"), F.col("rejected") + F.col("accepted"), 0.0), 6).alias("rate"))


def worst(timings: DataFrame, by: str) -> DataFrame:
    """by, label, value: the slowest of timings(by, ordinal, label, value), the first of several."""
    found = timings.groupBy(by).agg(F.max(F.struct("value", (-F.col("ordinal")).alias("first"), "label")).alias("w"))
    return found.select(by, F.col("w.label").alias("label"), F.col("w.value").alias("value"))


def graph_overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, n: what a graph of nodes(tag) and edges(src, dst, verified) has, one row a counter."""
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("verified").cast("int")).alias("v"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    ends = edges.select(F.col("src").alias("tag")).union(edges.select("dst")).distinct()
    out = count(nodes, "nodes").union(count(edges, "edges")).union(count(edges.where("verified"), "verified"))
    out = out.union(count(edges.where("not verified"), "drawn")).union(count(pairs, "connections"))
    out = out.union(count(pairs.where("v > 0"), "directed connections")).union(count(pairs.where("v = 2 and a <> b"), "anti-parallel pairs"))
    out = out.union(count(edges.where("src = dst"), "loops")).union(count(nodes.join(ends, "tag", "left_anti"), "isolated"))
    return out.union(count(ends.join(nodes, "tag", "left_anti"), "unknown ends"))


def study_rows(nodes: DataFrame, evidence: DataFrame, findings: DataFrame, known: DataFrame, per_deviation: int = 5) -> DataFrame:
    """A worksheet row for each deviation of nodes(node_id, parameters), from generated findings to gated ones.

    evidence(parameter, guideword, evidence_id, score) is what the retriever finds for a deviation, the best
    ``per_deviation`` of which count. findings(finding_id, evidence_id, kind, tags, verdict) is what a generator says about it and
    how the critic judges the citation. A finding with a tag that isn't ``known`` is turned away; of the rest a
    contradicted one is, an insufficient one loses its citation and falls to 0.3, and the others keep their confidence.
    node_id, parameter, guideword, ordinal, causes, consequences, safeguards, rejected, confidence (the least) and
    missing (kinds without a finding).
    """
    order = F.row_number().over(Window.partitionBy("parameter", "guideword").orderBy(F.desc("score"), "evidence_id"))
    best = evidence.withColumn("rank", order).where(F.col("rank") <= per_deviation).select("parameter", "guideword", "evidence_id")
    gated = worksheet.stage_a(findings.select("finding_id", "tags"), known).select("finding_id", "grounded")
    judged = findings.join(gated, "finding_id").select("evidence_id", "kind", F.when(~F.col("grounded"), "tags").when(F.col("verdict") == "contradicted", "evidence").alias("turned"), F.when(F.col("verdict") == "supported", 0.55).otherwise(0.3).alias("confidence"))
    kept = F.col("turned").isNull()
    count = lambda kind: F.sum((kept & (F.col("kind") == kind)).cast("long"))
    found = best.join(judged, "evidence_id").groupBy("parameter", "guideword").agg(
        count("cause").alias("causes"),
        count("consequence").alias("consequences"),
        count("safeguard").alias("safeguards"),
        F.sum((~kept).cast("long")).alias("rejected"),
        F.min(F.when(kept, F.col("confidence"))).alias("confidence"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    kinds = ("causes", "consequences", "safeguards")
    rows = worksheet.deviations(nodes).join(found, ["parameter", "guideword"], "left").select("node_id", "parameter", "guideword", "ordinal", *map(zero, kinds), zero("rejected"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return rows.withColumn("missing", F.filter(F.array(*[F.when(F.col(c) == 0, c) for c in kinds]), lambda m: m.isNotNull()))
