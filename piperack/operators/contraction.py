"""From drawn piping to an equipment graph.

terminals(id, tag) are the drawn elements that stand for items; segments(a, b, lines, direction, source) join elements,
direction being 1 (from a to b), -1 or 0. From every terminal all walks go on through elements that are no terminals;
per walk an element is visited once, by the shortest way (ties: the smallest signature), which makes the result
independent of the order of rows. All starts advance together, a level a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.checkpoints import Grown, cut, stored
from piperack.functions.plant import type_of_tag


def terminals_of(model: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """terminals(id, tag) and nodes(tag, equipment_type, name, sheets) of a plant model's tables.

    ``model`` has Equipment(id, sheet, tagName, shape), Nozzle(id, equipment), PipingComponent(id, sheet,
    componentClass), ProcessInstrumentationFunction(id, sheet, tagName) and PipeOffPageConnector(id, sheet, labels).
    Elements of one tag are one node over all their sheets.
    """
    tagged = F.col("tagName").isNotNull() & (F.col("tagName") != "")
    equipment = model["Equipment"].select("id", F.when(tagged, F.col("tagName")).otherwise(F.concat(F.lit("EQ-"), "id")).alias("tag"), type_of_tag(F.coalesce("tagName", F.lit(""))).alias("equipment_type"), "sheet")
    kinds = F.when(F.col("componentClass") == "CheckValve", "check_valve").when(F.col("componentClass") == "SafetyValve", "relief_valve").otherwise("valve")
    valves = model["PipingComponent"].select("id", F.concat(F.lit("XV-"), "id").alias("tag"), kinds.alias("equipment_type"), "sheet")
    instruments = model["ProcessInstrumentationFunction"].select("id", F.when(tagged, F.col("tagName")).otherwise(F.concat(F.lit("I-"), "id")).alias("tag"), F.lit("instrument").alias("equipment_type"), "sheet")
    connectors = model["PipeOffPageConnector"].select("id", F.concat(F.lit("OPC-"), F.coalesce(F.try_element_at("labels", F.lit(1)), F.col("id"))).alias("tag"), F.lit("line").alias("equipment_type"), "sheet")
    elements = equipment.union(valves).union(instruments).union(connectors)
    nozzles = model["Nozzle"].select(F.col("id").alias("nozzle"), F.col("equipment").alias("id")).join(elements.select("id", "tag"), "id").select(F.col("nozzle").alias("id"), "tag")
    nodes = elements.groupBy("tag").agg(F.min("equipment_type").alias("equipment_type"), F.sort_array(F.collect_set("sheet")).alias("sheets"))
    return elements.select("id", "tag").union(nozzles), nodes


def _walk(start: Column, other: Column, lines: Column, sources: Column, forward: Column, backward: Column) -> Column:
    """A walk without its direction: a, b, lines, sources and how its votes lie between the smaller item and the larger one."""
    way = F.when(forward & backward, "branch").when(forward | backward, F.when(forward == (start < other), "ahead").otherwise("astern")).otherwise("none")
    return F.struct(F.least(start, other).alias("a"), F.greatest(start, other).alias("b"), lines.alias("lines"), sources.alias("sources"), way.alias("class"))


def walks(terminals: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b, lines, sources, class: for every terminal the walks to the terminals that they end at, by their items.

    Segments get the tags of both ends first: those between two terminals are walks already and are never shuffled again,
    levels are joined only for walks that go on through other elements."""
    empty = F.array().cast("array<string>")
    hops = segments.select("a", "b", F.coalesce("lines", empty).alias("lines"), F.coalesce("direction", F.lit(0)).cast("int").alias("direction"), "source")
    turn = F.col("a") > F.col("b")
    hops = hops.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "lines", F.when(turn, -F.col("direction")).otherwise(F.col("direction")).alias("direction"), "source")
    for end in ("a", "b"):
        hops = hops.join(terminals.select(F.col("id").alias(end), F.col("tag").alias(f"tag_{end}")), end, "left")
    voted = F.col("direction") != 0
    own = F.when(voted, F.array(F.coalesce("source", F.lit("")))).otherwise(empty)
    ahead = [F.array_sort(F.array_distinct("lines")).alias("lines"), own.alias("sources"), (F.col("direction") > 0).alias("forward"), (F.col("direction") < 0).alias("backward")]
    # in one aggregation, for which nothing is shuffled: of segments side by side between terminals the smallest signature either
    # way, others as they are
    between = F.col("tag_a").isNotNull() & F.col("tag_b").isNotNull() & (F.col("a") != F.col("b"))
    either = [F.struct("lines", "sources", "forward", "backward"), F.struct("lines", "sources", F.col("backward").alias("forward"), F.col("forward").alias("backward"))]
    hops = hops.select("a", "b", "tag_a", "tag_b", F.when(~between, F.struct("lines", "direction", "source")).alias("hop"), *ahead).groupBy("a", "b", "tag_a", "tag_b")
    every = stored(hops.agg(F.min(F.when(between, either[0])).alias("w"), F.min(F.when(between, either[1])).alias("back"), F.collect_set("hop").alias("hops")))
    direct = every.where("w is not null")
    rest = every.where("w is null and a <> b").select("a", "b", "tag_a", "tag_b", F.explode("hops").alias("h")).select("a", "b", "tag_a", "tag_b", "h.*")
    parts = lambda w: [F.col(f"{w}.{c}") for c in ("lines", "sources", "forward", "backward")]
    found = direct.where("tag_a <> tag_b").select(F.explode(F.array_distinct(F.array(_walk(F.col("tag_a"), F.col("tag_b"), *parts("w")), _walk(F.col("tag_b"), F.col("tag_a"), *parts("back"))))).alias("p")).select("p.*")
    ways = cut(rest.select(F.col("a").alias("at"), F.col("tag_a").alias("tag"), F.col("b").alias("to"), F.col("tag_b").alias("other"), "lines", "direction", "source").union(rest.select("b", "tag_b", "a", "tag_a", "lines", -F.col("direction"), "source")))
    inner = ways.where("tag is null").drop("tag")
    keys = ["start", "tag", "at"]
    least = lambda df: df.groupBy(*keys).agg(F.min(F.struct("lines", "sources", "forward", "backward")).alias("w")).select(*keys, "w.*")
    front = cut(least(ways.where("tag is not null").select(F.col("at").alias("start"), "tag", F.col("to").alias("at"), *ahead)))
    seen, later, level = Grown(front.select("start", "at")), None, 1
    while not front.isEmpty():
        level += 1
        step = front.withColumnRenamed("lines", "had").join(inner, "at").where("to <> start")
        step = cut(step.select(
            "start", "tag", F.col("to").alias("at"), "other",
            F.array_sort(F.array_union("had", "lines")).alias("lines"),
            F.when(voted, F.array_sort(F.array_union("sources", F.array(F.coalesce("source", F.lit("")))))).otherwise(F.col("sources")).alias("sources"),
            (F.col("forward") | (F.col("direction") > 0)).alias("forward"), (F.col("backward") | (F.col("direction") < 0)).alias("backward"),
        ))
        ended = step.where("other is not null").withColumn("level", F.lit(level))
        if later is None:
            later = Grown(ended)
        else:
            later.add(ended)
        front = cut(least(step.where("other is null").join(seen.whole, ["start", "at"], "left_anti")))
        seen.add(front.select("start", "at"))
    if later is None:
        return found
    # an element that segments lead to at once, or fewer of them, is met that way only
    near = direct.select(F.col("a").alias("start"), F.col("b").alias("at")).union(direct.select("b", "a"))
    fresh = later.whole.groupBy(*keys, "other").agg(F.min(F.struct("level", "lines", "sources", "forward", "backward")).alias("w")).join(near, ["start", "at"], "left_anti")
    return found.union(fresh.where("other <> tag").select(_walk(F.col("tag"), F.col("other"), *parts("w")).alias("p")).select("p.*"))


def contract(terminals: DataFrame, segments: DataFrame) -> DataFrame:
    """source, target, line_tag, line_numbers, direction, direction_sources, direction_note between items.

    Walks between two items pool by their votes: each one-way class gives a known edge in its direction; where there is
    none, all give one unknown edge, with a note if the votes of some walk turn round on the way.
    """
    pairs = walks(terminals, segments).repartition("a", "b").distinct()  # walks alike count once
    gathered = lambda c, when: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(when, F.col(c))))))
    is_class = lambda k: F.col("class") == k
    sums = pairs.groupBy("a", "b").agg(
        F.bool_or(is_class("ahead")).alias("ahead"), F.bool_or(is_class("astern")).alias("astern"), F.bool_or(is_class("branch")).alias("branch"),
        gathered("lines", is_class("ahead")).alias("la"), gathered("lines", is_class("astern")).alias("lb"), gathered("lines", is_class("none") | is_class("branch")).alias("l0"),
        gathered("sources", is_class("ahead")).alias("sa"), gathered("sources", is_class("astern")).alias("sb"),
    )
    none = F.array().cast("array<string>")

    def edge(when, source, target, lines, known, sources, note):
        lines = F.array_sort(lines)
        return F.when(when, F.struct(source.alias("source"), target.alias("target"), F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")).alias("line_tag"), lines.alias("line_numbers"), F.lit(known).alias("direction"), sources.alias("direction_sources"), note.alias("direction_note")))

    a, b = F.col("a"), F.col("b")
    no_note = F.lit(None).cast("string")
    note = F.when(F.col("branch"), "no through-flow direction")
    unknown = ~F.col("ahead") & ~F.col("astern")
    edges = F.array(
        edge(F.col("ahead"), a, b, F.array_union("la", "l0"), "known", F.col("sa"), no_note),
        edge(F.col("astern"), b, a, F.array_union("lb", "l0"), "known", F.col("sb"), no_note),
        edge(unknown, a, b, F.col("l0"), "unknown", none, note),
    )
    return sums.select(F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e")).select("e.*")
