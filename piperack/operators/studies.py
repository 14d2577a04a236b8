"""Study nodes over an equipment graph: proposal by shared flow, their boundaries, and edits that return new proposals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piperack.functions.plant import IN_LINE
from piperack.operators.graph import Grown, components, cut

# Items that join what they connect to into one node, and what the edge of a node is called by the item beyond it.
JOINING = ("vessel", "tank", "column", "heat_exchanger")
BOUNDARY = {"line": "unit boundary", "compressor": "pressure break", "pump": "pressure break", "heat_exchanger": "phase change"}


def propose(edges: DataFrame, nodes: DataFrame, prefix: str = "PN") -> DataFrame:
    """node_id, tag: items of the joining types that verified flow connects are one study node; ids rank the smallest tags."""
    members = nodes.where(F.col("equipment_type").isin(*JOINING)).select("tag")
    inner = edges.where("verified").join(members.withColumnRenamed("tag", "src"), "src", "left_semi").join(members.withColumnRenamed("tag", "dst"), "dst", "left_semi")
    found = components(inner)
    grouped = members.join(found.withColumnRenamed("node", "tag"), "tag", "left").select("tag", F.coalesce("component", "tag").alias("first"))
    return grouped.select(F.concat_ws("-", F.lit(prefix), "first").alias("node_id"), "tag")


def folded_neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """tag, other, flow: the items that an item meets once in-line ones are folded away, and instruments left out.

    flow is "out" where every hop of some way between them is verified away from ``tag``, "in" where it is towards it,
    "both" where there is one of each, else "unknown". Every way counts, so nothing hangs on the order of edges (src,
    dst, verified). Each level of the walk is one join on what the last one reached.
    """
    kinds = nodes.select("tag", F.col("equipment_type").isin(*IN_LINE).alias("inline")).where(F.col("equipment_type") != "instrument")
    away = edges.select("src", "dst", F.col("verified").alias("out"), F.lit(False).alias("back"))
    hops = away.union(edges.select("dst", "src", F.lit(False), "verified")).where("src <> dst")
    hops = hops.join(kinds.select(F.col("tag").alias("dst"), "inline"), "dst").groupBy("src", "dst", "inline", "out", "back").count().drop("count")
    hops = cut(hops.select(F.col("src").alias("here"), F.col("dst").alias("next"), "inline", F.col("out").alias("o"), F.col("back").alias("b")))
    state = ["start", "here", "inline", "out", "back"]
    front = cut(kinds.where("not inline").select(F.col("tag").alias("here")).join(hops, "here").select(F.col("here").alias("start"), F.col("next").alias("here"), "inline", F.col("o").alias("out"), F.col("b").alias("back")).distinct())
    known = Grown(front)
    while True:
        on = front.where("inline").drop("inline").join(hops, "here").where("next <> start")
        front = cut(on.select("start", F.col("next").alias("here"), "inline", (F.col("out") & F.col("o")).alias("out"), (F.col("back") & F.col("b")).alias("back")).distinct().join(known.whole, state, "left_anti"))
        if front.isEmpty():
            break
        known.add(front)
    ways = known.whole.where("not inline and here <> start").groupBy(F.col("start").alias("tag"), F.col("here").alias("other")).agg(F.bool_or("out").alias("o"), F.bool_or("back").alias("b"))
    flow = F.when(F.col("o") & F.col("b"), "both").when(F.col("o"), "out").when(F.col("b"), "in").otherwise("unknown")
    return ways.select("tag", "other", flow.alias("flow"))


def propose_by_rules(neighbours: DataFrame, nodes: DataFrame, prefix: str = "PN", by_plant: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node_id, tag, placed over folded ``neighbours``: items that share a design intent are one study node.

    Grouping items (neither lines, nor in line, nor instruments, nor breaks) that meet are one node; breaks that feed
    each other both ways are a train and stay together; a train, or a break alone, joins the section whose verified
    flow feeds it, and what it feeds may then join that. In each round every train takes its smallest member that is
    fed, and of that the smallest feeder. placed is "grouped", "attached", "ambiguous" (fed by several sections) or
    "standalone". Items without neighbours have no node. Ids are told by the smallest tag.
    ``by_plant`` finds the components of edges (plant, src, dst) where neighbours have a plant.
    """
    kinds = nodes.where(~F.col("equipment_type").isin(*IN_LINE, "instrument", "line")).select("tag", F.col("equipment_type").isin(*[t for t in BOUNDARY if t != "line"]).alias("breaks"))
    active = cut(kinds.join(neighbours.select("tag").distinct(), "tag", "left_semi"))
    met = neighbours.join(active, "tag").join(active.select(F.col("tag").alias("other"), F.col("breaks").alias("other_breaks")), "other")
    joined = met.where("(not breaks and not other_breaks) or (breaks and other_breaks and flow = 'both')").withColumnsRenamed({"tag": "src", "other": "dst"})
    labels = (by_plant or components)(joined).withColumnRenamed("node", "tag")
    state = active.join(labels, "tag", "left").select("tag", "breaks", F.coalesce("component", "tag").alias("train"))
    section = state.groupBy("train").agg(F.bool_or(~F.col("breaks")).alias("grouped"))
    state = cut(state.join(section, "train"))
    front = state.where("grouped").select("tag", F.col("train").alias("section"), F.lit("grouped").alias("placed"))
    waiting = state.where("not grouped").select("tag", "train")
    feeds = cut(met.where("breaks and flow = 'in'").select("tag", "other").join(waiting, "tag"))
    done = Grown(front)
    while True:
        # what was placed before the last round feeds no train that still waits
        offers = feeds.join(front.select(F.col("tag").alias("other"), F.col("section").alias("feeder")), "other")
        each = offers.groupBy("train", "tag").agg(F.min(F.struct("other", "feeder")).alias("o"), (F.min("feeder") < F.max("feeder")).alias("several"))
        taken = cut(each.groupBy("train").agg(F.min(F.struct("tag", F.col("o.feeder").alias("feeder"), "several")).alias("t")).select("train", "t.feeder", "t.several"))
        if taken.isEmpty():
            break
        front = cut(waiting.join(taken, "train").select("tag", F.col("feeder").alias("section"), F.when(F.col("several"), "ambiguous").otherwise("attached").alias("placed")))
        done.add(front)
        waiting, feeds = cut(waiting.join(taken, "train", "left_anti")), cut(feeds.join(taken, "train", "left_anti"))
    named = done.whole.union(waiting.select("tag", "train", F.lit("standalone")))
    first = named.groupBy("section").agg(F.min("tag").alias("first"))
    return named.join(first, "section").select(F.concat_ws("-", F.lit(prefix), "first").alias("node_id"), "tag", "placed")


def folded_boundaries(members: DataFrame, neighbours: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, at_member, tag, kind, flow: what each member of a study node meets beyond it, and how it flows there."""
    beyond = members.select("node_id", F.col("tag").alias("at_member")).join(neighbours.withColumnRenamed("tag", "at_member"), "at_member").withColumnRenamed("other", "tag")
    beyond = beyond.join(members.select("node_id", "tag"), ["node_id", "tag"], "left_anti")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BOUNDARY.items() for x in kv]), F.col("equipment_type")), F.lit("adjacent section"))
    return beyond.join(nodes, "tag").select("node_id", "at_member", "tag", kind.alias("kind"), "flow")


def boundaries(members: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, tag, kind: the items beyond each study node's members (node_id, tag) and what kind of boundary they make."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    out = members.join(both, F.col("tag") == F.col("src")).select("node_id", F.col("dst").alias("tag")).distinct().join(members, ["node_id", "tag"], "left_anti")
    kind = F.lit("adjacent section")
    for etype, name in BOUNDARY.items():
        kind = F.when(F.col("equipment_type") == etype, name).otherwise(kind)
    return out.join(nodes, "tag").select("node_id", "tag", kind.alias("kind"))


def merge(members: DataFrame, ids: list[str]) -> DataFrame:
    """The proposal with the nodes ``ids`` as one, named by the smallest of them."""
    if len(set(ids)) < 2:
        raise ValueError("two nodes at least are merged")
    return members.select(F.when(F.col("node_id").isin(*ids), min(ids)).otherwise(F.col("node_id")).alias("node_id"), "tag")


def move(members: DataFrame, tag: str, to: str) -> DataFrame:
    """The proposal with ``tag`` in the node ``to``; a node that loses its last member goes."""
    return members.select(F.when(F.col("tag") == tag, to).otherwise(F.col("node_id")).alias("node_id"), "tag")


def condensed(members: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, members, described, inner_edges, neighbours: a study node in one row, small enough for a prompt."""
    typed = members.join(nodes, "tag")
    counted = typed.groupBy("node_id", "equipment_type").agg(F.count(F.lit(1)).alias("n"))
    described = counted.groupBy("node_id").agg(F.sum("n").alias("members"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("equipment_type", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["equipment_type"])), " + ").alias("described"))
    a, b = members.select("node_id", F.col("tag").alias("src")), members.select(F.col("node_id").alias("other"), F.col("tag").alias("dst"))
    inner = edges.join(a, "src").join(b, "dst").where("node_id = other").groupBy("node_id").agg(F.count(F.lit(1)).alias("inner_edges"))
    beyond = boundaries(members, edges, nodes).groupBy("node_id").agg(F.count_distinct("tag").alias("neighbours"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return described.join(inner, "node_id", "left").join(beyond, "node_id", "left").select("node_id", "members", "described", zero("inner_edges"), zero("neighbours"))
