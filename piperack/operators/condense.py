"""Condensed views of study nodes: what members meet once in-line items are folded away, with roles, and as text.

Stretches of in-line items without a branch are ranked as chains first, in rounds that halve them; only then walks cross
the in-line items that do branch. So a level of the walk is a branching item, however many lie in between, and a
connection carries its in-line items in order and its verified hops either way. Every way counts, so a mesh of branching
in-line items, which plants don't have, makes as many connections as there are walks through it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piperack.checkpoints import Grown, cut, stored
from piperack.functions.plant import IN_LINE
from piperack.operators import graph
from piperack.operators.topology import collapsed_chains

_WALK = ["start", "here", "inline", "used", "via", "hops", "along", "against", "lines"]


@dataclass
class View:
    """items: node_id, tag, role, equipment_type, instruments. connections: node_id, source, target, via, direction,
    verified_hops, hops, lines."""

    items: DataFrame
    connections: DataFrame


def stretches(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """here, there, run, inner, hops, along, against, lines, at_inline, inline, ends: stretches between items that aren't in line or
    branch, either way; ``along`` counts the hops verified from here to there. Instruments are left out; at_inline and inline tell
    if ``here`` and ``there`` are in line, ends if nothing goes on from there. edges has src, dst, verified, lines.

    Only edges between two in-line items of two edges are ranked as chains; what leads out of these chains is put to their ends.
    """
    kinds = nodes.where(F.coalesce(F.col("equipment_type") != "instrument", F.lit(True))).groupBy("tag").agg(F.max(F.coalesce(F.col("equipment_type").isin(*IN_LINE), F.lit(False))).alias("inline"))
    kind = lambda end: kinds.select(F.col("tag").alias(end), F.col("inline").alias(f"{end}_inline"))
    pipes = edges.where("src <> dst").join(kind("src"), "src").join(kind("dst"), "dst")
    pipes = stored(pipes.select(F.monotonically_increasing_id().alias("id"), "src", "dst", F.coalesce("verified", F.lit(False)).alias("verified"), F.sort_array(F.array_distinct(F.coalesce("lines", F.array().cast("array<string>")))).alias("lines"), "src_inline", "dst_inline"))
    ends = F.filter(F.array(*[F.when(F.col(f"{end}_inline"), F.col(end)) for end in ("src", "dst")]), lambda e: e.isNotNull())
    turns = stored(pipes.select(F.explode(ends).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
    degree = lambda end: turns.select(F.col("tag").alias(end), F.col("n").alias(f"{end}_n"))
    none = F.lit(None).cast("long")
    plain = pipes.where("not src_inline and not dst_inline").select("*", none.alias("src_n"), none.alias("dst_n"))
    rest = stored(pipes.where("src_inline or dst_inline").join(degree("src"), "src", "left").join(degree("dst"), "dst", "left").select(*plain.columns))
    through = lambda end: F.coalesce(F.col(f"{end}_n") == 2, F.lit(False))
    inner, outer = rest.where(through("src") & through("dst")), rest.where(through("src") != through("dst"))
    # an end at an item that is passed: what lies beyond it, and if the flow is verified out to that or in from it
    sure = lambda end: F.col("verified") & through(end)
    pick = lambda c, end, other: F.when(through("src"), F.col(f"{other}{c}")).otherwise(F.col(f"{end}{c}"))
    side = F.struct(pick("", "src", "dst").alias("tag"), pick("_inline", "src", "dst").alias("inline"), (F.coalesce(pick("_n", "src", "dst"), F.lit(0)) == 1).alias("ends"), "id", sure("src").cast("long").alias("out"), sure("dst").cast("long").alias("in"), "lines")
    at = stored(outer.select(pick("", "dst", "src").alias("node"), side.alias("side")).groupBy("node").agg(F.collect_list("side").alias("sides")))
    lone = at.where("size(sides) = 2").select(F.get("sides", F.lit(0)).alias("x"), F.get("sides", F.lit(1)).alias("y"), F.array("node").alias("inner"), *[F.lit(0).cast("long").alias(c) for c in ("hops", "along", "against")], F.array().cast("array<string>").alias("lines"))
    # longer chains, whose ends have one side each; rings have none
    members = collapsed_chains(inner.select("id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("solid").alias("style"), F.lit(0.0).alias("length")), inner.select(F.col("src").alias("node")).where("false"))[1]
    hops = members.join(inner.select(F.col("id").alias("edge"), "src", "dst", "verified", "lines"), "edge", "left")
    way = lambda end: F.coalesce(F.sum((F.col("verified") & (F.col(end) == F.col("node"))).cast("long")), F.lit(0))
    told = hops.groupBy("run").agg(F.count("edge").alias("hops"), way("src").alias("along"), way("dst").alias("against"), F.flatten(F.collect_set("lines")).alias("lines"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("inner"))
    one = at.where("size(sides) = 1").select("node", F.get("sides", F.lit(0)).alias("side"))
    told = told.withColumns({"first": F.get("inner", F.lit(0)), "last": F.element_at("inner", -1)})
    long_ = told.join(one.select(F.col("node").alias("first"), F.col("side").alias("x")), "first").join(one.select(F.col("node").alias("last"), F.col("side").alias("y")), "last").select(*lone.columns)

    def link(x, y, inner, along, against):
        lines = F.sort_array(F.array_distinct(F.concat("x.lines", "lines", "y.lines")))
        return F.struct(x["tag"].alias("here"), y["tag"].alias("there"), F.col("x.id").alias("run"), inner.alias("inner"), (F.col("hops") + 2).alias("hops"), (along + x["in"] + y["out"]).alias("along"), (against + x["out"] + y["in"]).alias("against"), lines.alias("lines"), x["inline"].alias("at_inline"), y["inline"].alias("inline"), y["ends"].alias("ends"))

    x, y, along, against = map(F.col, ("x", "y", "along", "against"))
    folded = lone.union(long_).where("x.tag <> y.tag").select(F.inline(F.array(link(x, y, F.col("inner"), along, against), link(y, x, F.reverse("inner"), against, along))))
    direct = plain.union(rest.where(~through("src") & ~through("dst")))
    none = F.array().cast("array<string>").alias("inner")
    step = lambda a, b, along, against: F.struct(F.col(a).alias("here"), F.col(b).alias("there"), F.col("id").alias("run"), none, F.lit(1).cast("long").alias("hops"), along.cast("long").alias("along"), against.cast("long").alias("against"), "lines", F.col(f"{a}_inline").alias("at_inline"), F.col(f"{b}_inline").alias("inline"), (F.coalesce(f"{b}_n", F.lit(0)) == 1).alias("ends"))
    direct = direct.select(F.inline(F.array(step("src", "dst", F.col("verified"), F.lit(0)), step("dst", "src", F.lit(0), F.col("verified")))))
    return stored(direct.union(folded))


def connections(links: DataFrame, starts: DataFrame) -> DataFrame:
    """start, other, via, hops, along, against, lines for what each of ``starts`` (start) meets over ``links``: a walk crosses
    branching in-line items until an item that isn't in line, or one that nothing goes on from; no item twice."""
    steps = links.withColumnsRenamed({"hops": "more", "along": "more_along", "against": "more_against", "lines": "more_lines", "inline": "then_inline"})
    shown = lambda df: df.where("not inline or ends").select("start", F.col("here").alias("other"), "via", "hops", "along", "against", F.sort_array("lines").alias("lines"))
    # the first level is what the links themselves say
    first = links.where("here <> there").join(starts.select(F.col("start").alias("here")).distinct(), "here", "left_semi")
    first = first.select(F.col("here").alias("start"), F.col("there").alias("here"), "inline", "ends", F.array("run").alias("used"), F.col("inner").alias("via"), "hops", "along", "against", "lines")
    first = stored(first)
    done, steps = None, steps.where("at_inline")
    front = first.where("inline and not ends").select(*_WALK)
    few = front.count()
    while few:
        on = (F.broadcast(front) if few <= graph.FRONTIER else front).join(steps, "here").where("there <> start").where(~F.array_contains("used", F.col("run")) & ~F.array_contains("via", F.col("there")) & ~F.arrays_overlap("via", "inner"))
        on = on.select("start", F.col("there").alias("here"), F.col("then_inline").alias("inline"), "ends", F.concat("used", F.array("run")).alias("used"), F.concat("via", F.array("here"), "inner").alias("via"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("along") + F.col("more_along")).alias("along"), (F.col("against") + F.col("more_against")).alias("against"), F.array_union("lines", "more_lines").alias("lines"))
        on = stored(on)
        if done is None:
            done = Grown(shown(on), every=40)
        else:
            done.add(shown(on))
        front = on.where("inline and not ends").select(*_WALK)
        few = front.count()
    return shown(first) if done is None else shown(first).union(done.whole)


def view(members: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 1) -> View:
    """The view of every study node (node_id, tag): members, what they meet within ``hops`` connections, and the ways there.

    A connection whose hops are all verified one way is known and told in flow order; others are unknown and told from the
    smaller end. Lines and in-line items at which a way ends are the view's boundary, other items neighbours. Members
    that aren't in the plant are missing."""
    links = stretches(edges, nodes)
    types = nodes.select("tag", "equipment_type")
    own = cut(members.select("node_id", "tag").distinct())
    there = own.join(types, "tag", "left")
    items = [there.select("node_id", "tag", F.when(F.col("equipment_type").isNull(), "missing").otherwise("member").alias("role"))]
    front, ways = own, []
    seen = own
    for _ in range(hops):
        met = connections(links, front.select(F.col("tag").alias("start")))
        mine = front.join(met, front.tag == met.start).drop("tag")
        way = F.when(F.col("along") == F.col("hops"), 1).when(F.col("against") == F.col("hops"), -1).otherwise(0)
        swap = (way == -1) | (way == 0) & (F.col("other") < F.col("start"))
        ways.append(mine.select("node_id", F.when(swap, F.col("other")).otherwise(F.col("start")).alias("source"), F.when(swap, F.col("start")).otherwise(F.col("other")).alias("target"), F.when(swap, F.reverse("via")).otherwise(F.col("via")).alias("via"), F.when(way == 0, "unknown").otherwise("known").alias("direction"), (F.col("along") + F.col("against")).alias("verified_hops"), "hops", "lines"))
        found = mine.select("node_id", F.col("other").alias("tag")).distinct().join(seen, ["node_id", "tag"], "left_anti").join(types, "tag")
        found = cut(found.select("node_id", "tag", F.when(F.col("equipment_type").isin("line", *IN_LINE), "boundary").otherwise("neighbour").alias("role")))
        items.append(found)
        seen = seen.union(found.select("node_id", "tag"))
        front = found.where("role = 'neighbour'").select("node_id", "tag")
    every, told = items[0], ways[0]
    for x, y in zip(items[1:], [*ways[1:], None], strict=True):
        every, told = every.union(x), told if y is None else told.union(y)
    taps = edges.select("src", "dst").union(edges.select("dst", "src")).join(types.where("equipment_type = 'instrument'").select(F.col("tag").alias("dst")), "dst", "left_semi")
    taps = taps.groupBy(F.col("src").alias("tag")).agg(F.sort_array(F.collect_set("dst")).alias("instruments"))
    every = every.join(types, "tag", "left").join(taps, "tag", "left").select("node_id", "tag", "role", "equipment_type", F.coalesce("instruments", F.array().cast("array<string>")).alias("instruments"))
    # ways told from both of their ends are one; of ways alike but for the order of their items, the smaller
    once = told.groupBy("node_id", "source", "target", "direction", F.sort_array("via").alias("set")).agg(F.min(F.struct("via", "hops", "verified_hops", "lines")).alias("c"))
    return View(every, once.select("node_id", "source", "target", "c.via", "direction", "c.verified_hops", "c.hops", "c.lines"))


def text(shown: View, nodes: DataFrame) -> DataFrame:
    """node_id, text: each view as lines of text, items in the order of their roles and tags."""
    words = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    heads = {"member": "Items of the study node", "neighbour": "Items they meet", "boundary": "Where the view ends", "missing": "Not in the plant"}
    tapped = F.when(F.size("instruments") > 0, F.concat(F.lit(", measured by "), F.array_join("instruments", ", "))).otherwise("")
    line = F.concat(F.lit("- "), "tag", F.coalesce(F.concat(F.lit(", "), words(F.col("equipment_type"))), F.lit("")), tapped)
    parts = shown.items.groupBy("node_id", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tag", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    order = F.create_map(*[F.lit(x) for k, role in enumerate(heads) for x in (role, k)])
    titles = F.create_map(*[F.lit(x) for role, title in heads.items() for x in (role, title)])
    parts = parts.select("node_id", order[F.col("role")].alias("k"), F.concat(titles[F.col("role")], F.lit(":\n"), "lines").alias("part"))
    kinds = nodes.select(F.col("tag").alias("item"), words(F.col("equipment_type")).alias("kind"))
    placed = shown.connections.withColumn("way", F.xxhash64("source", "target", "direction", "via"))
    passed = placed.select("node_id", "way", F.posexplode("via").alias("pos", "item")).join(kinds, "item").groupBy("node_id", "way").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(" ", "kind", "item").alias("w")))), lambda x: x["w"]), ", ").alias("over"))
    known = F.col("direction") == "known"
    say = F.concat(
        F.lit("- "), "source", F.when(known, " -> ").otherwise(" -- "), "target", F.coalesce(F.concat(F.lit(" over "), "over"), F.lit("")),
        F.when(known, F.lit(" (flow verified")).otherwise(F.concat(F.lit(" (flow not verified, "), F.col("verified_hops").cast("string"), F.lit("/"), F.col("hops").cast("string"), F.lit(" hops"))),
        F.when(F.size("lines") > 0, F.concat(F.lit("; line "), F.array_join("lines", ", "))).otherwise(""), F.lit(")"),
    )
    ways = placed.join(passed, ["node_id", "way"], "left").groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_list(say)), "\n").alias("lines"))
    parts = parts.union(ways.select("node_id", F.lit(len(heads)), F.concat(F.lit("Connections, whose flow is only verified where it says so:\n"), "lines")))
    return parts.groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n").alias("text"))
