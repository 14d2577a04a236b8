"""Plant graph operators over two tables.

nodes(tag, equipment_type, ...) and edges(src, dst, verified). A query graph holds every edge in flow order and the
reverse of every unverified one, so that unverified flow can be walked both ways.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piperack.checkpoints import Grown, cut
from piperack.functions.plant import IN_LINE, ISOLATING, PASS_THROUGH, RELIEF_BLOCKING


def last_wins(edges: DataFrame, ordinal: str) -> DataFrame:
    """One edge for each ordered pair: that of the largest ``ordinal``."""
    rest = [c for c in edges.columns if c not in ("src", "dst", ordinal)]
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), ordinal).alias("e")).select("src", "dst", "e.*")


def any_verified(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair, verified if any of them is."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.bool_or("verified").alias("verified"))


def query_graph(edges: DataFrame) -> DataFrame:
    """Edges and, where an ordered pair has none, the reverse of its unverified opposite."""
    backward = edges.where("not verified").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "verified")
    return edges.select("src", "dst", "verified").unionByName(backward.join(edges, ["src", "dst"], "left_anti"))


def drawn_or_back(steps: DataFrame) -> DataFrame:
    """src, dst, verified, drawn: the rows of ``query_graph`` over ``any_verified`` of ``steps``, in one aggregation; drawn tells
    the edges from their reverses."""
    ahead = F.col("src") < F.col("dst")
    ends = steps.where("src <> dst").groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    ends = ends.agg(F.bool_or(ahead).alias("f"), F.bool_or(F.when(ahead, F.col("verified"))).alias("fv"), F.bool_or(~ahead).alias("b"), F.bool_or(F.when(~ahead, F.col("verified"))).alias("bv"))
    row = lambda when, src, dst, verified, drawn: F.when(when, F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), verified.alias("verified"), F.lit(drawn).alias("drawn")))
    one, other = F.col("f"), F.col("b")
    rows = [row(one, "lo", "hi", F.col("fv"), True), row(other, "hi", "lo", F.col("bv"), True), row(one & ~F.col("fv") & ~other, "hi", "lo", F.lit(False), False), row(other & ~F.col("bv") & ~one, "lo", "hi", F.lit(False), False)]
    return ends.select(F.explode(F.array(*rows)).alias("e")).where("e is not null").select("e.*")


#: Rows of a frontier that are broadcast at most; a larger one is joined by a shuffle.
FRONTIER = 50_000


def numbered_starts(starts: DataFrame, at_once: int = 2048) -> DataFrame:
    """start, word, bit: a place in a word of 64 bits for every distinct start, some 32 words to a task."""
    own = starts.select("start").distinct()
    buckets = max(1, -(-own.count() // at_once))
    bucket = F.pmod(F.xxhash64("start"), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("start")) - 1
    return own.withColumn("bucket", bucket).withColumn("place", place).select("start", (F.col("bucket") * (1 << 24) + F.floor(F.col("place") / 64)).alias("word"), F.expr("place % 64").alias("bit"))


def spread_bits(edges: DataFrame, front: DataFrame, on: list[str], stop: DataFrame | None = None) -> DataFrame:
    """word, ``on``, bits, sure for what the walks from ``front`` (word, ``on``, bits, sure) reach: which of a word's starts
    reach a node, and which by verified edges only.

    ``on`` names a node, last, and what else edges (``on`` but for src in place of node, dst, verified) are told by. The
    starts of a word share the levels. A level joins the new bits with the edges and drops those that are known: only
    known rows of the nodes just met are looked up. A frontier of a checked size is broadcast, so that neither the edges
    nor what is known is shuffled; a larger one is shuffled with them.
    """
    lanes, seen, first = on[:-1], None, True
    keys = ["word", *on]
    small = lambda df, n: F.broadcast(df) if n <= FRONTIER else df
    front = cut(front)
    size = front.count()
    while size:
        walked = front
        if not first and stop is not None:  # only the stops that the frontier stands at are matched with it
            walked = front.join(small(stop.join(small(front.select(*on).distinct(), size), on, "left_semi"), size), on, "left_anti")
        steps = edges.withColumnRenamed("src", on[-1])
        met = small(walked, size).join(steps, on).groupBy("word", *lanes, F.col("dst").alias(on[-1]))
        met = met.agg(F.bit_or("bits").alias("bits"), F.bit_or(F.when(F.col("verified"), F.col("sure")).otherwise(F.lit(0).cast("long"))).alias("sure"))
        if seen is not None:
            met = cut(met)
            size = met.count()
            had = seen.whole.join(small(met.select(*keys), size), keys, "left_semi").groupBy(*keys).agg(F.bit_or("bits").alias("had"), F.bit_or("sure").alias("had_sure"))
            fresh = lambda c: F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(F.col("had" if c == "bits" else "had_sure"), F.lit(0).cast("long"))))
            met = met.join(had, keys, "left").select(*keys, fresh("bits").alias("bits"), fresh("sure").alias("sure")).where("bits <> 0 or sure <> 0")
        front = cut(met)
        size, first = front.count(), False
        if seen is None:
            seen = Grown(front)
        elif size:
            seen.add(front)
    return front if seen is None else seen.whole.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.bit_or("sure").alias("sure"))


def _front(starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = cut(numbered_starts(starts))
    bit = F.expr("shiftleft(1L, bit)")
    return own, own.groupBy("word", F.col("start").alias("node")).agg(F.bit_or(bit).alias("bits"), F.bit_or(bit).alias("sure"))


def _unpacked(reached: DataFrame, own: DataFrame) -> DataFrame:
    """start and the columns of ``reached`` but for its words, verified for whether the start's bit is sure."""
    has = lambda c: F.expr(f"shiftright({c}, bit) & 1 = 1")
    return reached.join(own, "word").where(has("bits")).withColumn("verified", has("sure")).drop("word", "bit", "bits", "sure")


def closure(edges: DataFrame, starts: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """start, node for every node that the walks from ``starts`` (start) reach; a start is reached by a way back to it.

    ``stop`` (node) has nodes that are reached but not walked on from; a start is always walked on from.
    """
    own, front = _front(starts)
    return _unpacked(spread_bits(edges.select("src", "dst", F.lit(False).alias("verified")), front, ["node"], stop), own).select("start", "node")


def flagged_closure(edges: DataFrame, starts: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """start, node, verified: the closure over all edges and, flagged, the closure over verified ones, in one run of levels."""
    own, front = _front(starts)
    return _unpacked(spread_bits(edges.select("src", "dst", "verified"), front, ["node"], stop), own).select("start", "node", "verified")


def reach(graph: DataFrame, starts: DataFrame, forward: bool = True) -> DataFrame:
    """start, node, verified: nodes reached, the start left out; verified if a way of verified edges leads there."""
    steps = graph if forward else graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "verified")
    return flagged_closure(steps, starts).where("start <> node")


def _of_types(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return nodes.where(F.col("equipment_type").isin(*types)).select(F.col("tag").alias("node"))


def relief_paths(graph: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, verified: relief valves that flow reaches without passing what would block it."""
    blocked = _of_types(nodes, RELIEF_BLOCKING)
    return flagged_closure(graph, starts, blocked).where("start <> node").join(_of_types(nodes, ("relief_valve",)), "node", "left_semi").select("start", "node", "verified")


def relief_outcomes(graph: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """start, outcome, valves: "verified" or "drawn" where flow reaches a relief valve that nothing can block, "not
    credited" where it reaches valves past what can block it alone, and "none"; valves counts all that it reaches."""
    free = relief_paths(graph, nodes, starts).groupBy("start").agg(F.bool_or("verified").alias("sure"))
    below = closure(graph, starts).where("start <> node").join(_of_types(nodes, ("relief_valve",)), "node", "left_semi").groupBy("start").agg(F.count(F.lit(1)).alias("valves"))
    found = starts.select("start").distinct().join(free, "start", "left").join(below, "start", "left")
    outcome = F.when(F.col("sure"), "verified").when(F.col("sure").isNotNull(), "drawn").when(F.col("valves") > 0, "not credited").otherwise("none")
    return found.select("start", outcome.alias("outcome"), F.coalesce("valves", F.lit(0)).cast("long").alias("valves"))


def first_paths(paths: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` paths with fewest edges of each source and target, with their rank; ties in the order of their tags."""
    order = Window.partitionBy("source", "target").orderBy(F.size("path"), "path")
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def isolation_boundary(graph: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, side: the nearest isolating valves each way, over drawn flow, verified or not."""
    ends, both = _of_types(nodes, ISOLATING), ("downstream", "upstream")
    sides = lambda df: df.select(F.explode(F.array(*[F.lit(x) for x in both])).alias("side"), *df.columns)
    flat = F.lit(False).alias("verified")
    steps = graph.select(F.lit(both[0]).alias("side"), "src", "dst", flat).union(graph.select(F.lit(both[1]), F.col("dst"), F.col("src"), flat))  # one run walks both
    own, front = _front(starts)
    found = _unpacked(spread_bits(steps, sides(front), ["side", "node"], sides(ends)), own).join(ends, "node", "left_semi")
    return found.where("start <> node").select("start", "node", "side")


def simple_paths(graph: DataFrame, ends: DataFrame, cutoff: int | None = 12) -> DataFrame:
    """source, target, path, verified for every simple path of at most ``cutoff`` edges, or of any length where that is None,
    between ``ends`` (source, target).

    A path grows from the source for as long as the target is in reach of the edges left to it: the distances to the
    targets, walked backwards first, prune every other branch.
    """
    back = ends.select(F.col("target").alias("goal"), F.col("target").alias("node"), F.lit(0).alias("far")).distinct()
    front = cut(back)
    far = Grown(front)
    for k in count(1) if cutoff is None else range(1, cutoff):
        front = front.join(graph, front.node == graph.dst).select("goal", F.col("src").alias("node"), F.lit(k).alias("far")).distinct()
        front = cut(front.join(far.whole, ["goal", "node"], "left_anti"))
        if front.isEmpty():
            break
        far.add(front)
    near = far.whole
    steps = graph.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("verified").alias("sure"))
    grown = ends.where("source <> target").select("source", "target", F.col("source").alias("at"), F.array("source").alias("path"), F.lit(True).alias("verified"))
    done = None
    for k in count(1) if cutoff is None else range(1, cutoff + 1):
        grown = grown.join(steps, "at").where(~F.array_contains("path", F.col("to")))
        grown = grown.select("source", "target", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), (F.col("verified") & F.col("sure")).alias("verified"))
        grown = cut(grown.join(near.select(F.col("goal").alias("target"), F.col("node").alias("at"), "far"), ["target", "at"]).where(F.lit(True) if cutoff is None else F.col("far") <= cutoff - k).select("source", "target", "at", "path", "verified"))
        if done is None:
            done = Grown(grown.where("at = target"))
        elif grown.isEmpty():
            break
        else:
            done.add(grown.where("at = target"))
        grown = grown.where("at <> target")
    return done.whole.select("source", "target", "path", "verified")


def check_valves_between(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, node: the check valves on any of the paths."""
    on = paths.select("source", "target", F.explode("path").alias("node")).distinct()
    return on.join(_of_types(nodes, ("check_valve",)), "node", "left_semi").select("source", "target", "node")


def known_tags(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """tag, known for the distinct ``tags`` (tag)."""
    there = nodes.select("tag", F.lit(True).alias("there")).distinct()
    return tags.distinct().join(there, "tag", "left").select("tag", F.coalesce("there", F.lit(False)).alias("known"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges both of whose ends are ``members`` (tag)."""
    ends = lambda c: members.select(F.col("tag").alias(c))
    return edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select("src", "dst", "verified")


def neighbours(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, neighbour, relationship: a row for each edge of each of ``tags`` (tag)."""
    out = edges.select(F.col("src").alias("tag"), F.col("dst").alias("neighbour"), F.when(F.col("verified"), "FLOWS_TO (out)").otherwise("CONNECTED_TO (unknown)").alias("relationship"))
    into = edges.select(F.col("dst").alias("tag"), F.col("src").alias("neighbour"), F.when(F.col("verified"), "FLOWS_TO (in)").otherwise("CONNECTED_TO (unknown)").alias("relationship"))
    return out.union(into).join(tags, "tag", "left_semi")


def pass_through(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (id, src, dst, verified) with forced: directions carried over two-ended items.

    An in-line item with exactly two edges, one verified and one not, verifies the other; this goes on until nothing
    changes. Each round is one join along the items that a known edge has just reached.
    """
    inline = nodes.where(F.col("equipment_type").isin(*PASS_THROUGH)).select(F.col("tag").alias("item"))
    ends = edges.select("id", F.col("src").alias("item")).union(edges.select("id", "dst"))
    two = ends.join(inline, "item", "left_semi").groupBy("item").agg(F.min("id").alias("one"), F.max("id").alias("other"), F.count(F.lit(1)).alias("n")).where("n = 2 and one <> other")
    links = cut(two.select(F.col("one").alias("id"), F.col("other").alias("next")).union(two.select("other", "one")))
    front = cut(edges.where("verified").select("id"))
    known = Grown(front)
    while True:
        front = cut(front.join(links, "id").select(F.col("next").alias("id")).distinct().join(known.whole, "id", "left_anti"))
        if front.isEmpty():
            break
        known.add(front)
    flagged = edges.join(known.whole.withColumn("reached", F.lit(True)), "id", "left")
    return flagged.select(*edges.columns, (~F.col("verified") & F.col("reached").isNotNull()).alias("forced"))


def fold_chains(chains: DataFrame) -> DataFrame:
    """Connections between the items of ``chains`` (chain, pos, tag, equipment_type, verified), in-line items folded away.

    ``verified`` tells of the hop from an item to the next one. A connection goes from one item that isn't in line to
    the next such item, with the in-line tags between and the hops that are verified.
    """
    along = Window.partitionBy("chain").orderBy("pos")
    stop = ~F.col("equipment_type").isin(*IN_LINE)
    numbered = chains.withColumn("part", F.sum(F.when(stop, 1).otherwise(0)).over(along))
    parts = numbered.where("part > 0").groupBy("chain", "part").agg(
        F.max(F.when(stop, F.col("tag"))).alias("source"),
        F.sort_array(F.collect_list(F.when(~stop, F.struct("pos", "tag")))).alias("inline"),
        F.count(F.lit(1)).alias("hops"),
        F.sum(F.col("verified").cast("int")).alias("verified_hops"),
    )
    after = F.lead("source").over(Window.partitionBy("chain").orderBy("part"))
    return parts.withColumn("target", after).where("target is not null").select("chain", "part", "source", "target", F.array_join(F.transform("inline", lambda x: x["tag"]), ",").alias("via"), "hops", F.coalesce("verified_hops", F.lit(0)).alias("verified_hops"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node): labels spread along edges and are replaced by their own labels."""
    both = edges.select("src", "dst").where("src <> dst")
    both = cut(both.union(both.select("dst", "src")).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("d")).select("node", F.least("node", "d").alias("component")))
    while True:
        spread = both.join(labels, both.src == labels.node).select(F.col("dst").alias("node"), "component").union(labels)
        spread = cut(spread.groupBy("node").agg(F.min("component").alias("component")))
        roots = spread.select(F.col("node").alias("of"), F.col("component").alias("root"))
        jumped = cut(spread.join(roots, spread.component == roots.of).select("node", F.least("component", "root").alias("component")))
        changed = jumped.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was")
        if changed.isEmpty():
            return jumped
        labels = jumped


def describe(members: DataFrame, by: Column) -> DataFrame:
    """``by``, description such as "2 vessels + 1 pump", types in the order of their names."""
    counted = members.groupBy(by.alias("group"), "equipment_type").count()
    worded = F.concat_ws(" ", F.col("count").cast("string"), F.concat(F.regexp_replace("equipment_type", "_", " "), F.when(F.col("count") > 1, "s").otherwise("")))
    listed = counted.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("equipment_type", worded.alias("w")))).alias("parts"))
    return listed.select("group", F.array_join(F.transform("parts", lambda p: p["w"]), " + ").alias("description"))
