"""Sequential choices made in parallel rounds: greedy leaders, greedy matching, and the ranking of chains.

Each gives what a loop in a stated order would give, without an order of rows: a round settles everything that nothing
unsettled can still change, and is cut by a checkpoint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.checkpoints import Grown, cut

#: Cells around a cell whose points may be in reach, where a cell's diagonal is the reach.
_AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]


def _around(df: DataFrame) -> DataFrame:
    """A row for each cell around a row's own, as nx, ny."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND])
    return df.select("*", F.explode(offsets).alias("o")).select("*", (F.col("cx") + F.col("o.i")).alias("nx"), (F.col("cy") + F.col("o.j")).alias("ny")).drop("o")


def leaders(points: DataFrame, distance: float, order: list[Column], strict: bool = False) -> DataFrame:
    """page, id, leader for points(page, id, x, y, ...): taken in ``order``, then by id, a point leads unless an earlier
    leader of its page is within ``distance`` (nearer than that if ``strict``); it goes with the earliest such leader.

    The points of a cell are all in reach of each other, so a cell has one leader at most. A round makes leaders of the
    points that come first in their cell and before the firsts of all cells in reach, then drops what these reach. Rows
    of a round's joins are some twenty for each point, however many points stand close together. Points alike in place
    are one point but for their ids; points without a place lead themselves.
    """
    rank = F.struct(*order, F.col("id"))
    placed = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    at = _in_cells(cut(placed.groupBy("page", "x", "y").agg(F.min(rank).alias("rank"))), distance)
    every = _around(chosen_leaders(at, distance, strict)).drop("cx", "cy").withColumnsRenamed({"nx": "cx", "ny": "cy"})
    led = at.join(every, ["page", "cx", "cy"]).where(_near(distance, strict)).groupBy("page", "x", "y").agg(F.min("leader").alias("leader"))
    own = placed.join(led, ["page", "x", "y"]).select("page", "id", F.col("leader.id").alias("leader"))
    return own.union(points.select("page", "id", "x", "y").where("x is null or y is null or isnan(x) or isnan(y)").select("page", "id", F.col("id").alias("leader")))


def _in_cells(df: DataFrame, distance: float) -> DataFrame:
    """``df`` (x, y, ...) with the cell of each row, as cx, cy; its diagonal is ``distance``."""
    side = distance / math.sqrt(2)
    return df.withColumns({"cx": F.floor(F.col("x") / side).cast("long"), "cy": F.floor(F.col("y") / side).cast("long")})


def _near(distance: float, strict: bool) -> Column:
    reach = F.sqrt((F.col("x") - F.col("lx")) ** 2 + (F.col("y") - F.col("ly")) ** 2)
    return reach < distance if strict else reach <= distance


def chosen_leaders(at: DataFrame, distance: float, strict: bool) -> DataFrame:
    """page, cx, cy, leader, lx, ly: the leaders among ``at`` (page, x, y, rank, cx, cy), in the order of their ranks."""
    left, chosen = at, None
    while True:
        firsts = left.groupBy("page", "cx", "cy").agg(F.min(F.struct("rank", "x", "y")).alias("f"))
        best = _around(firsts).groupBy("page", F.col("nx").alias("cx"), F.col("ny").alias("cy")).agg(F.min("f.rank").alias("best"))
        found = cut(firsts.join(best, ["page", "cx", "cy"]).where("f.rank <= best").select("page", "cx", "cy", F.col("f.rank").alias("leader"), F.col("f.x").alias("lx"), F.col("f.y").alias("ly")))
        if chosen is None:
            chosen = Grown(found)
        elif found.isEmpty():
            return chosen.whole
        else:
            chosen.add(found)
        new = _around(found).drop("cx", "cy").withColumnsRenamed({"nx": "cx", "ny": "cy"})
        taken = left.join(new, ["page", "cx", "cy"]).where(_near(distance, strict)).select("page", "x", "y").distinct()
        left = cut(left.join(taken, ["page", "x", "y"], "left_anti"))


#: Cells with leaders around that are broadcast at most; more are joined by a shuffle.
CELLS = 100_000


def _leaders_by_cell(chosen: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """page, cx, cy, around: the leaders that may be in reach of a cell's points, some twenty at most, earliest first."""
    few = F.lit(True) if among is None else F.col("few")
    named = chosen if among is None else chosen.join(among.select("page", F.struct(F.col("leader").alias("id")).alias("leader"), F.lit(True).alias("few")), ["page", "leader"], "left")
    cells = _around(named).groupBy("page", F.col("nx").alias("cx"), F.col("ny").alias("cy")).agg(F.sort_array(F.collect_list(F.struct("leader", "lx", "ly"))).alias("around"), F.bool_or(few).alias("few"))
    cells = cut(cells.where("few").drop("few"))
    return F.broadcast(cells) if cells.count() <= CELLS else cells


def leaders_in_blocks(blocks: list[DataFrame], distance: float, strict: bool) -> DataFrame:
    """page, cx, cy, leader, lx, ly: the leaders of points (page, id, x, y) that come in ``blocks``, all of a block before those
    of the next, and by id within it.

    Only points out of reach of the leaders of earlier blocks are kept, the others are read once and never shuffled or
    stored; so blocks that grow are as good as one, but for the room they take.
    """
    chosen = None
    for block in blocks:
        at = _in_cells(block.select("page", "x", "y", F.struct("id").alias("rank")), distance)
        if chosen is not None:
            at = at.join(_leaders_by_cell(chosen), ["page", "cx", "cy"], "left").where(~F.coalesce(F.exists("around", _reached(distance, strict)), F.lit(False))).drop("around")
        found = chosen_leaders(_in_cells(cut(at.groupBy("page", "x", "y").agg(F.min("rank").alias("rank"))), distance), distance, strict)
        chosen = found if chosen is None else cut(chosen.union(found))
    return chosen


def _reached(distance: float, strict: bool):
    def reached(l):  # noqa: E741
        d = F.sqrt((F.col("x") - l["lx"]) ** 2 + (F.col("y") - l["ly"]) ** 2)
        return d < distance if strict else d <= distance

    return reached


def with_leader(points: DataFrame, chosen: DataFrame, distance: float, strict: bool, among: DataFrame | None = None) -> DataFrame:
    """``points`` (page, id, x, y, ...) with the earliest leader in reach of each, as leader; ``chosen`` has all of them.
    Given ``among`` (page, leader), points in cells that none of these is near are left out."""
    cells = _leaders_by_cell(chosen) if among is None else _leaders_by_cell(chosen, among)
    led = _in_cells(points, distance).join(cells, ["page", "cx", "cy"])
    return led.withColumn("leader", F.try_element_at(F.filter("around", _reached(distance, strict)), F.lit(1))["leader"]["id"]).drop("cx", "cy", "around")


def greedy_matching(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """Of ``pairs`` (a, b, ...) those that are taken one by one in ``order``, then by a and b, unless an end is taken.

    A round takes the pairs that come first at both their ends, and drops the others there. a and b name one kind of
    thing; repeated pairs count once, as the first in order.
    """
    rank = F.struct(*order, F.col("a"), F.col("b"))
    left = cut(pairs.where("a <> b").withColumn("_rank", rank))
    taken = None
    while True:
        ends = left.select(F.explode(F.array("a", "b")).alias("end"), "_rank").groupBy("end").agg(F.min("_rank").alias("best"))
        first = left.join(ends.select(F.col("end").alias("a"), F.col("best").alias("_at_a")), "a").join(ends.select(F.col("end").alias("b"), F.col("best").alias("_at_b")), "b")
        found = cut(first.where("_rank = _at_a and _rank = _at_b").drop("_at_a", "_at_b").dropDuplicates(["a", "b"]))
        if taken is None:
            taken = Grown(found)
        elif found.isEmpty():
            return taken.whole.select(*pairs.columns)
        else:
            taken.add(found)
        used = found.select(F.explode(F.array("a", "b")).alias("used"))
        left = cut(left.join(used, left.a == used.used, "left_anti").join(used, left.b == used.used, "left_anti"))


def chain_darts(edges: DataFrame, through: DataFrame) -> DataFrame:
    """dart, edge, src, dst, next: either way along each of ``edges`` (id, a, b) and the dart that goes on from its end.

    ``through`` (node) has nodes of exactly two edge ends; elsewhere chains end and next is null. A dart is twice its
    edge's id, and one more for the way from b to a.
    """
    both = edges.select((F.col("id") * 2).alias("dart"), F.col("id").alias("edge"), F.col("a").alias("src"), F.col("b").alias("dst"))
    both = cut(both.union(edges.select((F.col("id") * 2 + 1), "id", "b", "a")))
    leaving = both.join(through.select(F.col("node").alias("src")), "src", "left_semi").groupBy("src").agg(F.min("dart").alias("one"), F.max("dart").alias("other"))
    back = F.col("dart").bitwiseXOR(F.lit(1))
    on = both.join(leaving.withColumnRenamed("src", "at"), F.col("dst") == F.col("at"), "left")
    return on.select("dart", "edge", "src", "dst", F.when(F.col("one") == back, F.col("other")).otherwise(F.col("one")).alias("next"))


def ranked_chains(darts: DataFrame) -> tuple[DataFrame, int]:
    """dart, last, left, ring of ``darts`` (dart, next), and the rounds taken: the last dart of its chain and the darts up
    to it; in a ring, last is the ring's smallest dart, ring is true and left counts the darts before that comes.

    Pointers double: a round joins each unsettled dart with the dart its pointer names, so a chain of n darts takes
    log n rounds.
    """
    state = darts.select("dart", F.col("next").alias("to"), F.when(F.col("next").isNull(), F.col("dart")).alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left"), F.col("dart").alias("least"), F.lit(0).cast("long").alias("steps"))
    state, rounds = cut(state), 0
    while True:
        open_ = state.where("to is not null")
        named = state.select(F.col("dart").alias("to"), F.col("to").alias("_to"), F.col("last").alias("_last"), F.col("left").alias("_left"), F.col("least").alias("_least"), F.col("steps").alias("_steps"))
        met = cut(open_.join(named, "to"))
        if met.where("_last is not null or least <> _least").isEmpty():
            break
        rounds += 1
        # the smallest dart of the stretch walked so far, and how far ahead it is
        nearer = F.col("least") <= F.col("_least")
        moved = met.select("dart", F.col("_to").alias("to"), F.col("_last").alias("last"), (F.col("left") + F.col("_left")).alias("left"), F.least("least", "_least").alias("least"), F.when(nearer, F.col("steps")).otherwise(F.col("left") + F.col("_steps")).alias("steps"))
        state = cut(state.where("to is null").union(moved))
    ring = F.col("to").isNotNull()
    return state.select("dart", F.when(ring, F.col("least")).otherwise(F.col("last")).alias("last"), F.when(ring, F.col("steps")).otherwise(F.col("left")).alias("left"), ring.alias("ring")), rounds


def collapsed_chains(edges: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and their members of ``edges`` (id, a, b, style, length): chains through nodes that aren't ``anchors`` (node)
    and have two edge ends, whose styles but for bridges are alike, become one run each.

    runs: run, a, b, style, edges, length, ring; a run goes from its smaller end, from the end of the smaller edge where
    both are one node, and a ring from its smallest node; its style is that of its first edge that is no bridge, "solid"
    without one. members: run, pos, edge, node, the nodes in order, so that a run of any length is never one row.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "style")
    solid = F.when(F.col("style") != "bridge", F.col("style"))
    through = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(solid).alias("x"), F.max(solid).alias("y")).where("n = 2 and (x is null or x = y)").select("node")
    darts = cut(chain_darts(edges, through.join(anchors.select("node").distinct(), "node", "left_anti")))
    ranked, _ = ranked_chains(darts)
    ranked = ranked.withColumn("back", F.col("dart").bitwiseXOR(F.lit(1)))
    placed = cut(darts.join(ranked, "dart"))
    # chains: both ways end somewhere; the way that starts at the smaller end is the run's
    back = placed.where("not ring").select(F.col("dart").alias("back"), F.col("last").alias("first_back"), F.col("left").alias("pos"))
    lasts = placed.where("dart = last and not ring").select(F.col("dart").alias("last_dart"), F.col("dst").alias("end"), F.col("edge").alias("end_edge"))
    chains = placed.where("not ring").join(back, "back")
    fro, to = lasts.select(F.col("last_dart").alias("first_back"), F.struct(F.col("end").alias("n"), F.col("end_edge").alias("e"), "last_dart").alias("from_end")), lasts.select(F.col("last_dart").alias("last"), F.struct(F.col("end").alias("n"), F.col("end_edge").alias("e"), "last_dart").alias("to_end"))
    chains = chains.join(fro, "first_back").join(to, "last").where("from_end < to_end")
    chains = chains.select(F.col("first_back").alias("run"), "pos", "edge", "src", "dst", F.lit(False).alias("ring"))
    # rings: of the two ways around, that of the smaller dart at the smallest node, from that node on
    rings = placed.where("ring")
    head = rings.groupBy("last").agg(F.min(F.struct(F.col("src").alias("n"), "dart")).alias("head"), F.count(F.lit(1)).alias("size"))
    where = rings.join(head, "last").where("dart = head.dart").select("last", F.col("left").alias("head_left"), F.col("head.n").alias("n"), F.col("dart").alias("head_dart"))
    sides = rings.select("last", F.col("back")).join(rings.select(F.col("dart").alias("back"), F.col("last").alias("other")), "back").groupBy("last").agg(F.min("other").alias("other"))
    best = where.join(sides, "last").join(where.select(F.col("last").alias("other"), F.col("head_dart").alias("other_dart")), "other").where("last = other or head_dart <= other_dart")
    turned = rings.join(best, "last").join(head.select("last", "size"), "last")
    pos = F.pmod(F.col("head_left") - F.col("left"), F.col("size"))
    members = chains.union(turned.select(F.col("head_dart").alias("run"), pos.alias("pos"), "edge", "src", "dst", F.lit(True)))
    members = cut(members.dropDuplicates(["run", "edge"]))
    detail = members.join(edges.select(F.col("id").alias("edge"), "style", "length"), "edge")
    runs = detail.groupBy("run", "ring").agg(F.min_by("src", "pos").alias("a"), F.max_by("dst", "pos").alias("b"), F.min(F.when(F.col("style") != "bridge", F.struct("pos", "style")))["style"].alias("style"), F.count(F.lit(1)).alias("edges"), F.sum("length").alias("length"))
    nodes = members.select("run", F.col("pos").alias("pos"), "edge", F.col("src").alias("node")).union(members.groupBy("run").agg((F.max("pos") + 1).alias("pos"), F.lit(None).cast("long").alias("edge"), F.max_by("dst", "pos").alias("node")))
    return runs.select("run", "a", "b", F.coalesce("style", F.lit("solid")).alias("style"), "edges", "length", "ring"), nodes
