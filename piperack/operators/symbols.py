"""Symbols made of several strokes: valves at clusters of crossings, capsules of two arcs.

Clusters are greedy in a stated order, found by the rounds of ``topology``; joins go through a grid, so a page with all
the valves there are is spread over tasks like any other. Pairs of heads are found page by page (see ``pairing``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.checkpoints import cut
from piperack.operators.drawing import crossings
from piperack.operators.geometry import within
from piperack.operators.pairing import facing
from piperack.operators.topology import leaders, leaders_in_blocks, with_leader

# Strokes of a symbol at most, and where along both strokes a single crossing must lie.
MOST_STROKES, MIDDLE = 8, (0.3, 0.7)
#: Pairs of strokes near each other, by the counts of cells, in the first block that leaders are chosen from.
AT_ONCE = 4_000_000
# An arc's span and least radius as a head.
HEAD_SPAN, HEAD_RADIUS = (100.0, 280.0), 12.0


def tenths(x: Column) -> Column:
    """``x`` in tenths, halves away from zero, by its value times ten: 69.35 - 13 is 56.4, though its digits fall short of 56.35."""
    return F.round(x * 10) / 10


def _blocks(strokes: DataFrame, reach: float) -> list[Column]:
    """Which strokes are a block's firsts, in the order of their ids: one block, or blocks that double if pairs are many."""
    cell = lambda c: F.floor(F.col(c) / reach)
    n, square = strokes.groupBy("page", cell("mx"), cell("my")).count().agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
    halvings = math.ceil(math.log2(max(1.0, 4.5 * (square or 0) / AT_ONCE)))
    sample = sorted(r.id for r in strokes.where(F.pmod(F.xxhash64("id"), F.lit(max(1, (n or 0) // 4096))) == 0).select("id").distinct().collect()) if halvings else []
    bounds = sorted({sample[len(sample) >> k] for k in range(halvings, 0, -1)}) if sample else []
    ahead = [F.lit(True), *[F.col("id") > b for b in bounds]]
    return [low & high for low, high in zip(ahead, [*[F.col("id") <= b for b in bounds], F.lit(True)], strict=True)]


def pinches(diagonals: DataFrame, reach: float, cluster: float, most: int) -> DataFrame:
    """page, id, crossings, x, y, t, u, strokes, x0, y0, x1, y1: clusters of the crossings of ``diagonals`` with ``most`` strokes or fewer.

    A crossing is named by its strokes, and leads those after it that are nearer than ``cluster``; x and y are the mean
    of a cluster, the box holds its strokes, t and u tell where a single crossing lies on both.

    Crossings grow with the square of a page's strokes, so they are drawn anew for each use and never stored: once in blocks
    to choose the leaders, once to count clusters, once for those clusters that are small enough to have few strokes."""
    diagonals = cut(diagonals.select("page", "id", "ax", "ay", "bx", "by", "angle", "mx", "my"))
    found = lambda firsts: crossings(diagonals, reach, firsts=firsts).withColumn("id", F.struct("a", "b"))
    chosen = leaders_in_blocks([found(firsts) for firsts in _blocks(diagonals, reach)], cluster, strict=True)
    led = with_leader(found(None), chosen, cluster, strict=True)
    few = cut(led.groupBy("page", "leader").count().where(F.col("count") <= most * (most - 1) // 2).select("page", "leader"))  # so many pairs have ``most`` strokes
    own = cut(with_leader(found(None), chosen, cluster, True, few).join(few, ["page", "leader"], "left_semi"))
    places = own.groupBy("page", "leader").agg(F.count(F.lit(1)).alias("crossings"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("t").alias("t"), F.min("u").alias("u"))
    strokes = own.select("page", "leader", F.explode(F.array("a", "b")).alias("id")).distinct().join(diagonals.select("page", "id", "ax", "ay", "bx", "by"), ["page", "id"])
    boxes = strokes.groupBy("page", "leader").agg(F.count(F.lit(1)).alias("strokes"), F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.max(F.greatest("ay", "by")).alias("y1"))
    return places.join(boxes.where(F.col("strokes") <= most), ["page", "leader"]).withColumnRenamed("leader", "id")


def barred(singles: DataFrame, diagonals: DataFrame, bars: DataFrame, reach: float) -> DataFrame:
    """page, id of the clusters of one crossing with a bar (page, seg, ax, ay, bx, by) that meets two ends of their strokes."""
    ends = lambda df, *keep: df.select(*keep, F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select(*keep, "e.x", "e.y")
    strokes = singles.select("page", F.col("id").alias("pinch"), F.explode(F.array("id.a", "id.b")).alias("id")).join(diagonals, ["page", "id"]).drop("id").withColumnRenamed("pinch", "id")
    tips = ends(strokes, "page", "id")
    others = ends(bars.withColumnRenamed("seg", "other"), "page", "other").withColumnsRenamed({"x": "ox", "y": "oy"})
    met = within(tips, others, reach).where(F.col("d") < reach).groupBy("page", "id", "other").count()
    return met.where("count >= 2").select("page", "id").distinct()


def valves(diagonals: DataFrame, bars: DataFrame, circles: DataFrame, reach: float, cluster: float = 4.0, apart: float = 6.0, touch: float = 2.0, rings: tuple[float, float] = (5.5, 12.0)) -> DataFrame:
    """page, id, x, y, strokes, orientation, x0, y0, x1, y1: the valves among the crossings of ``diagonals``.

    A cluster is a valve if it has two crossings and three strokes, or one crossing in the middle of both and a bar at two
    of their ends; more than eight strokes are hatching. Of valves nearer than ``apart`` the one with most strokes stays
    (ties: the smaller id), and none stays within a circle (page, id, x, y, r) whose radius is within ``rings``."""
    found = cut(pinches(diagonals, reach, cluster, MOST_STROKES))
    middle = F.col("t").between(*MIDDLE) & F.col("u").between(*MIDDLE)
    singles = found.where("crossings = 1 and strokes = 2").where(middle)
    taken = found.where("crossings >= 2 and strokes >= 3").union(singles.join(barred(singles, diagonals, bars, touch), ["page", "id"], "left_semi").select(*found.columns))
    taken = cut(taken.withColumns({"x": tenths(F.col("x")), "y": tenths(F.col("y"))}))
    led = leaders(taken, apart, [-F.col("strokes")], strict=True)
    kept = taken.join(led.where("id = leader").select("page", "id"), ["page", "id"])
    around = circles.where(F.col("r").between(*rings)).select("page", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "r")
    inside = within(kept.select("page", "id", "x", "y"), around, rings[1] + touch).where(F.col("d") < F.col("r") + touch).select("page", "id").distinct()
    kept = kept.join(inside, ["page", "id"], "left_anti")
    lying = F.when(F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0"), "H").otherwise("V")
    return kept.select("page", "id", "x", "y", "strokes", lying.alias("orientation"), *[tenths(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def capsules(arcs: DataFrame) -> DataFrame:
    """page, a, b, r, orientation, x0, y0, x1, y1: bodies of two heads of ``arcs`` (page, id, x, y, r, span, opening).

    Two heads of like radius that open towards each other pair one to one: of all pairs the one with the smallest first
    head is taken first, then that with the smallest second. Angles are in degrees."""
    heads = arcs.where(F.col("span").between(*HEAD_SPAN) & (F.col("r") >= HEAD_RADIUS)).select("page", "id", "x", "y", "r", "opening")
    found = facing(heads).withColumn("r", (F.col("r") + F.col("o_r")) / 2)
    flat, r = F.abs(F.col("o_x") - F.col("x")) >= F.abs(F.col("o_y") - F.col("y")), F.col("r")
    box = {
        "x0": F.when(flat, F.least("x", "o_x")).otherwise(F.col("x")) - r, "y0": F.when(flat, F.col("y")).otherwise(F.least("y", "o_y")) - r,
        "x1": F.when(flat, F.greatest("x", "o_x")).otherwise(F.col("x")) + r, "y1": F.when(flat, F.col("y")).otherwise(F.greatest("y", "o_y")) + r,
    }
    return found.select("page", "a", "b", tenths(r).alias("r"), F.when(flat, "H").otherwise("V").alias("orientation"), *[tenths(x).alias(c) for c, x in box.items()])


def merged_nozzles(nozzles: DataFrame, edges: DataFrame, distance: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """``nozzles`` (page, id, owner, x, y, label) and ``edges`` (id, a, b) with nozzles of one owner nearer than ``distance`` to the
    first of them as one: the first that has a label, else the first. Edges follow, and those within one nozzle go.

    A nozzle goes with the earliest one in reach that leads, so a row of nozzles is never one for its links alone."""
    own = F.struct("page", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"))
    led = leaders(nozzles.select(own.alias("page"), "id", "x", "y"), distance, [], strict=True)
    labels = nozzles.select("id", F.col("label").isNull().alias("bare"))
    keepers = led.join(labels, "id").groupBy("page", "leader").agg(F.min(F.struct("bare", "id"))["id"].alias("kept"))
    named = cut(led.join(keepers, ["page", "leader"]).select("id", "kept"))
    moved = named.where("id <> kept")
    for end in ("a", "b"):
        edges = edges.join(moved.select(F.col("id").alias(end), F.col("kept").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return nozzles.join(moved.select("id"), "id", "left_anti").select(*nozzles.columns), edges.where("a <> b")
