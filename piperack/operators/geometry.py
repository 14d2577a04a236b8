"""Plane geometry over points and segments; every join within a distance goes through a grid of that size.

A grid join sends each point to its cell and each probe to the nine cells around its own, so it is an equi-join, which
Spark can shuffle and split, and never a comparison of all with all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piperack.checkpoints import cut

# Distances in points.
SNAP, T_SPLIT, NEAR_ENDS = 1.2, 1.2, (0.02, 0.98)
#: Rows in a cell at the start of a search, as a row sees them on the mean.
CROWD = 4


def stroke_class(width: Column) -> Column:
    """Pipe, aux or dash by the width of a stroke."""
    near = lambda w, tol: F.abs(width - w) < tol
    return F.when(near(0.43, 0.05) | near(1.13, 0.05) | near(1.70, 0.05), "pipe").when(near(0.71, 0.05), "aux").when(near(0.14, 0.03), "dash")


def circle_class(radius: Column) -> Column:
    return F.when(radius >= 15.5, "instrument").when((radius >= 5.5) & (radius < 12), "small").when((radius >= 3) & (radius < 5.5), "dot").otherwise("tiny-dot")


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def within(left: DataFrame, right: DataFrame, distance: float, page: str = "page") -> DataFrame:
    """Pairs of left(page, id, x, y) and right(page, other, ox, oy) at most ``distance`` apart, with d."""
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    probes = left.select("*", F.explode(around).alias("i")).select("*", F.explode(around).alias("j"))
    probes = probes.withColumns({"cx": _cell(F.col("x"), distance) + F.col("i"), "cy": _cell(F.col("y"), distance) + F.col("j")}).drop("i", "j")
    cells = right.withColumns({"cx": _cell(F.col("ox"), distance), "cy": _cell(F.col("oy"), distance)})
    d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
    return probes.join(cells, [page, "cx", "cy"]).withColumn("d", d).where(F.col("d") <= distance).drop("cx", "cy")


def closest(left: DataFrame, right: DataFrame, cutoff: float, page: str = "page", apart: bool = False) -> DataFrame:
    """page, id, other, d: of ``right`` (page, other, ox, oy, weight) the least weighted distance from each of ``left`` (page, id,
    x, y), where it and the distance are ``cutoff`` at most; ties go to the smaller other.

    The search starts in cells of a few rows and doubles its reach until all that is out of reach must be farther than what
    is found, so pairs grow as the rows do, however close they stand. Of rows alike in place and weight the two smallest
    are enough, one of which may be the row itself.
    """
    spot = [page, "ox", "oy", "weight"]
    place = F.row_number().over(Window.partitionBy(*spot).orderBy("other"))
    spots = cut(right.select(*spot, "other").distinct().withColumn("_k", place).where(F.col("_k") <= (2 if apart else 1)).drop("_k"))
    halved, least = 0, spots.agg(F.min("weight")).first()[0]
    # a row shares its cell with so many on the mean; rows alike in place are two, so halving the cells thins them out
    while least is not None and least > 0 and halved < 48:
        side = cutoff / 2**halved
        cells = spots.groupBy(page, _cell(F.col("ox"), side).alias("cx"), _cell(F.col("oy"), side).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
        many = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if many <= CROWD:
            break
        halved += max(1, math.ceil(math.log(many / CROWD, 4)))
    open_, done = left.select(page, "id", "x", "y"), None
    for k in range(halved, -1, -1):
        reach = cutoff / 2**k
        pairs = within(open_, spots, reach, page).withColumn("w", F.col("d") * F.col("weight")).where(F.col("w") <= cutoff)
        best = (pairs.where("id <> other") if apart else pairs).groupBy(page, "id").agg(F.min(F.struct("w", "other", "d")).alias("m"))
        found = best.select(page, "id", "m.other", "m.d") if not k else cut(best.where(F.col("m.w") < reach * least).select(page, "id", "m.other", "m.d"))
        done = found if done is None else done.union(found)
        if k:
            open_ = cut(open_.join(found, [page, "id"], "left_anti"))
    return done


def nearest(left: DataFrame, right: DataFrame, cutoff: float, page: str = "page", apart: bool = False) -> DataFrame:
    """page, id, other, d: the nearest of ``right`` for each of ``left`` within ``cutoff``; ties go to the smaller other.
    With ``apart`` both are of one kind, and none is its own nearest."""
    return closest(left, right.withColumn("weight", F.lit(1.0)), cutoff, page, apart)


def snap(points: DataFrame, tolerance: float = SNAP, page: str = "page") -> DataFrame:
    """page, id, anchor: the smallest id within ``tolerance`` of each point, itself included (order-free)."""
    others = points.select(page, F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return within(points, others, tolerance, page).groupBy(page, "id").agg(F.min("other").alias("anchor"))


def foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The place t of a point's foot on a segment, clipped to its ends, and the distance to it."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    return t, F.sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)


def point_segments(points: DataFrame, segments: DataFrame, distance: float, page: str = "page") -> DataFrame:
    """Pairs of points(page, id, x, y) and segments(page, seg, ax, ay, bx, by) at most ``distance`` apart, with t and d.

    A segment covers the grid cells of its bounding box, widened by the distance; cells are as long as the mean segment.
    """
    mean = segments.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0] or distance
    size = max(distance, float(mean))
    span = lambda a, b: F.sequence(_cell(F.least(a, b) - distance, size), _cell(F.greatest(a, b) + distance, size))
    covered = segments.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"))))
    at = points.withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})
    t, d = foot(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    return at.join(covered, [page, "cx", "cy"]).withColumns({"t": t, "d": d}).where(F.col("d") <= distance).drop("cx", "cy")


def t_split(points: DataFrame, segments: DataFrame, distance: float = T_SPLIT, page: str = "page") -> DataFrame:
    """page, seg, piece, t0, t1: segments cut where a point lies on them, away from their ends."""
    low, high = NEAR_ENDS
    cuts = point_segments(points, segments, distance, page).where((F.col("t") >= low) & (F.col("t") <= high) & (F.col("d") < distance))
    ends = segments.select(page, "seg", F.lit(0.0).alias("t")).union(segments.select(page, "seg", F.lit(1.0)))
    along = Window.partitionBy(page, "seg").orderBy("t")
    placed = cuts.select(page, "seg", F.round("t", 6).alias("t")).union(ends).distinct().withColumn("t1", F.lead("t").over(along)).withColumn("piece", F.row_number().over(along))
    return placed.where("t1 is not null").select(page, "seg", "piece", F.col("t").alias("t0"), "t1")


def fit_circles(points: DataFrame, by: str) -> DataFrame:
    """by, n, cx, cy, r: the least-squares circle (Kasa's) of each group's points, from sums; null where they are in line."""
    x, y = F.col("x"), F.col("y")
    sums = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = points.join(sums, by).withColumns({"u": x - F.col("mx"), "v": y - F.col("my")})
    u, v = F.col("u"), F.col("v")
    m = moved.groupBy(by).agg(
        F.first("n").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"),
        F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"),
        F.sum(u * (u * u + v * v)).alias("pu"), F.sum(v * (u * u + v * v)).alias("pv"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") ** 2
    a = F.try_divide(F.col("pu") * F.col("vv") - F.col("pv") * F.col("uv"), 2 * det)
    b = F.try_divide(F.col("pv") * F.col("uu") - F.col("pu") * F.col("uv"), 2 * det)
    return m.select(by, "n", (F.col("mx") + a).alias("cx"), (F.col("my") + b).alias("cy"), F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n")).alias("r"))
