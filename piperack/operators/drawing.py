"""From drawing primitives to detected symbols and oriented runs, page by page.

paths(page, path, type, width, points: array of struct x, y) are strokes; every join stays within a page and goes
through a grid, so that the symbols of one page spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piperack.checkpoints import Grown, cut
from piperack.operators.geometry import closest, foot, point_segments, within


def segments_of(paths: DataFrame, least: float = 1.0) -> DataFrame:
    """page, path, seg, ax, ay, bx, by, length, angle (mod 180), mx, my of the strokes' straight pieces of ``least`` or more."""
    pieces = paths.select("page", "path", F.posexplode(F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("seg", "s"))
    found = pieces.select("page", "path", "seg", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return found.withColumns({"length": F.sqrt(dx * dx + dy * dy), "angle": F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)), "mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2}).where(F.col("length") >= least)


def circles_of(paths: DataFrame, corners: int = 8, spread: float = 0.03) -> DataFrame:
    """page, path, x, y, r of the strokes whose points keep one distance from their mean."""
    n = F.size("points")
    mean = lambda c: F.try_divide(F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]), n)
    centred = paths.where(n >= corners).withColumns({"x": mean("x"), "y": mean("y")})
    far = F.transform("points", lambda p: F.sqrt((p["x"] - F.col("x")) ** 2 + (p["y"] - F.col("y")) ** 2))
    sized = centred.withColumn("far", far).withColumn("r", F.try_divide(F.aggregate("far", F.lit(0.0), lambda s, d: s + d), n))
    deviation = F.sqrt(F.try_divide(F.aggregate("far", F.lit(0.0), lambda s, d: s + (d - F.col("r")) ** 2), n))
    return sized.where((F.col("r") > 0) & (F.try_divide(deviation, F.col("r")) < spread)).select("page", "path", "x", "y", "r")


def suppress(symbols: DataFrame, distance: float, rank: str) -> DataFrame:
    """page, id, n: symbols kept greedily, the largest ``rank`` first (ties: smaller id), and how many each has taken in."""
    from piperack.operators.topology import leaders

    led = leaders(symbols, distance, [-F.col(rank)])
    return led.groupBy("page", F.col("leader").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n"))


def texts_inside(circles: DataFrame, spans: DataFrame, margin: float = 2.0) -> DataFrame:
    """page, id, texts (top to bottom, distinct) of the spans whose centres lie in a circle (page, id, x, y, r)."""
    largest = circles.agg(F.max("r")).first()[0] or 0.0
    others = spans.select("page", F.col("text").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    hits = within(circles, others, largest + margin).where(F.col("d") <= F.col("r") + margin)
    return hits.groupBy("page", "id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("oy", "other"))), lambda s: s["other"])).alias("texts"))


def crossings(segments: DataFrame, reach: float, low: float = 30.0, high: float = 150.0, slack: float = 0.4, firsts: Column | None = None) -> DataFrame:
    """page, a, b, x, y, t, u where two segments (page, id, ax, ay, bx, by, angle, mx, my) cross between ``low`` and ``high`` degrees.

    Midpoints must be within ``reach``; the crossing may lie ``slack`` of a length beyond either's ends. ``firsts`` tells
    which segments may be a.
    """
    left = (segments if firsts is None else segments.where(firsts)).select("page", "id", F.col("mx").alias("x"), F.col("my").alias("y"), *[F.col(c).alias(f"l{c}") for c in ("ax", "ay", "bx", "by", "angle")])
    right = segments.select("page", F.col("id").alias("other"), F.col("mx").alias("ox"), F.col("my").alias("oy"), *[F.col(c).alias(f"r{c}") for c in ("ax", "ay", "bx", "by", "angle")])
    pairs = within(left, right, reach).where("id < other")
    turn = F.abs(F.col("langle") - F.col("rangle"))
    ux, uy, vx, vy = (F.col(f"{s}b{c}") - F.col(f"{s}a{c}") for s in "lr" for c in "xy")
    wx, wy = F.col("rax") - F.col("lax"), F.col("ray") - F.col("lay")
    det = ux * vy - uy * vx
    found = pairs.where((turn >= low) & (turn <= high)).withColumns({"t": F.try_divide(wx * vy - wy * vx, det), "u": F.try_divide(wx * uy - wy * ux, det)})
    inside = lambda c: F.col(c).between(-slack, 1 + slack)
    return found.where(inside("t") & inside("u")).select("page", F.col("id").alias("a"), F.col("other").alias("b"), (F.col("lax") + F.col("t") * ux).alias("x"), (F.col("lay") + F.col("t") * uy).alias("y"), "t", "u")


def gap_bridges(segments: DataFrame, low: float = 1.2, high: float = 8.0, offset: float = 1.5, sine: float = 0.05) -> DataFrame:
    """page, a, b, gap between the ends of two segments in one line (page, id, ax, ay, bx, by)."""
    ends = segments.select("page", "id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy")).select("page", "id", "e.x", "e.y", "dx", "dy")
    others = ends.select("page", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    pairs = within(ends, others, high).where("id < other").where(F.col("d") > low)
    size = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    bend = F.abs(F.col("dx") * F.col("ey") - F.col("dy") * F.col("ex")) / (size * F.sqrt(F.col("ex") ** 2 + F.col("ey") ** 2))
    aside = F.abs(F.col("dx") * (F.col("oy") - F.col("y")) - F.col("dy") * (F.col("ox") - F.col("x"))) / size
    return pairs.where((bend < sine) & (aside < offset)).groupBy("page", F.col("id").alias("a"), F.col("other").alias("b")).agg(F.min("d").alias("gap"))


def weighted_nearest(symbols: DataFrame, tags: DataFrame, cutoff: float, apart: bool = False) -> DataFrame:
    """page, id, tag, d: the tag (page, other, ox, oy, weight) of the least weighted distance within ``cutoff``; ties: the
    smaller. With ``apart`` both are of one kind, and none is its own tag."""
    return closest(symbols, tags, cutoff, apart=apart).withColumnRenamed("other", "tag")


def arrows_on_runs(arrows: DataFrame, segments: DataFrame, distance: float = 6.0, parallel: float = 0.85) -> DataFrame:
    """page, id, seg, direction: the nearest run that an arrow (page, id, x, y, dx, dy) lies along, 1 with it, -1 against it."""
    hits = point_segments(arrows, segments, distance)
    sx, sy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    cosine = F.try_divide(F.col("dx") * sx + F.col("dy") * sy, F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) * F.sqrt(sx * sx + sy * sy))
    along = hits.withColumn("c", cosine).where(F.abs("c") >= parallel)
    return along.groupBy("page", "id").agg(F.min(F.struct("d", "seg", "c")).alias("m")).select("page", "id", "m.seg", F.when(F.col("m.c") > 0, 1).otherwise(-1).alias("direction"))


def labels_on_runs(spans: DataFrame, segments: DataFrame, cutoff: float = 30.0) -> DataFrame:
    """page, id, seg, d: the run nearest to each label (page, id, x, y); ties: the smaller run."""
    # two minima of numbers need no sort of the pairs, which one of a struct would; pairs are made anew for the second
    spans = spans.select("page", "id", "x", "y")
    least = point_segments(spans, segments, cutoff).groupBy("page", "id").agg(F.min("d").alias("least"))
    at = cut(spans.join(least, ["page", "id"]))
    return point_segments(at, segments, cutoff).where("d = least").groupBy("page", "id", "d").agg(F.min("seg").alias("seg")).select("page", "id", "seg", "d")


def owned_edges(edges: DataFrame, boxes: DataFrame, margin: float = 2.0) -> DataFrame:
    """page, seg, owner, role: an edge with both ends in one box is internal to it, with one end it meets it at a nozzle."""
    inside = lambda x, y: F.col(x).between(F.col("x0") - margin, F.col("x1") + margin) & F.col(y).between(F.col("y0") - margin, F.col("y1") + margin)
    side = 64.0
    span = lambda a, b, m: F.sequence(F.floor((a - m) / side).cast("long"), F.floor((b + m) / side).cast("long"))
    celled = boxes.withColumn("cx", F.explode(span(F.col("x0"), F.col("x1"), margin))).withColumn("cy", F.explode(span(F.col("y0"), F.col("y1"), margin)))
    ends = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    points = edges.select("page", "seg", F.posexplode(ends).alias("end", "p")).select("page", "seg", "end", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.floor(F.col("p.x") / side).cast("long").alias("cx"), F.floor(F.col("p.y") / side).cast("long").alias("cy"))
    hits = points.join(celled, ["page", "cx", "cy"]).where(inside("px", "py")).groupBy("page", "seg", "end").agg(F.min("box").alias("owner"))
    return hits.groupBy("page", "seg", "owner").agg(F.count_distinct("end").alias("n")).select("page", "seg", "owner", F.when(F.col("n") == 2, "internal").otherwise("nozzle").alias("role"))


def degrees(edges: DataFrame) -> DataFrame:
    """page, node, degree, kind: dead end, corner or junction."""
    ends = edges.select("page", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("page", "node").agg(F.count(F.lit(1)).alias("degree")).withColumn("kind", F.when(F.col("degree") <= 1, "dead_end").when(F.col("degree") == 2, "corner").otherwise("junction"))


def cross_sheet_links(segments: DataFrame) -> DataFrame:
    """line_number, sheets of the line numbers that are on more than one sheet."""
    spread = segments.select("sheet", F.explode("lines").alias("line_number"))
    return spread.groupBy("line_number").agg(F.sort_array(F.collect_set("sheet")).alias("sheets")).where(F.size("sheets") > 1)


def page_checks(spans: DataFrame) -> DataFrame:
    """page, spans, upper median size (no mean of two), verdict, by what a page must hold to be read."""
    each = spans.groupBy("page", "size").count()  # sizes are few, however many spans a page has
    along = Window.partitionBy("page").orderBy("size")
    upto = each.withColumns({"upto": F.sum("count").over(along), "spans": F.sum("count").over(Window.partitionBy("page"))})
    sums = upto.where(F.col("upto") > F.floor(F.col("spans") / 2)).groupBy("page", "spans").agg(F.min("size").alias("median_size"))
    return sums.select("page", "spans", "median_size", F.when(F.col("spans") >= 20, "ok").when(F.col("spans") > 0, "poor").otherwise("fail").alias("verdict"))


def normalised(points: DataFrame, radii: DataFrame, target: float = 18.0, tolerance: float = 0.02) -> DataFrame:
    """points with x and y divided by their page's scale, the commonest symbol radius (to half a point) over ``target``."""
    rounded = radii.select("page", (F.round(F.col("r") * 2) / 2).alias("r")).groupBy("page", "r").count()
    scale = rounded.groupBy("page").agg((F.max(F.struct("count", F.col("r").alias("mode")))["mode"] / target).alias("scale"))
    s = F.when(F.abs(F.coalesce("scale", F.lit(1.0)) - 1) > tolerance, F.col("scale")).otherwise(1.0)
    return points.join(scale, "page", "left").withColumns({"x": F.col("x") / s, "y": F.col("y") / s}).drop("scale")


def orient(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """edges(id, a, b) with direction (1: a to b, -1, 0) and how it is known.

    Of the seeds (id, direction, priority, source) the smallest priority wins. A node of two edges passes flow on; at a
    node of more, an only undirected edge takes what the others leave: out if all others come in, in if all go out.
    Each round directs edges at nodes whose other edges are directed; contradicting rounds take 1 before -1.
    """
    first = seeds.groupBy("id").agg(F.min(F.struct("priority", "source", "direction")).alias("s")).select("id", F.col("s.direction").alias("direction"), F.col("s.source").alias("source"))
    ends = cut(edges.select("id", F.col("a").alias("node"), F.lit(1).alias("out")).union(edges.select("id", "b", F.lit(-1))))
    known = Grown(cut(first.join(edges.select("id"), "id", "left_semi")))
    while True:
        flows = ends.join(known.whole.select("id", "direction"), "id", "left").withColumn("leaves", F.col("out") * F.col("direction"))
        at = flows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count("leaves").alias("told"), F.min("leaves").alias("low"), F.max("leaves").alias("high"))
        ready = at.where("n >= 2 and told = n - 1 and low = high").select("node", "n", F.col("low").alias("sign"))
        found = flows.where("direction is null").join(ready, "node").groupBy("id").agg(F.max(-F.col("sign") * F.col("out")).alias("direction"), F.min(F.when(F.col("n") == 2, "propagated").otherwise("conservation")).alias("source"))
        found = cut(found)
        if found.isEmpty():
            break
        known.add(found)
    return edges.join(known.whole, "id", "left").select(*edges.columns, F.coalesce("direction", F.lit(0)).alias("direction"), "source")


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, tolerance: float) -> Column:
    """If a point lies on a segment."""
    return foot(px, py, ax, ay, bx, by)[1] <= tolerance


def dash_chains(dashes: DataFrame, gap: float = 7.0, least: int = 3) -> DataFrame:
    """page, chain, n, x0, y0, x1, y1: dashes (page, id, ax, ay, bx, by) that bridges join in one line, by the extreme ends."""
    from piperack.operators.graph import components

    links = gap_bridges(dashes, 0.0, gap, 1.5, 0.15)
    node = lambda c: F.concat_ws(":", F.col("page").cast("string"), F.lpad(F.col(c).cast("string"), 12, "0"))
    found = components(links.select(node("a").alias("src"), node("b").alias("dst")))
    members = dashes.withColumn("node", node("id")).join(found, "node")
    sums = members.groupBy("page", F.col("component").alias("chain")).agg(F.count(F.lit(1)).alias("n"), F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.max(F.greatest("ay", "by")).alias("y1"))
    return sums.where(F.col("n") >= least)


def ring_gaps(angles: DataFrame) -> DataFrame:
    """by, span, opening: the angular span of an arc's points (by, angle in degrees) and the middle of its largest gap."""
    along = Window.partitionBy("by").orderBy("angle")
    after = F.coalesce(F.lead("angle").over(along), F.first("angle").over(along) + 360)
    gaps = angles.withColumn("gap", after - F.col("angle"))
    return gaps.groupBy("by").agg(F.max(F.struct("gap", "angle")).alias("m")).select("by", (360 - F.col("m.gap")).alias("span"), F.pmod(F.col("m.angle") + F.col("m.gap") / 2, F.lit(360.0)).alias("opening"))
