"""Drawing operators on small sheets."""

import math

import pytest

from piperack.operators import drawing

EDGES = "id int, a string, b string"
SEEDS = "id int, direction int, priority int, source string"


def oriented(spark, edges, seeds):
    found = drawing.orient(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS))
    return {r.id: (r.direction, r.source) for r in found.collect()}


def test_flow_passes_corners_and_is_conserved(spark):
    edges = [(1, "a", "b"), (2, "c", "b"), (3, "c", "d"), (4, "d", "e"), (5, "d", "f"), (6, "x", "y")]
    got = oriented(spark, edges, [(1, 1, 0, "arrow"), (1, -1, 1, "psv")])
    assert got == {1: (1, "arrow"), 2: (-1, "propagated"), 3: (1, "propagated"), 4: (0, None), 5: (0, None), 6: (0, None)}
    tee = oriented(spark, [(1, "a", "t"), (2, "b", "t"), (3, "c", "t")], [(1, 1, 0, "arrow"), (2, 1, 0, "arrow")])
    assert tee[3] == (-1, "conservation")
    assert oriented(spark, [(1, "a", "t"), (2, "t", "b"), (3, "c", "t")], [(1, 1, 0, "arrow"), (2, 1, 0, "arrow")])[3] == (0, None)


def test_greedy_suppression_by_rank(spark):
    rows = [(1, 1, 0.0, 0.0, 5.0), (1, 2, 2.0, 0.0, 9.0), (1, 3, 5.5, 0.0, 1.0), (2, 4, 0.0, 0.0, 1.0)]
    got = {(r.page, r.id): r.n for r in drawing.suppress(spark.createDataFrame(rows, "page int, id long, x double, y double, size double"), 3.0, "size").collect()}
    assert got == {(1, 2): 2, (1, 3): 1, (2, 4): 1}


def ring(n, x, y, r):
    return [{"x": x + r * math.cos(2 * math.pi * k / n), "y": y + r * math.sin(2 * math.pi * k / n)} for k in range(n)]


def test_segments_and_circles_of_paths(spark):
    rows = [(1, 1, [{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 4.0}, {"x": 3.0, "y": 4.5}]), (1, 2, ring(12, 10, 10, 18)), (1, 3, ring(6, 0, 0, 5)), (1, 4, [])]
    paths = spark.createDataFrame(rows, "page int, path int, points array<struct<x:double,y:double>>")
    seg = drawing.segments_of(paths).where("path = 1").collect()
    assert len(seg) == 1 and seg[0].length == 5 and seg[0].angle == pytest.approx(math.degrees(math.atan2(4, 3)))
    circle = drawing.circles_of(paths).collect()
    assert [(r.path, round(r.x, 6), round(r.y, 6), round(r.r, 6)) for r in circle] == [(2, 10, 10, 18)]


def test_texts_in_a_bubble_from_the_top(spark):
    circles = spark.createDataFrame([(1, 7, 0.0, 0.0, 18.0)], "page int, id int, x double, y double, r double")
    spans = spark.createDataFrame([(1, "001", 0.0, 6.0), (1, "PT", 0.0, -6.0), (1, "PT", 1.0, -5.0), (1, "far", 30.0, 0.0)], "page int, text string, cx double, cy double")
    assert drawing.texts_inside(circles, spans).first().texts == ["PT", "001"]


def test_dashes_make_chains(spark):
    dashes = [(1, k, 10.0 * k, 0.0, 10.0 * k + 6, 0.0) for k in range(4)] + [(1, 9, 0.0, 50.0, 6.0, 50.0), (1, 10, 10.0, 50.0, 16.0, 50.0)]
    got = drawing.dash_chains(spark.createDataFrame(dashes, "page int, id int, ax double, ay double, bx double, by double")).collect()
    assert [(r.n, r.x0, r.x1, r.y0) for r in got] == [(4, 0, 36, 0)]


def test_weighted_tags(spark):
    symbols = spark.createDataFrame([(1, 1, 0.0, 0.0)], "page int, id int, x double, y double")
    tags = spark.createDataFrame([(1, "bare", 10.0, 0.0, 2.5), (1, "full", 20.0, 0.0, 1.0)], "page int, other string, ox double, oy double, weight double")
    assert drawing.weighted_nearest(symbols, tags, 900.0).first().tag == "full"
