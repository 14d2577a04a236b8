"""Leaders, matching and chains against plain loops; symbols by hand."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from piperack.operators import drawing, pairing, symbols, topology


@pytest.mark.parametrize("strict", [True, False])
def test_leaders_as_a_loop(spark, strict):
    rnd = random.Random(5)
    pick = lambda *also: rnd.choice([rnd.uniform(0, 30), *also])
    points = [(p, i, pick(7.0, 10.0), pick(3.0), rnd.randrange(5)) for p in (1, 2) for i in range(120)]
    expected, near = {}, lambda a, b: math.dist(a, b) < 3 or not strict and math.dist(a, b) == 3
    for page in (1, 2):
        led = []
        for _, i, x, y, _ in sorted((p for p in points if p[0] == page), key=lambda p: (-p[4], p[1])):
            to = next((k for k, *at in led if near(at, (x, y))), None)
            if to is None:
                led.append((i, x, y))
            expected[page, i] = i if to is None else to
    df = spark.createDataFrame([*points, (3, 1, None, 1.0, 0)], "page int, id long, x double, y double, r int")
    got = {(r.page, r.id): r.leader for r in topology.leaders(df, 3.0, [-F.col("r")], strict).collect()}
    assert got == expected | {(3, 1): 1}
    assert topology.leaders(df.limit(0), 3.0, []).count() == 0


def test_one_place_many_points_makes_no_pairs(spark):
    df = spark.range(4000).select(F.lit(1).alias("page"), "id", F.lit(1.0).alias("x"), (F.col("id") % 2 * 1e-3).alias("y"))
    assert {r.leader for r in topology.leaders(df, 3.0, []).select("leader").distinct().collect()} == {0}


def test_matching_as_a_loop(spark):
    rnd = random.Random(7)
    pairs = [(a, b, rnd.randrange(3)) for a in range(50) for b in range(a + 1, 50) if rnd.random() < 0.1] + [(4, 4, 0)]
    used, expected = set(), []
    for _, a, b in sorted((w, a, b) for a, b, w in pairs if a != b):
        if not {a, b} & used:
            expected.append((a, b))
            used |= {a, b}
    df = spark.createDataFrame([*pairs, pairs[0]], "a long, b long, w int")
    assert sorted((r.a, r.b) for r in topology.greedy_matching(df, [F.col("w")]).collect()) == sorted(expected)
    assert topology.greedy_matching(df.limit(0), []).count() == 0


def plain_runs(edges, anchors):
    at, by_id = defaultdict(list), {e[0]: e for e in edges}
    for i, a, b, *_ in edges:
        at[a].append(i)
        at[b].append(i)
    through = {n for n in at if len(at[n]) == 2 and n not in anchors and len({by_id[i][3] for i in at[n]} - {"bridge"}) <= 1}

    def walk(start, i):
        nodes, ids = [start], []
        while i is not None:
            ids.append(i)
            a, b = by_id[i][1:3]
            nodes.append(b if a == nodes[-1] else a)
            i = next((j for j in at[nodes[-1]] if j not in ids), None) if nodes[-1] in through else None
        return nodes, ids

    out, seen = [], set()

    def emit(nodes, ids, ring):
        if not ring and (nodes[-1], ids[-1]) < (nodes[0], ids[0]):
            nodes, ids = nodes[::-1], ids[::-1]
        style = next((by_id[i][3] for i in ids if by_id[i][3] != "bridge"), "solid")
        out.append((nodes[0], nodes[-1], style, len(ids), round(sum(by_id[i][4] for i in ids), 3), ring, tuple(nodes)))
        seen.update(ids)

    for i, a, b, *_ in edges:
        for start in (a, b):
            if i not in seen and start not in through:
                emit(*walk(start, i), False)
    for i, a, *_ in edges:
        if i not in seen:
            nodes, ids = walk(a, i)
            least = min(nodes)
            first = min(2 * j + (by_id[j][1] != least) for j in ids if least in by_id[j][1:3])
            emit(*walk(least, first // 2), True)
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_chains_of_branches_and_rings(spark, seed):
    rnd = random.Random(seed)
    ends = [(k, k + 1) for k in range(80) if rnd.random() < 0.9] + [(0, 20), (30, 45), (100, 101), (101, 102), (102, 100), (110, 111), (111, 112), (112, 113), (113, 110), (120, 120), (130, 131), (130, 131), (140, 141), (141, 140)]
    ends += [(rnd.randrange(80), rnd.randrange(80)) for _ in range(6)]
    edges = [(i, a, b, rnd.choice(["solid", "solid", "bridge"]), round(rnd.random() * 9, 2)) for i, (a, b) in enumerate(ends)]
    anchors = [rnd.randrange(80) for _ in range(4)]
    runs, members = topology.collapsed_chains(spark.createDataFrame(edges, "id long, a long, b long, style string, length double"), spark.createDataFrame([(a,) for a in anchors], "node long"))
    along = defaultdict(list)
    for m in members.orderBy("run", "pos").collect():
        along[m.run].append(m.node)
    assert sorted((r.a, r.b, r.style, r.edges, round(r.length, 3), r.ring, tuple(along[r.run])) for r in runs.collect()) == plain_runs(edges, anchors)


def test_ranking_takes_log_rounds(spark):
    n = 300
    darts = spark.range(n).select(F.col("id").alias("dart"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next"))
    ranked, rounds = topology.ranked_chains(darts)
    assert rounds <= math.ceil(math.log2(n)) + 1
    assert all(r.last == n - 1 and r.left == n - 1 - r.dart and not r.ring for r in ranked.collect())


def test_valves_and_capsules_by_hand(spark):
    def stroke(page, id, ax, ay, bx, by):
        return page, id, ax, ay, bx, by, math.degrees(math.atan2(by - ay, bx - ax)) % 180, (ax + bx) / 2, (ay + by) / 2

    cross = [stroke(1, 1, 0.0, 0.0, 10.0, 6.0), stroke(1, 2, 0.0, 6.0, 10.0, 0.0)]  # a full cross, with a bar
    lone = [stroke(1, 3, 100.0, 0.0, 110.0, 6.0), stroke(1, 4, 100.0, 6.0, 110.0, 0.0)]  # two pipes that cross
    four = [stroke(2, 5, 0.0, 0.0, 5.0, 3.0), stroke(2, 6, 5.0, 3.0, 10.0, 6.0), stroke(2, 7, 0.0, 6.0, 5.0, 3.0), stroke(2, 8, 5.0, 3.0, 10.0, 0.0)]
    lines = spark.createDataFrame([*cross, *lone, *four], "page int, id long, ax double, ay double, bx double, by double, angle double, mx double, my double")
    bars = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 6.0), (1, 2, 100.0, 0.0, 90.0, 0.0)], "page int, seg long, ax double, ay double, bx double, by double")
    rings = spark.createDataFrame([], "page int, id long, x double, y double, r double")
    got = {(r.page, r.x, r.y, r.strokes, r.orientation) for r in symbols.valves(lines, bars, rings, 20.0).collect()}
    assert got == {(1, 5.0, 3.0, 2, "H"), (2, 5.0, 3.0, 4, "H")}
    around = spark.createDataFrame([(1, 1, 6.0, 3.0, 8.0), (2, 2, 5.0, 3.0, 20.0)], "page int, id long, x double, y double, r double")
    assert [r.page for r in symbols.valves(lines, bars, around, 20.0).collect()] == [2]
    arcs = [(1, 1, 0.0, 0.0, 15.0, 180.0, 90.0), (1, 2, 0.0, 60.0, 15.0, 180.0, 270.0), (1, 3, 0.0, 80.0, 15.0, 180.0, 270.0), (1, 4, 200.0, 0.0, 15.0, 180.0, 90.0), (1, 5, 260.0, 0.0, 30.0, 180.0, 180.0)]
    found = symbols.capsules(spark.createDataFrame(arcs, "page int, id long, x double, y double, r double, span double, opening double")).collect()
    assert [(r.a, r.b, r.orientation, r.x0, r.y0, r.x1, r.y1) for r in found] == [(1, 2, "V", -15.0, -15.0, 15.0, 75.0)]


def test_crossings_of_a_crowded_page_are_not_stored(spark, monkeypatch):
    rnd = random.Random(3)
    at = [(rnd.gauss(0, 12), rnd.gauss(0, 12), rnd.uniform(0, math.pi), rnd.uniform(8, 30)) for _ in range(260)]
    ends = [(x - r * math.cos(w), y - r * math.sin(w), x + r * math.cos(w), y + r * math.sin(w)) for x, y, w, r in at]
    rows = [(i % 2, i, *e, math.degrees(math.atan2(e[3] - e[1], e[2] - e[0])) % 180, (e[0] + e[2]) / 2, (e[1] + e[3]) / 2) for i, e in enumerate(ends)]
    lines = spark.createDataFrame(rows, "page int, id long, ax double, ay double, bx double, by double, angle double, mx double, my double")
    every = drawing.crossings(lines, 20.0).withColumn("id", F.struct("a", "b"))
    led = every.join(topology.leaders(every.select("page", "id", "x", "y"), 4.0, [], strict=True), ["page", "id"]).toPandas()
    expected = {}
    for (page, leader), own in led.groupby(["page", "leader"]):
        if len(strokes := {*own.a, *own.b}) <= 8:
            expected[page, leader["a"], leader["b"]] = len(own), len(strokes), round(own.x.mean(), 6), round(own.y.mean(), 6)
    assert len(led) > 3000 and len(expected) > 20
    stored, plain = [], symbols.cut
    keep = lambda df: stored.append(plain(df)) or stored[-1]
    monkeypatch.setattr(symbols, "cut", keep)
    monkeypatch.setattr(topology, "cut", keep)
    monkeypatch.setattr(symbols, "AT_ONCE", 500, raising=False)
    got = {(r.page, r.id.a, r.id.b): (r.crossings, r.strokes, round(r.x, 6), round(r.y, 6)) for r in symbols.pinches(lines, 20.0, 4.0, 8).collect()}
    assert got == expected and max(df.count() for df in stored) < len(led) / 3


def test_nozzles_of_one_owner_merge(spark):
    rows = [(1, 1, "V-1", 0.0, 0.0, None), (1, 2, "V-1", 7.0, 0.0, "N1"), (1, 3, "V-1", 14.0, 0.0, None), (1, 4, "V-2", 1.0, 0.0, None), (2, 5, "V-1", 0.0, 0.0, None), (1, 6, None, 0.0, 0.0, None), (1, 7, None, 1.0, 0.0, None)]
    edges = [(1, 1, 2), (2, 1, 3), (3, 3, 4), (4, 5, 9), (5, 6, 7)]
    kept, left = symbols.merged_nozzles(spark.createDataFrame(rows, "page int, id long, owner string, x double, y double, label string"), spark.createDataFrame(edges, "id long, a long, b long"))
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4, 5, 6]  # the third is too far from the first, which leads
    assert sorted((e.id, e.a, e.b) for e in left.collect()) == [(2, 2, 3), (3, 3, 4), (4, 5, 9)]


def test_halves_of_a_tenth_go_by_the_value_times_ten(spark):
    """69.35 - 13 is 56.349999999999994 in digits, and 563.5 times ten."""
    got = spark.createDataFrame([(69.35, 13.0), (-69.35, -13.0), (0.25, 0.5), (None, 1.0)], "x double, r double").select(symbols.tenths(F.col("x") - F.col("r")).alias("v"))
    assert [r.v for r in got.collect()] == [56.4, -56.4, -0.3, None]
    arcs = spark.createDataFrame([(8, 414, 103.392, 69.35, 13.0, 180.0, 90.0), (8, 425, 103.4, 124.564, 13.0, 180.0, 270.0)], "page int, id long, x double, y double, r double, span double, opening double")
    assert [(r.a, r.b, r.y0) for r in symbols.capsules(arcs).collect()] == [(414, 425, 56.4)]


def _brute_pairs(heads):
    """One by one: the pair with the smallest first head, then the smallest second; rows of one id are one head."""
    aside = lambda w: min(w % 360, 360 - w % 360)

    def fits(a, b):
        d, axis = math.hypot(b[2] - a[2], b[3] - a[3]), math.degrees(math.atan2(b[3] - a[3], b[2] - a[2]))
        return a[0] == b[0] and a[1] < b[1] and abs(a[4] - b[4]) <= max(2.0, a[4] * 0.15) and a[4] * 0.5 <= d <= a[4] * 12 and aside(a[6] - axis) <= 55 and aside(b[6] - axis - 180) <= 55

    used, found = set(), set()
    for page, a, b in sorted({(a[0], a[1], b[1]) for a in heads for b in heads if fits(a, b)}):
        if not used & {(page, a), (page, b)}:
            used |= {(page, a), (page, b)}
            found.add((page, a, b))
    return found


ARC = "page int, id long, x double, y double, r double, span double, opening double"


def test_capsules_of_a_crowded_page_need_few_rounds(spark, monkeypatch):
    """Each pair waits for the one before it here, so rounds of pairs that come first at both ends were as many as pairs."""
    heads = [(1, i, float(i % 7), 60.0 * (i % 2), 15.0, 180.0, 90.0 if i % 2 == 0 else 270.0) for i in range(60)]
    cuts, plain = [], topology.cut
    keep = lambda df: cuts.append(1) or plain(df)
    for module in (topology, pairing):
        monkeypatch.setattr(module, "cut", keep)
    found = symbols.capsules(spark.createDataFrame(heads, ARC))
    assert len(cuts) <= 4
    assert {(r.page, r.a, r.b) for r in found.collect()} == _brute_pairs(heads) and found.count() == 30


def test_capsules_in_blocks_equal_brute_force(spark, monkeypatch):
    """Radii of several classes, places far apart, rows of one id, and rows that pair with nothing."""
    rnd = random.Random(5)
    size = lambda: rnd.choice([rnd.uniform(12, 20), rnd.uniform(28, 36), 16.0, 32.0, 100.0])
    heads = [(i % 3, i // 3 if i % 40 else 7, rnd.gauss(0, 150) + 5000 * (i % 11 == 0), rnd.gauss(0, 150), size(), 180.0, rnd.uniform(0, 360)) for i in range(600)]
    nan, inf = float("nan"), float("inf")
    odd = [(1, 900, nan, 0.0, 15.0, 180.0, 90.0), (1, 901, 0.0, inf, 15.0, 180.0, 90.0), (1, 902, 0.0, 0.0, inf, 180.0, 90.0), (1, 903, 0.0, 0.0, 15.0, 180.0, None), (None, 904, 0.0, 0.0, 15.0, 180.0, 90.0), (None, 905, 0.0, 60.0, 15.0, 180.0, 270.0), (1, None, 0.0, 60.0, 15.0, 180.0, 270.0)]
    expected = _brute_pairs(heads)
    arcs = spark.createDataFrame([*heads, *odd], ARC)
    for size in (pairing.AT_ONCE, 70):
        monkeypatch.setattr(pairing, "AT_ONCE", size)
        got = [(r.page, r.a, r.b) for r in symbols.capsules(arcs).collect()]
        assert len(got) == len(expected) > 100 and set(got) == expected
    assert symbols.capsules(arcs.where("id < 0")).count() == 0
