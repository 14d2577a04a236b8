"""Nearest rows against brute force, and the pairs that the search makes."""

import math
import random

from piperack.operators import drawing, geometry


def test_nearest_is_brute_force_with_few_pairs(spark, monkeypatch):
    """Dense, sparse and many alike in place: each row's nearest is that of all pairs, which grow as the rows do."""
    rnd = random.Random(4)
    rows = [(p, round(rnd.gauss(0, 12), 1), round(rnd.gauss(0, 12), 1)) for p in (1, 2) for _ in range(500)]
    rows += [(1, 3.0, 4.0)] * 300 + [(2, 200.0, 0.0), (2, 289.5, 0.0), (2, 600.0, 0.0), (3, 0.0, 0.0)]
    rows = [(k, *r) for k, r in enumerate(rows)]
    points = spark.createDataFrame(rows, "id long, page int, x double, y double").cache()
    others = points.selectExpr("page", "id as other", "x as ox", "y as oy")
    pairs = []
    own = geometry.within

    def counted(*args, **kwargs):
        found = own(*args, **kwargs)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(geometry, "within", counted)

    def brute(i, weight):
        _, page, x, y = rows[i]
        near = ((math.sqrt((x - b) ** 2 + (y - c) ** 2), o) for o, p, b, c in rows if p == page and o != i)
        return min(((d * weight(o), o, round(d, 6)) for d, o in near if d <= 90 and d * weight(o) <= 90), default=None)

    light, heavy = lambda o: 1.0, lambda o: 2.5 if o % 2 == 0 else 1.0
    found = {r.id: (r.other, round(r.d, 6)) for r in geometry.nearest(points, others, 90.0, apart=True).collect()}
    assert found == {i: b[1:] for i in range(len(rows)) if (b := brute(i, light))}
    assert 0 < sum(pairs) < 40 * len(rows)
    weighted = others.selectExpr("*", "case when other % 2 = 0 then 2.5D else 1.0D end as weight")
    found = {r.id: (r.tag, round(r.d, 6)) for r in drawing.weighted_nearest(points, weighted, 90.0, apart=True).collect()}
    assert found == {i: b[1:] for i in range(len(rows)) if (b := brute(i, heavy))}
    found = {r.id: r.other for r in geometry.nearest(points, others, 90.0).collect()}
    assert found == {i: min(o for o, *at in rows if at == list(r[1:])) for i, r in enumerate(rows)}


def test_labels_take_the_nearest_run_without_a_sort(spark):
    """Ties go to the smaller run; a sort of all pairs in reach is as large as they are."""
    runs = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 0.0), (1, 5, 0.0, 4.0, 10.0, 4.0), (1, 3, 0.0, 9.0, 10.0, 9.0), (2, 9, 0.0, 0.0, 1.0, 0.0)], "page int, seg long, ax double, ay double, bx double, by double")
    spans = spark.createDataFrame([(1, 1, 5.0, 2.0), (1, 2, 5.0, 8.0), (2, 3, 50.0, 0.0)], "page int, id long, x double, y double")
    found = drawing.labels_on_runs(spans, runs, 5.0)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 5, 2.0), (1, 2, 3, 1.0)]
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
