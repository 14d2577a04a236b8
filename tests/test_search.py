"""Top-k retrieval, slot recall and percentiles against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from piperack.operators import audit, search
from piperack.operators import retrieval as r

WORDS = [f"w{k}" for k in range(40)]


def corpus(spark, n=300, asked=9):
    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choice(WORDS[: rnd.choice([5, 40])]) for _ in range(rnd.randrange(0, 25)))
    texts = [text() for _ in range(n)] + ["w1 w2 w3"] * 60 + [None, ""]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(5)
    queries = spark.createDataFrame([(f"q{k}", text()) for k in range(asked)] + [("none", "unheard of"), ("empty", None)], "query_id string, query string")
    return chunks, queries


def test_search_as_all_pairs_ranked(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    chunks, queries = corpus(spark)
    boosts = chunks.select("chunk_id", F.when(F.col("chunk_id") % 3 == 0, 2.0).otherwise(1.0).alias("boost"))
    fused = r.fuse(r.bm25(chunks, queries), r.cosine(chunks, queries), digits=9).join(boosts, "chunk_id").select("query_id", "chunk_id", F.round(F.col("fused") * F.col("boost"), 9).alias("fused"))
    expected = sorted(map(tuple, r.top(fused, 5).collect()))
    for candidates in (64, 2):  # enough at once, and so few that most queries are asked again
        monkeypatch.setattr(search, "CANDIDATES", candidates)
        assert sorted(map(tuple, search.search(chunks, queries, boosts).collect())) == expected


def test_nearest_as_all_pairs_ranked(spark):
    chunks, queries = corpus(spark)
    cells = lambda df, id, text: r.hashed_vector(df, id, text).select(id, "bucket", "value")
    got = search.top_by_cosine(search.rows_of(cells(chunks, "chunk_id", "text")), cells(queries, "query_id", "query"), r.DIM, 7, 6)
    ranked = {}
    for x in r.cosine(chunks, queries).withColumn("score", F.round("score", 6)).collect():
        ranked.setdefault(x.query_id, []).append((-x.score, x.chunk_id))
    expected = sorted((q, k + 1, c, -s) for q, xs in ranked.items() for k, (s, c) in enumerate(sorted(xs)[:7]))
    assert sorted(map(tuple, got.collect())) == expected
    assert search.top_by_cosine(search.rows_of(cells(chunks.limit(0), "chunk_id", "text")), cells(queries, "query_id", "query"), r.DIM, 7, 6).count() == 0


def test_slot_recall_by_words(spark):
    gold = [("a", "cause", 1, [["Pump", "trip"]]), ("a", "cause", 2, [["valve"], ["zz", "o"]]), ("a", "cause", 3, [["of x"]]), ("a", "cause", 4, [["never"]]), ("a", "effect", 5, [["pump"]]), ("b", "cause", 6, [[]]), ("b", "other", 7, [[]]), ("a", "cause", 8, [["trip", "never"], ["ip", "mp"]])]
    rows = [("a", "cause", "The PUMP may trip"), ("a", "cause", "lack of xylene"), ("a", "cause", None), ("b", "cause", "")]
    got = audit.slot_recall(spark.createDataFrame(gold, "label string, slot string, item int, match_any array<array<string>>"), spark.createDataFrame(rows, "label string, slot string, text string"))
    assert {(x.label, x.slot): (x.expected, x.matched) for x in got.collect()} == {("a", "cause"): (5, 3), ("a", "effect"): (1, 0), ("b", "cause"): (1, 1), ("b", "other"): (1, 0)}


def test_nearest_rank_by_counts(spark):
    rnd = random.Random(3)
    groups = {"a": [float(k) for k in range(1, 21)], "b": [2.0] * 19 + [60.0], "c": [rnd.randrange(9) / 2 for _ in range(500)], "d": [7.0], "e": [None], "f": [None, 1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(6)
    for q in (0.95, 0.5):
        got = {x.g: (x.n, x.percentile) for x in audit.nearest_rank(df, "g", "v", q).collect()}
        for g, vs in groups.items():
            held = sorted(v for v in vs if v is not None)
            assert got[g] == (len(held), held[max(0, math.ceil(q * len(held) - 1e-9) - 1)] if held else None)


@pytest.mark.parametrize("few", [0, 50_000])
def test_texts_are_not_shuffled_by_their_letters(spark, monkeypatch, few):
    """Few keywords come to the texts; many give the same."""
    from piperack.operators import graph

    plans, own = [], audit.stored
    monkeypatch.setattr(graph, "FRONTIER", few)
    monkeypatch.setattr(audit, "stored", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or own(df))
    gold = [("all", "u", 1, [["Over", "pump"], ["x"]]), ("all", "u", 2, [["mpx"]]), ("all", "v", 1, [["rel"]]), ("all", "u", 3, [[]])]
    rows = [("all", "u", "The pump runs overfull"), ("all", "u", "pumps"), ("all", "u", "pumps"), ("all", "v", None), ("all", "v", "RELIEF")]
    got = audit.slot_recall(spark.createDataFrame(gold, "label string, slot string, item int, match_any array<array<string>>"), spark.createDataFrame(rows, "label string, slot string, text string"))
    assert sorted((r.slot, r.expected, r.matched) for r in got.collect()) == [("u", 3, 2), ("v", 1, 1)]
    assert few == 0 or "SortMergeJoin" not in plans[-1] and plans[-1].count("BroadcastHashJoin") == 2


def test_top_by_bm25_in_blocks(spark, monkeypatch):
    """The best of each query as all scores rank them, with more than one block, and nothing of nothing."""
    monkeypatch.setattr(search, "BLOCK", 2)
    monkeypatch.setattr(search.blocks_of, "__defaults__", (None, 1.0, 2))
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice("pump valve tank line seal trip flow".split()) for _ in range(n))
    chunks = spark.createDataFrame([(k, text(rnd.randrange(9))) for k in range(60)] + [(99, None)], "chunk_id long, text string")
    queries = spark.createDataFrame([(k, text(3)) for k in range(5)] + [(7, "unheard of")], "query_id long, query string")
    ranked = {}
    for x in r.bm25(chunks, queries).collect():
        ranked.setdefault(x.query_id, []).append((-round(x.score, 6), x.chunk_id))
    expected = sorted((q, k + 1, c, -s) for q, xs in ranked.items() for k, (s, c) in enumerate(sorted(xs)[:7]))
    assert sorted(map(tuple, search.top_by_bm25(chunks, queries, 7, 6).collect())) == expected
    assert search.top_by_bm25(chunks.limit(0), queries, 7, 6).count() == 0
