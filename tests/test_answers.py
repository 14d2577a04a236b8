"""Answers in batch against the operators one by one, and the guard."""

import random

from piperack.functions import questions
from piperack.operators import answers, graph, plants

NODES = [("2401-K-001", "compressor"), ("2401-V-001", "vessel"), ("2401-V-002", "vessel"), ("2401-PSV-001", "relief_valve"), ("2401-FT-001", "instrument"), ("2401-V-009", "vessel"), ("2401-XV-9", "valve"), ("2401-PSV-002", "relief_valve")]
EDGES = [("2401-K-001", "2401-V-001", True), ("2401-V-001", "2401-PSV-001", True), ("2401-V-001", "2401-V-002", False), ("2401-FT-001", "2401-V-002", False), ("2401-V-009", "2401-XV-9", True), ("2401-XV-9", "2401-PSV-002", True)]
ASKED = {
    "what is downstream of 2401-K-001?": ("ok", 4, 2, None),
    "which vessels are downstream of K-001?": ("ok", 2, 1, None),
    "what feeds 2401-V-001?": ("ok", 3, 1, None),
    "path from 2401-K-001 to 2401-PSV-001": ("ok", 1, 1, None),
    "path from 2401-PSV-001 to 2401-K-001": ("ok", 0, 0, None),
    "list all relief valves": ("ok", 2, 0, None),
    "how many of each equipment type?": ("ok", 5, 0, None),
    "does 2401-V-001 have a relief path?": ("ok", 1, 1, "verified"),
    "does 2401-V-002 have a relief path?": ("ok", 1, 0, "drawn"),
    "does 2401-PSV-001 have a relief path?": ("ok", 0, 0, "none"),
    "does 2401-V-009 have a relief path?": ("ok", 1, 1, "not credited"),
    "what is connected to 2401-V-001?": ("ok", 3, 2, None),
    "tell me about 2401-V-001": ("ok", 3, 0, None),
    "sing me a song": ("unread", None, None, None),
    "what is downstream of the big compressor": ("no tag", None, None, None),
    "what about 001": ("ambiguous", None, None, None),
    "trace the flow from that first machine": ("ok", 4, 2, None),
    "hum": ("unknown tag", None, None, None),
    None: ("unread", None, None, None),
}


def plant(spark):
    return spark.createDataFrame([(t, k, f"the {t}") for t, k in NODES], "tag string, equipment_type string, name string"), spark.createDataFrame(EDGES, "src string, dst string, verified boolean")


def test_every_kind_is_answered_and_guarded(spark):
    nodes, edges = plant(spark)
    ids = {q: k for k, q in enumerate(ASKED)}
    asked = spark.createDataFrame([(k, q) for q, k in ids.items()], "question_id long, question string")
    other = [(ids["trace the flow from that first machine"], "downstream", "K-001", None, None), (ids["hum"], "path", "K-001", "nowhere", None), (ids["list all relief valves"], "count", None, None, None)]
    found = answers.answers(asked, nodes, edges, spark.createDataFrame(other, "question_id long, kind string, tag string, target string, equipment_type string"))
    got = {r.question_id: r for r in found.envelopes.collect()}
    for q, k in ids.items():
        assert (got[k].status, got[k].rows, got[k].verified, got[k].outcome) == ASKED[q], q
        assert got[k].answer
    assert got[ids["list all relief valves"]].kind == "list"  # another reader has no say where the words are read
    assert "2 hop" in got[ids["path from 2401-K-001 to 2401-PSV-001"]].answer and got[ids["path from 2401-PSV-001 to 2401-K-001"]].answer.startswith("No way")
    down = {r.item: r.detail for r in found.rows.where("kind = 'downstream' and equipment_type is null").collect()}
    assert down == {"2401-V-001": "verified", "2401-PSV-001": "verified", "2401-V-002": "unverified", "2401-FT-001": "unverified"}
    near = {r.item: r.detail for r in found.rows.where("kind = 'neighbours'").collect()}
    assert near == {"2401-PSV-001": "FLOWS_TO (out)", "2401-K-001": "FLOWS_TO (in)", "2401-V-002": "CONNECTED_TO (unknown)"}
    drawn = answers.drawn_edges(found.marked.where("kind = 'path' and tag = '2401-K-001'"), edges).collect()
    assert sorted((r.src, r.dst) for r in drawn) == [("2401-K-001", "2401-V-001"), ("2401-V-001", "2401-PSV-001")]


def test_words_of_many_starts_walk_as_each_alone(spark):
    """Over 64 starts on one graph with cycles: every start's walk is that of a plain search."""
    rnd = random.Random(2)
    pairs = {(rnd.randrange(90), rnd.randrange(90)) for _ in range(130)}
    rows = [(f"n{a}", f"n{b}", rnd.random() < 0.5) for a, b in pairs if a != b]
    edges = spark.createDataFrame(rows, "src string, dst string, verified boolean")
    starts = spark.createDataFrame([(f"n{k}",) for k in range(90)], "start string")
    stops = {f"n{k}" for k in range(0, 90, 7)}

    def search(start, sure, stop):
        seen, todo = set(), [start]
        while todo:
            at = todo.pop()
            if at in stop and at != start or at in stop and at in seen:
                continue
            for a, b, v in rows:
                if a == at and (v or not sure) and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    for stop in (set(), stops):
        table = spark.createDataFrame([(s,) for s in stop], "node string") if stop else None
        got = {(r.start, r.node): r.verified for r in graph.flagged_closure(edges, starts, table).collect()}
        expected = {}
        for k in range(90):
            sure = search(f"n{k}", True, stop)
            expected |= {(f"n{k}", n): n in sure for n in search(f"n{k}", False, stop)}
        assert got == expected
    plain = {(r.start, r.node) for r in graph.closure(edges, starts).collect()}
    assert plain == {(f"n{k}", n) for k in range(90) for n in search(f"n{k}", False, set())}


def test_a_large_frontier_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "FRONTIER", 0)
    nodes, edges = plant(spark)
    found = graph.flagged_closure(graph.query_graph(edges), spark.createDataFrame([("2401-K-001",)], "start string")).collect()
    assert {r.node: r.verified for r in found} == {"2401-V-001": True, "2401-PSV-001": True, "2401-V-002": False, "2401-FT-001": False}


def test_a_way_of_any_length_without_a_cutoff(spark):
    n = 16
    nodes = spark.createDataFrame([(f"2401-V-{k}", "vessel", "v") for k in range(n)], "tag string, equipment_type string, name string")
    edges = spark.createDataFrame([(f"2401-V-{k}", f"2401-V-{k + 1}", True) for k in range(n - 1)], "src string, dst string, verified boolean")
    asked = spark.createDataFrame([(1, f"path from 2401-V-0 to 2401-V-{n - 1}")], "question_id long, question string")
    assert [r.number for r in answers.answers(asked, nodes, edges, cutoff=None).rows.collect()] == [n - 1]
    assert answers.answers(asked, nodes, edges).rows.count() == 0


def test_items_of_plants_are_walked_within_their_rows(spark, monkeypatch):
    """With a plant the answers are those without one, and no small plant goes by levels."""
    nodes, edges = plant(spark)
    asked = spark.createDataFrame(list(enumerate(q for q in ASKED if q)), "question_id long, question string")
    told = lambda found: (sorted(map(repr, found.envelopes.collect())), sorted(map(repr, found.rows.collect())))
    expected = told(answers.answers(asked, nodes, edges))

    def levels(*_, **__):
        raise AssertionError("a small plant went by levels")

    monkeypatch.setattr(graph, "spread_bits", levels)
    at = "case when {0} rlike '(V-009|XV-9|PSV-002)$' then 2 else 1 end as plant"
    assert told(answers.answers(asked, nodes.selectExpr("*", at.format("tag")), edges.selectExpr("*", at.format("src")))) == expected


def test_all_walks_share_the_rows_of_plants(spark, monkeypatch):
    """Plants are put into rows once for all kinds of questions, and large plants are answered alike."""
    nodes, edges = plant(spark)
    edges = edges.union(spark.createDataFrame([("2401-V-002", "2401-GONE-1", False), ("2401-FT-001", "2401-FT-001", True)], edges.schema))  # an end that is no node, and a loop
    more = ["tell me about 2401-FT-001", "what is connected to 2401-V-002?", "what is downstream of 2401-FT-001?", "what feeds 2401-PSV-002"]
    asked = spark.createDataFrame(list(enumerate([q for q in ASKED if q] + more)), "question_id long, question string")
    told = lambda found: (sorted(map(repr, found.envelopes.collect())), sorted(map(repr, found.rows.collect())))
    expected = told(answers.answers(asked, nodes, edges))
    at = "case when {0} rlike '(V-009|XV-9|PSV-002)$' then 2 else 1 end as plant"
    nodes, edges = nodes.selectExpr("*", at.format("tag")), edges.selectExpr("*", at.format("src"))
    made, plain = [], plants._rows
    monkeypatch.setattr(plants, "_rows", lambda *args: made.append(1) or plain(*args))
    assert told(answers.answers(asked, nodes, edges)) == expected and len(made) == 1
    monkeypatch.setattr(plants, "MOST", 12)  # the second plant's row holds its four items and edges, the first is large
    assert told(answers.answers(asked, nodes, edges)) == expected


def test_questions_are_weighed_by_their_shapes(spark, monkeypatch):
    """Questions alike but for their tags are weighed once; where shapes are many, each question is, with the same result."""
    nodes, _ = plant(spark)
    many = [f"what is downstream of 2401-V-{k}?" for k in ("001", "002", "009")] + [q for q in ASKED if q]
    asked = spark.createDataFrame(list(enumerate([*many, "", None])), "question_id long, question string")
    weighed, plain = [], questions._weighed
    monkeypatch.setattr(questions, "_weighed", lambda shapes: weighed.append(shapes.count()) or plain(shapes))
    got = sorted(map(repr, questions.intents(asked, nodes).collect()))
    assert weighed[0] <= len(many) - 2
    monkeypatch.setattr(questions, "FEW", 0)
    assert sorted(map(repr, questions.intents(asked, nodes).collect())) == got and weighed[1] == len(many) + 2


def test_rows_alone_need_no_envelopes(spark, monkeypatch):
    nodes, edges = plant(spark)
    asked = spark.createDataFrame([(1, "does 2401-V-001 have a relief path?"), (2, "what is connected to 2401-V-001?")], "question_id long, question string")
    kept, plain = [], answers.cut
    monkeypatch.setattr(answers, "cut", lambda df: kept.append(df.columns) or plain(df))
    assert answers.answers(asked, nodes, edges).rows.count() == 4 and not any("outcome" in c for c in kept)
