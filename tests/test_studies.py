"""Study nodes by their rules, tag references and records, on small plants."""

from pyspark.sql import functions as F

import pytest

from piperack.functions import sheets
from piperack.operators import records, studies

PLANT = {"V1": "vessel", "V2": "vessel", "V3": "vessel", "V9": "vessel", "X1": "valve", "K1": "compressor", "K2": "compressor", "P1": "pump", "E1": "heat_exchanger", "L1": "line", "I1": "instrument"}
DRAWN = [("V1", "X1", True), ("X1", "V2", True), ("V2", "K1", True), ("K1", "K2", True), ("K2", "K1", True), ("K2", "V3", True), ("P1", "V3", False), ("V1", "I1", False), ("L1", "V2", False), ("V2", "E1", True), ("V3", "E1", True)]


def plant(spark):
    return spark.createDataFrame(list(PLANT.items()), "tag string, equipment_type string"), spark.createDataFrame(DRAWN, "src string, dst string, verified boolean")


def test_neighbours_are_folded_over_items_in_line(spark):
    nodes, edges = plant(spark)
    found = {(r.tag, r.other): r.flow for r in studies.folded_neighbours(edges, nodes).collect()}
    one_way = {("V1", "V2"), ("V2", "K1"), ("K2", "V3"), ("V2", "E1"), ("V3", "E1")}
    expected = {p: "out" for p in one_way} | {(b, a): "in" for a, b in one_way} | {("K1", "K2"): "both", ("K2", "K1"): "both"}
    expected |= {p: "unknown" for p in (("P1", "V3"), ("V3", "P1"), ("L1", "V2"), ("V2", "L1"))}
    assert found == expected


def test_ways_of_mixed_or_drawn_flow_are_unknown(spark):
    nodes = spark.createDataFrame([("A", "vessel"), ("B", "vessel"), ("X", "valve"), ("Y", "check_valve")], "tag string, equipment_type string")
    flow = lambda *edges: {(r.tag, r.other): r.flow for r in studies.folded_neighbours(spark.createDataFrame(list(edges), "src string, dst string, verified boolean"), nodes).collect()}
    assert flow(("A", "X", True), ("X", "B", False)) == {("A", "B"): "unknown", ("B", "A"): "unknown"}
    assert flow(("A", "X", True), ("X", "Y", True), ("B", "Y", True)) == {("A", "B"): "unknown", ("B", "A"): "unknown"}
    assert flow(("A", "X", True), ("X", "B", True), ("B", "Y", True), ("Y", "A", True)) == {("A", "B"): "both", ("B", "A"): "both"}


def test_nodes_are_proposed_by_rules(spark):
    nodes, edges = plant(spark)
    neighbours = studies.folded_neighbours(edges, nodes)
    members = studies.propose_by_rules(neighbours, nodes)
    found = {r.tag: (r.node_id, r.placed) for r in members.collect()}
    assert found == {
        "V1": ("PN-E1", "grouped"), "V2": ("PN-E1", "grouped"), "K1": ("PN-E1", "attached"), "K2": ("PN-E1", "attached"),
        "E1": ("PN-E1", "ambiguous"), "V3": ("PN-V3", "grouped"), "P1": ("PN-P1", "standalone"),
    }
    beyond = {(r.at_member, r.tag, r.kind, r.flow) for r in studies.folded_boundaries(members, neighbours, nodes).where("node_id = 'PN-E1'").collect()}
    assert beyond == {("K2", "V3", "adjacent section", "out"), ("E1", "V3", "adjacent section", "in"), ("V2", "L1", "unit boundary", "unknown")}
    assert studies.propose_by_rules(neighbours.limit(0), nodes).count() == 0


def test_serial_machines_follow_one_another(spark):
    nodes = spark.createDataFrame([("V", "vessel"), ("A", "pump"), ("B", "pump"), ("C", "compressor")], "tag string, equipment_type string")
    edges = spark.createDataFrame([("V", "A", True), ("A", "B", True), ("B", "C", True)], "src string, dst string, verified boolean")
    found = {r.tag: (r.node_id, r.placed) for r in studies.propose_by_rules(studies.folded_neighbours(edges, nodes), nodes).collect()}
    assert found == {"V": ("PN-A", "grouped")} | {t: ("PN-A", "attached") for t in "ABC"}


def test_tags_in_texts(spark):
    texts = spark.createDataFrame([(1, "P-101 feeds PSV-201A; see IEC-61882 and xP-7, TK-100."), (2, "Line L1-A meets V1x and V1."), (3, ""), (4, None)], "text_id int, text string")
    known = spark.createDataFrame([("V1",), ("L1",), ("L1-A",), ("P-101",)], "tag string")
    assert {r.text_id: r.tags for r in records.tag_references(texts, known).collect()} == {1: ["P-101", "PSV-201A", "TK-100"], 2: ["L1", "L1-A", "V1"], 3: [], 4: []}


def test_requirements_and_events(spark):
    rows = spark.createDataFrame([("R1", "s", "done", ""), ("R1", "s", "todo", ""), ("R2", "s", "odd", ""), ("R3", "s", None, "")], "requirement_id string, section string, status string, notes string")
    assert {(r.requirement_id, r.fault) for r in records.requirement_faults(rows).collect()} == {("R1", "repeated"), ("R2", "status"), ("R3", "status")}
    changes = spark.createDataFrame([("R2", "blocked", None), ("R3", "odd", "x"), ("R9", "done", "y")], "requirement_id string, status string, notes string")
    assert {(r.requirement_id, r.status, r.notes) for r in records.updated(rows, changes).collect()} == {("R1", "done", ""), ("R1", "todo", ""), ("R2", "blocked", ""), ("R3", None, "")}
    events = spark.createDataFrame([("accepted", "u", None), ("edited", "u", ""), ("edited", "u", "t"), ("rejected", "", None), ("viewed", "u", None), (None, "u", None), ("rejected", "u", None)], "action string, user string, edited_text string")
    assert [(r.fault, r.provenance) for r in records.judged_events(events).collect()] == [
        (None, "ai_generated_human_approved"), ("edited without text", None), (None, "ai_generated_human_modified"), ("no user", None), ("unknown action", None), ("unknown action", None), (None, None),
    ]


def test_values_that_stand_for_none(spark):
    said = [" None ", "n/a", "-", "", "  x ", None, "nil", "NAN"]
    found = spark.createDataFrame([(v,) for v in said], "v string").select(records.value_or_null(F.col("v")).alias("v")).collect()
    assert [r.v for r in found] == [None, None, None, None, "x", None, None, "NAN"]


def test_pages_of_a_range():
    assert sheets.page_numbers(" All ", 3) == sheets.page_numbers(None, 3) == sheets.page_numbers("", 3) == [1, 2, 3]
    assert sheets.page_numbers("4-6, 2,2,,9-20, 0", 10) == [2, 4, 5, 6, 9, 10] and sheets.page_numbers("5-3", 9) == []


@pytest.mark.parametrize("common", [1, 10_000])
def test_common_and_rare_words_hold_tags_alike(spark, monkeypatch, common):
    """A word is read once however many texts have it; two texts of one id share their tags, and each keeps a row."""
    monkeypatch.setattr(records, "COMMON", common)
    texts = spark.createDataFrame([(k, f"Open V1-A, see X{k}-B-2") for k in range(5)] + [(7, "V1"), (7, "X3-B"), (8, "by hand")], "text_id long, text string")
    known = spark.createDataFrame([("V1",), ("X3-B",), ("B-2",)], "tag string")
    got = sorted((r.text_id, tuple(r.tags)) for r in records.tag_references(texts, known).collect())
    held = lambda k: ("B-2", "V1", "X3-B") if k == 3 else ("B-2", "V1")
    assert got == sorted([(k, held(k)) for k in range(5)] + [(7, ("V1", "X3-B"))] * 2 + [(8, ())])
