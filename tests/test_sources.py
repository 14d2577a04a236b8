"""Readers, sinks, streams and retrieval on small files."""

import json
import math
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from piperack.operators import audit, contraction, geometry, retrieval, worksheet
from piperack.sources import exports, readers
from piperack.streaming import telemetry


def test_knowledge_documents_have_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": "A", "source_type": "standard", "title": "t", "chunks": [{"chunk_id": "1", "text": "x", "guidewords": ["no", "As well as"], "parameters": ["FLOW"]}]}))
    (tmp_path / "b.json").write_text(json.dumps({"doc_id": "B", "curation": "approved", "holdout": True, "chunks": []}))
    docs = readers.documents(spark, str(tmp_path))
    got = {r.doc_id: r for r in docs.collect()}
    assert (got["A"].curation, got["A"].confidentiality, got["A"].holdout, got["B"].holdout) == ("pending", "internal", False, True)
    chunk = readers.chunks(docs).first()
    assert (chunk.chunk_id, chunk.guidewords, chunk.parameters) == ("A#1", ["NO", "AS WELL AS"], ["flow"])


def test_a_plant_model_becomes_terminals(spark, tmp_path):
    model = {"conceptualModel": {
        "Equipment": [{"id": "e1", "sheet": 4, "tagName": "2401-V-001"}, {"id": "e1b", "sheet": 5, "tagName": "2401-V-001"}, {"id": "e2", "sheet": 4, "shape": "circle"}],
        "Nozzle": [{"id": "n1", "sheet": 4, "equipment": "e1"}, {"id": "n9", "sheet": 4, "equipment": "gone"}],
        "PipingComponent": [{"id": "pc1", "sheet": 4, "componentClass": "CheckValve"}],
        "ProcessInstrumentationFunction": [{"id": "i1", "sheet": 4}],
        "PipeOffPageConnector": [{"id": "o1", "sheet": 4, "labels": ["A-1"]}, {"id": "o2", "sheet": 5, "labels": ["A-1"]}, {"id": "o3", "sheet": 5, "labels": []}],
        "PipingNetworkSegment": [{"id": "s1", "from": "n1", "to": "pc1", "lineNumber": ["L1"], "flowDirection": "to_from", "flowDirectionSource": "arrow"}],
    }}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(model, indent=1))
    tables = readers.plant_model(spark, str(path))
    terminals, nodes = contraction.terminals_of(tables)
    assert {r.id: r.tag for r in terminals.collect()} == {"e1": "2401-V-001", "e1b": "2401-V-001", "e2": "EQ-e2", "n1": "2401-V-001", "pc1": "XV-pc1", "i1": "I-i1", "o1": "OPC-A-1", "o2": "OPC-A-1", "o3": "OPC-o3"}
    merged = {r.tag: (r.equipment_type, r.sheets) for r in nodes.collect()}
    assert merged["2401-V-001"] == ("vessel", [4, 5]) and merged["OPC-A-1"] == ("line", [4, 5]) and merged["XV-pc1"][0] == "check_valve"
    edge = contraction.contract(terminals, readers.segments(tables)).first()
    assert (edge.source, edge.target, edge.line_tag, edge.direction) == ("XV-pc1", "2401-V-001", "L1", "known")


SHEET = [
    ["Study — Air", "", "", "", ""],
    ["Node", "Deviation", "Causes", "Consequences", "Safeguards"],
    ["N1", "More Pressure", "Blocked valve", "Overpressure", "PSV-001"],
    ["N1", "No Flow", "Trip", "Loss of air", "Standby"],
    ["N2", "", "", "", ""],
    ["N2", "Fluctuation", "Control hunting", "Cyclic loading", ""],
]


def workbook(path, shared):
    strings = [c for row in SHEET for c in row if c]
    cells = ""
    for r, row in enumerate(SHEET, 1):
        cells += f'<row r="{r}">'
        for c, v in enumerate(row):
            if v:
                ref = f"{'ABCDE'[c]}{r}"
                cells += f'<c r="{ref}" t="s"><v>{strings.index(v)}</v></c>' if shared else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        cells += "</row>"
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells += '<row r="7"><c r="A7"><v>3.0</v></c><c r="C7" t="b"><v>1</v></c></row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{cells}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{v}</t></si>" for v in strings) + "</sst>")


@pytest.mark.parametrize("shared", [False, True])
def test_worksheets_become_chunks(spark, tmp_path, shared):
    workbook(tmp_path / "w.xlsx", shared)
    rows = readers.xlsx_rows(spark, str(tmp_path / "w.xlsx"))
    cells = {r.row: r.cells for r in rows.collect()}
    assert cells[2] == SHEET[1] and cells[7] == ["3", "", "TRUE"]
    got = {r.row: r for r in readers.worksheet_chunks(rows).collect()}
    assert sorted(k for k, r in got.items() if not r.skipped) == [3, 4, 6, 7] and got[5].skipped
    assert (got[3].guideword, got[3].parameter) == ("MORE", "pressure") and (got[6].guideword, got[6].parameter) == ("", "")
    assert got[3].text == "deviation: More Pressure. causes: Blocked valve. consequences: Overpressure. safeguards: PSV-001"


def test_run_log_keeps_the_last_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n{"a": 3}\n')
    assert [r.a for r in readers.last_runs(spark, str(tmp_path / "log.jsonl"), "a int", 3).collect()] == [3, 2]


def test_last_lines_of_a_file_of_many_splits(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("".join(f'{{"a": {k}, "pad": "{"x" * (k % 97)}"}}\n' for k in range(4000)))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        lines = readers.numbered_lines(spark, str(tmp_path / "log.jsonl"))
        assert lines.select("block").distinct().count() > 20
        assert [json.loads(r.value)["a"] for r in lines.orderBy("block", "line").collect()] == list(range(4000))
        assert [r.a for r in readers.last_runs(spark, str(tmp_path / "log.jsonl"), "a int", 50).collect()] == list(range(3999, 3949, -1))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_event_log_round_trip_and_bad_lines(spark, tmp_path):
    events = spark.createDataFrame([("e1", "accepted"), ("e2", "edited")], "event_id string, action string")
    exports.append_jsonl(events.limit(1), str(tmp_path / "t"))
    exports.append_jsonl(events.where("action = 'edited'"), str(tmp_path / "t"))
    assert {r.event_id for r in readers.events(spark, str(tmp_path / "t")).collect()} == {"e1", "e2"}
    (tmp_path / "t" / "bad.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|corrupt"):
        readers.events(spark, str(tmp_path / "t")).collect()


def test_citations_have_files_and_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text("one FR-1\n\nFR-2 and FR-1\n")
    got = sorted((r.line, r.id) for r in readers.citations(spark, str(tmp_path), r"FR-\d+").collect())
    assert got == [(1, "FR-1"), (3, "FR-1"), (3, "FR-2")]


def test_bm25_and_fusion_as_plain_python(spark):
    texts = {1: "no flow through the pump", 2: "pump pump trip", 3: "tank level high", 4: ""}
    query = "pump flow pump"
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    asked = spark.createDataFrame([(7, query)], "query_id long, query string")
    tokens = {k: t.split() for k, t in texts.items()}
    mean = sum(map(len, tokens.values())) / 4
    df = Counter(w for t in tokens.values() for w in set(t))
    expected = {k: sum(math.log(1 + (4 - df[q] + 0.5) / (df[q] + 0.5)) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for q in query.split() if q in t) for k, t in tokens.items()}
    got = {r.chunk_id: r.score for r in retrieval.bm25(chunks, asked).collect()}
    assert got == pytest.approx({k: v for k, v in expected.items() if v})
    fused = {r.chunk_id: r.fused for r in retrieval.fuse(retrieval.bm25(chunks, asked), retrieval.bm25(chunks, asked)).collect()}
    order = sorted(got, key=lambda k: -got[k])
    assert fused == pytest.approx({k: 2 / (61 + i) for i, k in enumerate(order)})
    assert [r.chunk_id for r in retrieval.top(retrieval.fuse(retrieval.bm25(chunks, asked)), 1).collect()] == order[:1]


def test_unit_vectors(spark):
    rows = spark.createDataFrame([(1, "a b c a"), (2, "")], "chunk_id long, text string")
    cells = retrieval.hashed_vector(rows, "chunk_id", "text").collect()
    assert {r.chunk_id for r in cells} == {1} and sum(r.value**2 for r in cells) == pytest.approx(1)


def test_evidence_gate_cases(spark):
    cases = {"bad": ["contradicted", "supported"], "none": ["insufficient", None], "all": ["supported"], "half": ["supported", "insufficient"]}
    rows = [(k, v, 0.85) for k, vs in cases.items() for v in vs]
    got = {r.finding_id: (r.outcome, r.confidence) for r in worksheet.stage_b(spark.createDataFrame(rows, "finding_id string, verdict string, confidence double")).collect()}
    assert got == {"bad": ("rejected", None), "none": ("unsupported inference", 0.3), "all": ("released", 0.85), "half": ("stripped", 0.55)}
    left = spark.createDataFrame([("open", None, 0.85), ("open", None, 0.85), ("some", None, 0.85), ("some", "supported", 0.85)], "finding_id string, verdict string, confidence double")
    assert {r.finding_id: (r.outcome, r.kept, r.unchecked, r.confidence) for r in worksheet.stage_b(left).collect()} == {"open": ("unchecked", 0, 2, 0.85), "some": ("released", 1, 1, 0.85)}


def test_screening_rules(spark):
    rows = [("a", "pump", "blocked_outlet", {"normal_discharge_pressure": 8.0}), ("b", "pump", "blocked_outlet", {"normal_discharge_pressure": 8.0, "shutoff_pressure": 10.4}), ("c", "valve", "reverse_flow", {}), ("d", "valve", "no_flow", {}), ("e", "tank", "blocked_outlet", {})]
    got = {r.case_id: (r.rule, r.low, r.high) for r in worksheet.screen(spark.createDataFrame(rows, "case_id string, equipment_type string, deviation string, conditions map<string,double>")).collect()}
    assert got == {"a": ("pump_deadhead", 9.6, 12.0), "b": ("pump_shutoff", 10.4, 10.4), "c": ("reverse_flow", None, None), "d": ("no rule", None, None), "e": ("source_pressure", None, None)}


def test_percentiles_and_empty_rates(spark):
    rows = spark.createDataFrame([("x", float(k)) for k in range(1, 21)], "k string, v double")
    assert audit.nearest_rank(rows, "k", "v", 0.95).first().percentile == 19 and audit.nearest_rank(rows, "k", "v", 0.5).first().percentile == 10
    none = audit.grounding_precision(spark.createDataFrame([], "tags array<string>"), spark.createDataFrame([], "tag string")).first()
    assert (none.references, none.precision) == (0, 1.0)
    status = [("s", "done"), ("s", "partial"), ("s", "todo"), ("s", "out_of_scope")]
    assert {r.section: r.progress for r in audit.traceability(spark.createDataFrame(status, "section string, status string")).collect()} == {"s": 0.5, None: 0.5}


def test_circle_through_points(spark):
    points = [("c", 3 + 5 * math.cos(a), -2 + 5 * math.sin(a)) for a in (0.1, 1.2, 2.9, 4.4)] + [("line", float(k), float(k)) for k in range(3)]
    got = {r.k: (r.cx, r.cy, r.r) for r in geometry.fit_circles(spark.createDataFrame(points, "k string, x double, y double"), "k").collect()}
    assert got["c"] == pytest.approx((3, -2, 5))


def test_windows_as_a_stream_and_a_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    query = telemetry.run(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    table = telemetry.windowed(events)
    assert 0 < done.count() < table.count()  # windows that may still get rows are not out yet
    assert done.select("start", "event_type", "n").subtract(table.select("start", "event_type", "n")).count() == 0
    assert table.agg(F.sum("n")).first()[0] == events.count()


def test_listing_gold_requirements_and_audit_sheets(spark, tmp_path):
    import json

    doc = {"doc_id": "D1", "title": "One", "curation": "approved", "chunks": [{"chunk_id": "a", "text": "x"}, {"chunk_id": "b", "text": "y"}]}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.json").write_text(json.dumps(doc))
    (tmp_path / "docs" / "two.json").write_text(json.dumps({"doc_id": "D2"}))
    listed = {r.doc_id: (r.file, r.title, r.source_type, r.curation, r.holdout, r.chunks) for r in readers.corpus_listing(readers.documents(spark, str(tmp_path / "docs"))).collect()}
    assert listed == {"D1": ("one.json", "One", "", "approved", False, 2), "D2": ("two.json", "", "", "pending", False, 0)}
    gold = {"node_id": "N", "expected_deviations": ["no flow", "more flow"], "deviations": {"no flow": {"causes": [{"description": "c", "match_any": [["pump", "trip"], ["stop"]]}], "safeguards": []}}}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    rows = {(r.label, r.slot, r.item, str(r.match_any)) for r in readers.gold(spark, str(tmp_path / "gold.json")).collect()}
    assert rows == {("no flow", "causes", 0, "[['pump', 'trip'], ['stop']]"), ("no flow", "safeguards", None, "None"), ("more flow", None, None, "None")}
    (tmp_path / "rtm.json").write_text(json.dumps({"meta": {}, "requirements": [{"id": "FR-1", "section": "a", "status": "done", "notes": "n", "x": 1}]}))
    assert [tuple(r) for r in readers.requirements(spark, str(tmp_path / "rtm.json")).collect()] == [("FR-1", "a", "done", "n")]
    counters = spark.createDataFrame([("N1", 3, 0.5), ("N2", 0, 0.0)], "node string, bearing int, rate double")
    sample = spark.createDataFrame([("N1", 2, "b"), ("N1", 1, "a")], "node string, sample_id int, claim string")
    sheets = {r.node: json.loads(r.row) for r in exports.audit_sheet_json(counters, sample, "node").collect()}
    assert sheets["N1"] == {"node": "N1", "proxies": {"bearing": 3, "rate": 0.5}, "sample": [{"sample_id": 1, "claim": "a"}, {"sample_id": 2, "claim": "b"}]} and sheets["N2"]["sample"] == []
