"""Readers of knowledge documents, plant models, logs, requirements, citations and XLSX worksheets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = """doc_id string, source_type string, title string, date string, curation string, curator string, confidentiality string, holdout boolean,
applicability struct<unit_types:array<string>, chemistry:array<string>, equipment_classes:array<string>>,
chunks array<struct<chunk_id:string, text:string, guidewords:array<string>, parameters:array<string>>>"""
MODEL = """conceptualModel struct<
Equipment:array<struct<id:string, sheet:int, tagName:string, shape:string>>, Nozzle:array<struct<id:string, sheet:int, equipment:string>>,
PipingComponent:array<struct<id:string, sheet:int, componentClass:string>>, ProcessInstrumentationFunction:array<struct<id:string, sheet:int, tagName:string>>,
PipeOffPageConnector:array<struct<id:string, sheet:int, labels:array<string>>>, PipingNode:array<struct<id:string, sheet:int, nodeType:string>>,
PipingNetworkSegment:array<struct<id:string, `from`:string, `to`:string, lineNumber:array<string>, flowDirection:string, flowDirectionSource:string>>>"""
EVENT = "schema_version int, event_id string, timestamp string, study_id string, node_id string, deviation_label string, kind string, suggestion_text string, action string, edited_text string, user string, session_id string, confidence double, model_version string, prompt_template_version string, kb_snapshot_version string"
# The headers of worksheet columns, and the prefixes that name a guideword, first hit first.
HEADERS = {
    "node": ("node", "study node", "node no", "node no."),
    "deviation": ("deviation",),
    "guideword": ("guideword", "guide word"),
    "parameter": ("parameter",),
    "causes": ("cause", "causes", "possible causes"),
    "consequences": ("consequence", "consequences"),
    "safeguards": ("safeguard", "safeguards", "existing safeguards", "protection", "protections"),
    "recommendations": ("recommendation", "recommendations", "action", "actions"),
}
GUIDEWORD_PREFIXES = (
    ("as well as", "AS_WELL_AS"), ("other than", "OTHER_THAN"), ("part of", "PART_OF"), ("no/not", "NO"), ("reverse", "REVERSE"), ("before", "BEFORE"), ("early", "EARLY"),
    ("after", "AFTER"), ("less", "LESS"), ("more", "MORE"), ("late", "LATE"), ("not", "NO"), ("no", "NO"),
)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge documents of a folder of JSON files, with defaults: pending, internal, not held out."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    chunks = F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"), F.transform(c["guidewords"], F.upper).alias("guidewords"), F.transform(c["parameters"], F.lower).alias("parameters")))
    return raw.withColumns({"curation": F.coalesce("curation", F.lit("pending")), "confidentiality": F.coalesce("confidentiality", F.lit("internal")), "holdout": F.coalesce("holdout", F.lit(False)), "chunks": chunks, "file": F.input_file_name()})


def chunks(docs: DataFrame) -> DataFrame:
    """One row for each chunk: chunk_id is document#chunk."""
    return docs.select("*", F.explode("chunks").alias("c")).select(F.concat_ws("#", "doc_id", "c.chunk_id").alias("chunk_id"), "doc_id", "source_type", "curation", "holdout", "applicability", "c.text", "c.guidewords", "c.parameters")


def corpus_listing(docs: DataFrame) -> DataFrame:
    """file, doc_id, title, source_type, curation, holdout and the number of chunks of each document, without their texts."""
    return docs.select(F.element_at(F.split("file", "/"), -1).alias("file"), "doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("source_type", F.lit("")).alias("source_type"), "curation", "holdout", F.coalesce(F.size("chunks"), F.lit(0)).alias("chunks"))


GOLD = """node_id string, description string, expected_deviations array<string>,
deviations map<string, map<string, array<struct<description:string, match_any:array<array<string>>>>>>"""


def gold(spark: SparkSession, path: str) -> DataFrame:
    """node_id, label, slot, item, description, match_any of a gold set's files: each expected deviation, and its items where it has any."""
    raw = spark.read.schema(GOLD).option("multiLine", True).json(path)
    labels = raw.select("node_id", F.explode("expected_deviations").alias("label"), "deviations")
    slots = labels.select("node_id", "label", F.explode_outer(F.try_element_at("deviations", F.col("label"))).alias("slot", "items"))
    return slots.select("node_id", "label", "slot", F.posexplode_outer("items").alias("item", "x")).select("node_id", "label", "slot", "item", "x.description", "x.match_any")


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """requirement_id, section, status, notes of a file of requirements."""
    raw = spark.read.schema("requirements array<struct<id:string, section:string, status:string, notes:string>>").option("multiLine", True).json(path)
    return raw.select(F.inline("requirements")).withColumnRenamed("id", "requirement_id")


def plant_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a plant model file, by class."""
    raw = spark.read.schema(MODEL).option("multiLine", True).json(path).select("conceptualModel.*")
    return {c: raw.select(F.inline(F.coalesce(c, F.array().cast(raw.schema[c].dataType)))) for c in raw.columns}


def segments(model: dict[str, DataFrame]) -> DataFrame:
    """a, b, lines, direction, source of a plant model's segments."""
    way = F.when(F.col("flowDirection") == "from_to", 1).when(F.col("flowDirection") == "to_from", -1).otherwise(0)
    return model["PipingNetworkSegment"].select(F.col("from").alias("a"), F.col("to").alias("b"), F.col("lineNumber").alias("lines"), way.alias("direction"), F.col("flowDirectionSource").alias("source"))


def events(spark: SparkSession, path: str) -> DataFrame:
    """A log of decisions; a line that is no JSON fails the read, blank lines are passed over."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, value of text files: a block starts at that byte of its file, and line orders the lines of one
    block, so (block, line) is the order of a file however it is split over tasks."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def last_runs(spark: SparkSession, path: str, schema: str, limit: int = 200) -> DataFrame:
    """The records in the last ``limit`` lines of one log file, newest first, lines that are no JSON left out after that."""
    newest = [F.desc("block"), F.desc("line")]
    tail = numbered_lines(spark, path).orderBy(*newest).limit(limit)
    return tail.select("block", "line", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null and to_json(r) <> '{}'").orderBy(*newest).select("r.*")


def citations(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, line, id: every match of ``pattern`` in the text files of a folder."""

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = batch.assign(text=[c.decode("utf-8", "replace").split("\n") for c in batch.content]).explode("text")
            split["line"] = split.groupby("path").cumcount() + 1
            yield split[["path", "line", "text"]]

    lines = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(numbered, "path string, line int, text string")
    return lines.select(F.col("path").alias("file"), "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("id"))


def split_deviation(label: Column) -> Column:
    """guideword and parameter of a deviation such as "More Pressure"; both empty where no prefix names a guideword."""
    text = F.lower(F.trim(label))
    out = F.struct(F.lit("").alias("guideword"), F.lit("").alias("parameter"))
    for prefix, name in reversed(GUIDEWORD_PREFIXES):
        rest = F.regexp_replace(F.substr(text, F.lit(len(prefix) + 1)), r"^[ \-—:]+|[ \-—:]+$", "")
        out = F.when(text.startswith(prefix), F.struct(F.lit(name).alias("guideword"), rest.alias("parameter"))).otherwise(out)
    return out


def _workbook(content: bytes) -> Iterator[tuple[int, int, list[str]]]:
    """sheet, row (from 1) and cells of a workbook's bytes."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for at, (_, name) in enumerate(sheets):
            for number, row in enumerate(ElementTree.fromstring(book.read(name)).iter(f"{space}row"), 1):
                cells: dict[int, str] = {}
                for cell in row.iter(f"{space}c"):
                    column = 0
                    for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                        column = column * 26 + ord(letter) - 64
                    kind, value = cell.get("t", "n"), cell.findtext(f"{space}v")
                    if kind == "inlineStr":
                        found = text(cell)
                    elif value is None:
                        found = ""
                    else:
                        found = {"s": lambda v: shared[int(v)], "b": lambda v: "TRUE" if v == "1" else "FALSE"}.get(kind, lambda v: re.sub(r"^(-?\d+)\.0+$", r"\1", v))(value)
                    if column:
                        cells[column] = found
                yield at, number, [cells.get(i, "") for i in range(1, max(cells, default=0) + 1)]


def xlsx_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells of every worksheet of the workbooks at ``path``, a task a file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                yield pd.DataFrame([(name, *r) for r in _workbook(content)], columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, sheet int, row int, cells array<string>")


def worksheet_chunks(rows: DataFrame) -> DataFrame:
    """path, row, guideword, parameter, text, skipped of the data rows under the first row with a known header.

    A row without a deviation, or guideword and parameter, or causes, consequences or safeguards is skipped.
    """
    known = F.map_from_arrays(F.array(*[F.lit(a) for names in HEADERS.values() for a in names]), F.array(*[F.lit(c) for c, names in HEADERS.items() for _ in names]))
    named = rows.withColumn("names", F.transform("cells", lambda c: F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), F.lit(""))))
    header = named.where(F.arrays_overlap("names", F.array(F.lit("deviation"), F.lit("guideword"), F.lit("parameter"))))
    first = header.groupBy("path", "sheet").agg(F.min(F.struct("row", "names")).alias("h"))
    data = rows.join(first, ["path", "sheet"]).where(F.col("row") > F.col("h.row"))
    value = lambda n: F.trim(F.coalesce(F.try_element_at("cells", F.nullif(F.array_position("h.names", n), F.lit(0)).cast("int")), F.lit("")))
    cells = data.select("path", "sheet", "row", *[value(n).alias(n) for n in HEADERS])
    split = split_deviation(F.col("deviation"))
    guideword = F.when(F.col("guideword") != "", split_deviation(F.col("guideword"))["guideword"]).otherwise(split["guideword"])
    parameter = F.when(F.col("parameter") != "", F.lower("parameter")).otherwise(split["parameter"])
    body = [F.when(F.col(n) != "", F.concat(F.lit(f"{n}: "), F.col(n))) for n in ("deviation", "causes", "consequences", "safeguards", "recommendations")]
    empty = (F.col("causes") == "") & (F.col("consequences") == "") & (F.col("safeguards") == "")
    return cells.select("path", "sheet", "row", guideword.alias("guideword"), parameter.alias("parameter"), F.concat_ws(". ", *body).alias("text"), empty.alias("skipped"))
