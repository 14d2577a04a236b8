"""Answers to a table of questions about a plant: each question's rows, and one envelope.

Questions are read, guarded and answered together. Equal intents are answered once. All traces of a direction are one
closure whose words hold 64 starts each, so questions share its levels; paths, lists and counts are one plan each. What
can't be answered says why and gets no rows: nothing is guessed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.checkpoints import cut, stored
from piperack.functions import questions as read
from piperack.operators import graph, plants

#: What an intent is told by.
INTENT = ["kind", "tag", "target", "equipment_type"]
NEEDS_TAG, TYPED = ("downstream", "upstream", "relief", "neighbours", "info", "path"), ("list",)
ROWS = "kind string, tag string, target string, equipment_type string, item string, item_type string, detail string, number long"


@dataclass
class Answers:
    """envelopes: question_id, status, the intent, rows, verified, outcome, answer. rows: the intent, item, item_type,
    detail, number. marked: the intent and the tags that a drawing of the answer shows."""

    envelopes: DataFrame
    rows: DataFrame
    marked: DataFrame


def _said(intents: DataFrame, as_id: str) -> DataFrame:
    """question_id (the intent's, and 1 for its tag or 2 for its target), question for what ``intents`` name."""
    part = lambda side, c: intents.select(F.struct(F.col("question_id").cast(as_id).alias("own"), F.lit(side).alias("side")).alias("question_id"), F.col(c).alias("question"))
    return part(1, "tag").union(part(2, "target")).where("question is not null")


def reground(intents: DataFrame, nodes: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """question_id, kind, tag, target, equipment_type, unsure for intents that name tags in part, as another reader of
    questions gives them: a tag that is in the graph stays, a part of one becomes it, and what names none stays as it is,
    for the guard. A part of several is unsure. ``mentions`` has what their tags mention, where that is known already."""
    found = read.mentioned(_said(intents, intents.schema["question_id"].dataType.simpleString()), nodes) if mentions is None else mentions
    side = lambda n, name: found.where(F.col("question_id.side") == n).select(F.col("question_id.own").alias("q"), F.get("tags", F.lit(0)).alias(name), F.col("unsure").alias(f"{name}_unsure"))
    both = intents.withColumn("q", F.col("question_id")).join(side(1, "own"), "q", "left").join(side(2, "other"), "q", "left")
    unsure = F.concat(*[F.coalesce(c, F.array().cast(found.schema["unsure"].dataType)) for c in ("own_unsure", "other_unsure")])
    return both.select("question_id", "kind", F.coalesce("own", "tag").alias("tag"), F.coalesce("other", "target").alias("target"), "equipment_type", unsure.alias("unsure"))


def guarded(intents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``intents`` with status: "ok", or why there is no answer: unread, no tag, no type, ambiguous, unknown tag."""
    known = lambda c: nodes.select(F.col("tag").alias(c), F.lit(True).alias(f"{c}_known")).distinct()
    found = intents.join(known("tag"), "tag", "left").join(known("target"), "target", "left")
    kind, missing = F.col("kind"), lambda c: F.col(c).isNotNull() & F.col(f"{c}_known").isNull()
    status = (
        F.when(kind.isNull() | ~kind.isin(*NEEDS_TAG, *TYPED, "count", "no tag", "ambiguous"), "unread")
        .when(kind.isin("no tag", "ambiguous"), kind).when(F.coalesce(F.size("unsure"), F.lit(0)) > 0, "ambiguous")
        .when(kind.isin(*NEEDS_TAG) & F.col("tag").isNull() | (kind == "path") & F.col("target").isNull(), "no tag")
        .when(kind.isin(*TYPED) & F.col("equipment_type").isNull(), "no type")
        .when(kind.isin(*NEEDS_TAG) & (missing("tag") | missing("target")), "unknown tag").otherwise("ok")
    )
    return found.select("question_id", *INTENT, status.alias("status"))


def _walks(kind: Column) -> Column:
    """The walks that a kind of question takes, a row each."""
    walks = {"downstream": ("below",), "relief": ("below", "relief"), "upstream": ("above",), "path": ("paths",), "neighbours": ("near",), "info": ("told",)}
    return F.explode(F.coalesce(*[F.when(kind == k, F.array(*[F.lit(w) for w in v])) for k, v in walks.items()]))


def _row(item, item_type, detail, number) -> list[Column]:
    null = lambda x, kind: (F.lit(x) if x is None else x).cast(kind)
    return [null(item, "string").alias("item"), null(item_type, "string").alias("item_type"), null(detail, "string").alias("detail"), null(number, "long").alias("number")]


def answers(questions: DataFrame, nodes: DataFrame, edges: DataFrame, translated: DataFrame | None = None, cutoff: int | None = 12, most_paths: int = 5) -> Answers:
    """The answers to questions(question_id, question) over nodes(tag, equipment_type, name) and edges(src, dst, verified).

    ``translated`` (question_id, kind, tag, target, equipment_type) speaks for questions that the words don't read. Ways of more than
    ``cutoff`` edges are left out; None leaves out none. Where nodes and edges have a plant as well, which no edge leaves, each
    walk is made within its plant (see ``plants``)."""
    if translated is None:
        own = cut(read.intents(questions, nodes))  # read once, however often it is looked at
    else:
        # all tags that anybody names are looked for together
        as_id = questions.schema["question_id"].dataType.simpleString()
        asked = questions.select(F.struct(F.col("question_id").alias("own"), F.lit(0).alias("side")).alias("question_id"), "question")
        mentions = cut(read.mentioned(asked.union(_said(translated, as_id)), nodes))
        own = cut(read.intents(questions, nodes, mentions.where("question_id.side = 0").withColumn("question_id", F.col("question_id.own"))))
        unread = own.where("kind is null").select("question_id")
        other = cut(reground(translated.join(unread, "question_id", "left_semi"), nodes, mentions))
        own = cut(own.where("kind is not null").union(other.select(*own.columns)).union(own.where("kind is null").join(other.select("question_id"), "question_id", "left_anti")))
    # the items that questions name, for all that is asked of these alone
    named = own.select(F.explode(F.array_compact(F.array("tag", "target"))).alias("tag")).distinct()
    named = stored(nodes.join(named, "tag", "left_semi"))
    asked = cut(guarded(own, named))
    wanted = cut(asked.where("status = 'ok'").select(*INTENT).distinct())
    of = lambda *kinds: wanted.where(F.col("kind").isin(*kinds))
    flow = F.when(F.col("verified"), "verified").otherwise("unverified")
    fits = F.col("equipment_type").isNull() | (F.col("equipment_type") == F.col("node_type"))

    # downstream and relief start from one closure, upstream from that of the reversed graph
    if "plant" in nodes.columns:
        homes = named.select("plant", "tag")
        walks = of(*NEEDS_TAG).select(_walks(F.col("kind")).alias("what"), F.col("tag").alias("start"), F.when(F.col("kind") == "path", F.col("target")).alias("target")).distinct()
        walks = walks.join(homes.withColumnRenamed("tag", "start"), "start").select("plant", "what", "start", "target")
        # a target in another plant is out of reach
        inside = walks.where("what = 'paths'").join(homes.withColumnRenamed("tag", "target"), ["plant", "target"], "left_semi")
        walks = cut(walks.where("what <> 'paths'").union(inside.select(*walks.columns)))
        rows = plants.held(nodes, edges, walks)
        own = lambda what, *names: (nodes, edges, walks.where(F.col("what") == what).select("plant", F.col("start").alias(names[0]), *names[1:]))
        below, above = cut(plants.typed_reach(*own("below", "start"), own=rows("below"))), plants.typed_reach(*own("above", "start"), forward=False, own=rows("above"))
        paths = plants.simple_paths(*own("paths", "source", "target"), cutoff, rows("paths"))
        outcomes = plants.relief_outcomes(*own("relief", "start"), rows("relief"))
        met, ways = plants.neighbours(*own("near", "tag"), rows("near")), plants.connections(*own("told", "tag"), rows("told"))
    else:
        walk = cut(graph.query_graph(edges))
        starts = lambda *kinds: of(*kinds).select(F.col("tag").alias("start")).distinct()
        ends = cut(of("path").select(F.col("tag").alias("source"), "target").distinct())
        types = nodes.select(F.col("tag").alias("node"), F.col("equipment_type").alias("node_type"))
        typed = lambda found, node="node": found.withColumnRenamed(node, "node").join(types, "node")
        near, told = of("neighbours").select("tag").distinct(), of("info").select("tag").distinct()
        below, above = cut(typed(graph.reach(walk, starts("downstream", "relief")))), typed(graph.reach(walk, starts("upstream"), forward=False))
        paths, outcomes = graph.simple_paths(walk, ends, cutoff), graph.relief_outcomes(walk, nodes, starts("relief"))
        met = typed(graph.neighbours(edges, near), "neighbour")
        ways = edges.select(F.explode(F.array("src", "dst")).alias("tag")).join(told, "tag", "left_semi").groupBy("tag").count()
    traced = lambda kind, found: of(kind).join(found.withColumnRenamed("start", "tag"), "tag")
    parts = [traced(kind, found).where(fits).select(*INTENT, *_row(F.col("node"), F.col("node_type"), flow, None)) for kind, found in (("downstream", below), ("upstream", above))]
    parts.append(traced("relief", below).where("node_type = 'relief_valve'").select(*INTENT, *_row(F.col("node"), F.col("node_type"), flow, None)))
    parts.append(of("neighbours").join(met, "tag").where(fits).select(*INTENT, *_row(F.col("node"), F.col("node_type"), F.col("relationship"), None)))
    paths = cut(graph.first_paths(paths, most_paths).withColumnRenamed("source", "tag"))
    parts.append(of("path").join(paths, ["tag", "target"]).select(*INTENT, *_row(F.array_join("path", " → "), None, flow, F.size("path") - 1)))
    called = lambda df: df.select(F.col("tag").alias("node"), F.col("equipment_type").alias("node_type"), "name")
    lists = of("list")
    lists = F.broadcast(lists) if lists.count() <= read.FEW else lists
    parts.append(lists.join(called(nodes), F.col("equipment_type") == F.col("node_type")).select(*INTENT, *_row(F.col("node"), F.col("node_type"), F.col("name"), None)))
    counts = nodes.groupBy(F.col("equipment_type").alias("node_type")).count()
    typed = of("count").where("equipment_type is not null").join(counts, F.col("equipment_type") == F.col("node_type"), "left")
    parts.append(typed.select(*INTENT, *_row(None, F.col("equipment_type"), None, F.coalesce("count", F.lit(0)))))
    parts.append(of("count").where("equipment_type is null").join(counts, F.lit(True)).select(*INTENT, *_row(None, F.col("node_type"), None, F.col("count"))))  # a few types for at most one intent
    told = of("info").join(called(named), F.col("tag") == F.col("node")).join(ways, "tag", "left")
    fact = lambda name, value: F.struct(F.lit(name).alias("p"), value.alias("v"))
    facts = F.explode(F.array(fact("equipment_type", F.col("node_type")), fact("name", F.col("name")), fact("connections", F.coalesce("count", F.lit(0)).cast("string"))))
    parts.append(told.select(*INTENT, F.col("node"), facts.alias("f")).select(*INTENT, *_row(F.col("node"), F.col("f.p"), F.col("f.v"), None)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = cut(rows)

    outcomes = outcomes.select(F.col("start").alias("tag"), F.lit("relief").alias("kind"), "outcome")
    sure = F.col("detail").isin("verified", "FLOWS_TO (out)", "FLOWS_TO (in)")
    sums = rows.groupBy(*INTENT).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(sure, 1)).alias("verified"), F.min("number").alias("least"), F.sum("number").alias("total"))
    same = [wanted[c].eqNullSafe(sums[c]) for c in INTENT]
    known = wanted.join(sums, same[0] & same[1] & same[2] & same[3], "left").select(*[wanted[c] for c in INTENT], "rows", "verified", "least", "total").join(outcomes, ["kind", "tag"], "left")
    known = known.select(*INTENT, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("verified", F.lit(0)).alias("verified"), "least", "total", "outcome")
    same = [asked[c].eqNullSafe(known[c]) for c in INTENT]
    told = asked.join(known, (asked.status == "ok") & same[0] & same[1] & same[2] & same[3], "left")
    envelopes = told.select("question_id", "status", *[asked[c] for c in INTENT], "rows", "verified", "outcome", _sentence(asked, cutoff).alias("answer"))
    shown = rows.where("kind in ('downstream', 'upstream', 'relief', 'neighbours', 'list')").select(*INTENT, F.col("item").alias("shown"))
    shown = shown.union(rows.where("kind = 'path'").select(*INTENT, F.explode(F.split("item", " → "))))
    ends = wanted.where("kind not in ('list', 'count')").select(*INTENT, F.explode(F.array_compact(F.array("tag", "target"))))
    return Answers(envelopes, rows, shown.union(ends).distinct())


def _sentence(asked: DataFrame, cutoff: int | None) -> Column:
    kind, tag, rows, verified = asked.kind, asked.tag, F.col("rows").cast("string"), F.col("verified").cast("string")
    what = F.coalesce(F.concat(F.replace(asked.equipment_type, F.lit("_"), F.lit(" ")), F.lit("(s)")), F.lit("item(s)"))
    say = F.concat
    relief = F.create_map(*[F.lit(x) for pair in {
        "verified": "Yes: verified flow leads to a relief valve and nothing on the way can block it.",
        "drawn": "Drawn, not verified: a way to a relief valve rests on flow that nobody has verified.",
        "not credited": "Not credited: every way to a relief valve passes something that can block it.",
        "none": "No: flow reaches no relief valve.",
    }.items() for x in pair])
    refused = F.create_map(*[F.lit(x) for pair in {
        "unread": "The question wasn't understood.", "no tag": "The question names no item of the plant.", "no type": "The question names no type of item.",
        "ambiguous": "A name in the question may be one of several items.", "unknown tag": "An item that the question names isn't in the plant.",
    }.items() for x in pair])
    return (
        F.when(asked.status != "ok", F.element_at(refused, asked.status))
        .when(kind.isin("downstream", "upstream"), say(rows, F.lit(" "), what, F.lit(" "), kind, F.lit(" of "), tag, F.lit(": "), verified, F.lit(" by verified flow, "), (F.col("rows") - F.col("verified")).cast("string"), F.lit(" across unverified connections only.")))
        .when(kind == "neighbours", say(rows, F.lit(" connection(s) at "), tag, F.lit(", "), verified, F.lit(" of verified flow.")))
        .when((kind == "path") & (F.col("rows") > 0), say(rows, F.lit(" way(s) from "), tag, F.lit(" to "), asked.target, F.lit("; the shortest has "), F.col("least").cast("string"), F.lit(" hop(s).")))
        .when(kind == "path", say(F.lit("No way from "), tag, F.lit(" to "), asked.target, F.lit("." if cutoff is None else f" within {cutoff} hops.")))
        .when(kind == "relief", F.element_at(relief, F.col("outcome")))
        .when(kind == "list", say(rows, F.lit(" "), what, F.lit(" in the plant.")))
        .when(kind == "count", say(F.coalesce("total", F.lit(0)).cast("string"), F.lit(" "), what, F.lit(" in the plant.")))
        .when(kind == "info", say(F.lit("What is known of "), tag, F.lit(".")))
    )


def drawn_edges(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """The intent, src, dst, verified: the edges between the items that an answer shows."""
    src, dst = marked.withColumnRenamed("shown", "src"), marked.select(*[F.col(c).alias(f"_{c}") for c in INTENT], F.col("shown").alias("dst"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in INTENT]
    return edges.select("src", "dst", "verified").join(src, "src").join(dst, "dst").where(same[0] & same[1] & same[2] & same[3]).select(*INTENT, "src", "dst", "verified")
