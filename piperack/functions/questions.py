"""Questions about a plant as a table: each question's kind and arguments, read by the weight of its words.

``WEIGHTS`` says how much a word speaks for a kind of question. The weights of a question's words are summed by kind,
what the question names adds to them (one tag, two tags, a type of item), and of the kinds that have what they work on
the heaviest wins. All of it is array functions over a column of questions, and one join with the known tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.checkpoints import cut

#: Words that are broadcast at most.
FEW = 50_000
# What items are called. A plural ends in s.
TYPE_NAMES = {
    "heat exchanger": "heat_exchanger",
    "relief valve": "relief_valve",
    "safety valve": "relief_valve",
    "check valve": "check_valve",
    "non-return valve": "check_valve",
    "psv": "relief_valve",
    "compressor": "compressor",
    "instrument": "instrument",
    "vessel": "vessel",
    "drum": "vessel",
    "tank": "tank",
    "pump": "pump",
    "valve": "valve",
    "line": "line",
}
#: How much a word speaks for a kind, from 1, a hint, to 9, which hardly anything else outweighs.
WEIGHTS = {
    "count": {"many": 9, "count": 9, "number": 8, "total": 6, "quantity": 8, "tally": 9, "counts": 9, "amount": 6},
    "path": {"path": 6, "paths": 6, "route": 6, "routes": 6, "reach": 5, "reaches": 5, "between": 5, "way": 3, "to": 2, "towards": 3, "via": 3, "get": 1, "link": 2},
    "downstream": {"downstream": 8, "feed": 6, "supply": 5, "discharge": 5, "discharges": 5, "outlet": 4, "leave": 4, "leaves": 4, "go": 5, "goes": 5, "flow": 3, "end": 3, "where": 2, "after": 4, "drain": 4, "receives": 5},
    "upstream": {"upstream": 8, "feeds": 6, "fed": 6, "supplies": 6, "supplied": 5, "source": 6, "sources": 6, "origin": 6, "flows": 3, "into": 3, "come": 4, "comes": 4, "from": 2, "inlet": 4, "before": 4},
    "relief": {"relief": 5, "protected": 6, "overpressure": 6, "protection": 5, "overpressured": 6, "relieved": 6, "relieves": 6, "flare": 4, "protects": 6},
    "neighbours": {"connected": 6, "connects": 6, "neighbour": 7, "neighbours": 7, "neighbor": 7, "neighbors": 7, "adjacent": 7, "attached": 6, "around": 5, "near": 4, "nearby": 4, "beside": 5, "next": 3, "touching": 5, "joined": 5},
    "list": {"list": 5, "show": 2, "all": 2, "every": 3, "each": 2, "which": 2, "find": 2, "what": 1, "name": 2, "enumerate": 5, "give": 1, "are": 1, "there": 1},
    "info": {"about": 3, "describe": 5, "description": 5, "info": 5, "information": 5, "details": 5, "detail": 5, "tell": 2, "is": 1, "what": 1, "explain": 4, "properties": 5},
}
#: What a question names: two tags speak for a way between them, a type without a tag for a list, a tag with hardly a word for that item.
TWO_TAGS, BARE_TYPE, BARE_TAG, LEAST = 7, 4, 4, 4


def _words(question: Column) -> Column:
    """The words of a question in lower case, in their order."""
    return F.filter(F.transform(F.split(F.lower(question), r"[^\p{L}\p{N}_-]+"), lambda w: F.trim(w, F.lit("-"))), lambda w: w != "")


def _told_apart(word: Column) -> Column:
    """Whether a word has a digit: it may be a tag, and is none of those that weigh or name a type."""
    return word.rlike(r"\p{N}")


def _weight(words: Column, kind: str) -> Column:
    """What the words together weigh for a kind."""
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS[kind].items() for x in pair])
    return F.aggregate(words, F.lit(0), lambda total, w: total + F.coalesce(F.element_at(weights, w), F.lit(0)))


def _type(names: Column) -> Column:
    """The type of item that a question names; of several the one with the longer name, then the first of ``TYPE_NAMES``."""
    ranked = sorted(TYPE_NAMES, key=lambda n: -n.count(" "))
    named = [F.when(F.arrays_overlap(names, F.array(F.lit(n), F.lit(f"{n}s"))), F.lit(TYPE_NAMES[n])) for n in ranked]
    return F.coalesce(*named)


def mentioned(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """question_id, tags in the order of mention, unsure: a word with a digit is a mention of the tag that it spells
    whole, else of the one tag that ends in it after a hyphen; where several do, it is unsure, and the first and the last
    of them are told."""
    words = cut(questions.select("question_id", F.posexplode(_words(F.col("question"))).alias("pos", "word")).where(_told_apart(F.col("word"))))
    # only tags that are said are sorted by their words
    whole = nodes.select("tag", F.lower("tag").alias("word")).join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.max("tag").alias("exact"))
    read = cut(words.join(whole, "word", "left"))
    # only words that spell no tag whole are looked for at the ends of tags, at ends of as many parts as they have
    rest = cut(read.where("exact is null").select("word").distinct())
    size, lengths = rest.agg(F.count(F.lit(1)), F.collect_set(F.size(F.split("word", "-")))).first()
    tails = F.array(*[F.substring_index("whole", "-", -k) for k in sorted(lengths)]).cast("array<string>")
    ends = nodes.select("tag", F.lower("tag").alias("whole")).select("tag", "whole", F.explode(tails).alias("word")).where("word <> whole").select("tag", "word")
    ends = ends.join(F.broadcast(rest) if size <= FEW else rest, "word", "left_semi")
    ends = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("tag").alias("least"), F.max("tag").alias("most"))
    told = lambda df: df.select("question_id", "pos", F.coalesce("exact", F.when(F.col("n") == 1, F.col("least"))).alias("tag"), F.when(F.col("exact").isNull() & (F.col("n") > 1), F.struct("word", "n", "least", "most")).alias("unsure"))
    spelt = read.where("exact is not null").select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("least"), F.lit(None).cast("string").alias("most"))
    found = told(spelt)
    read = found.union(told(read.where("exact is null").join(ends, "word"))) if size else found
    listed = read.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("found"), F.collect_list("unsure").alias("unsure"))
    tags = F.array_distinct(F.filter(F.transform("found", lambda x: x["tag"]), lambda t: t.isNotNull()))
    return listed.select("question_id", tags.alias("tags"), "unsure")


def intents(questions: DataFrame, nodes: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """question_id, kind, tag, target, equipment_type, unsure for questions(question_id, question).

    kind is null where no words weigh enough, "no tag" where the heaviest kind lacks a tag, and "ambiguous" where a
    mention may be several tags: unsure has those mentions. A null question has no words. ``mentions`` has what is
    ``mentioned``, where that is known already. Questions alike but for their tags are weighed once."""
    found = questions.join(mentioned(questions, nodes) if mentions is None else mentions, "question_id", "left")
    shape = F.transform(_words(F.coalesce("question", F.lit(""))), lambda w: F.when(_told_apart(w), "#").otherwise(w))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    read = cut(found.select("question_id", F.array_join(shape, " ").alias("shape"), tags.alias("tags"), "unsure", F.size(tags).alias("n")))
    shapes = cut(read.select("shape", "n").distinct())
    if shapes.count() <= FEW:
        read = read.join(F.broadcast(_weighed(shapes)), ["shape", "n"])
    else:
        read = _weighed(read)
    kind = F.when(F.size("unsure") > 0, "ambiguous").otherwise(F.col("kind"))
    return read.select("question_id", kind.alias("kind"), F.get("tags", F.lit(0)).alias("tag"), F.when(kind == "path", F.get("tags", F.lit(1))).alias("target"), "equipment_type", "unsure")


def _weighed(shapes: DataFrame) -> DataFrame:
    """``shapes`` (shape, n, ...) with kind and equipment_type: of a question's words, # for one with a digit, and its number of tags."""
    read = shapes.withColumn("words", F.filter(F.split("shape", " "), lambda w: w != ""))
    read = read.withColumn("names", F.concat("words", F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))))
    n, typed = F.col("n"), F.col("equipment_type").isNotNull()
    weigh = lambda kind, extra=0: _weight(F.col("words"), kind) + extra
    needs_tag = lambda kind: F.when(n > 0, kind).otherwise("no tag")
    worth = {  # what a kind weighs, whether it has what it works on, and what it is called
        "count": (weigh("count"), F.lit(True), F.lit("count")),
        "path": (weigh("path", TWO_TAGS), n >= 2, F.lit("path")),
        "downstream": (weigh("downstream"), F.lit(True), needs_tag("downstream")),
        "upstream": (weigh("upstream"), F.lit(True), needs_tag("upstream")),
        "relief": (weigh("relief"), F.lit(True), needs_tag("relief")),
        "neighbours": (weigh("neighbours"), F.lit(True), needs_tag("neighbours")),
        "list": (weigh("list", F.when(n == 0, BARE_TYPE).otherwise(0)), typed, F.lit("list")),
        "info": (weigh("info", F.when(F.size("words") <= 3 * n, BARE_TAG).otherwise(0)), n > 0, F.lit("info")),
    }
    # hints alone are no question
    votes = [F.when(fits & (weight >= LEAST), F.struct(weight.alias("weight"), name.alias("kind"))) for weight, fits, name in worth.values()]
    read = read.withColumn("equipment_type", _type(F.col("names"))).withColumn("kind", F.array_max(F.array(*votes))["kind"])
    return read.select(*shapes.columns, "kind", "equipment_type")
