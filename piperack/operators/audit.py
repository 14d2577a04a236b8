"""Audits and event reports: recall, grounding, fabrication, percentiles, omissions, decisions and traceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piperack.checkpoints import cut, stored
from piperack.operators import graph

#: Letters by which keywords are looked for in texts.
LEAD = 3


def rate(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, or ``empty`` where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(empty))


def recall(expected: DataFrame, covered: DataFrame, key: str, by: str) -> DataFrame:
    """by, expected, found, recall for expected(by, key) against covered(key); recall of nothing is 1."""
    there = covered.select(key).distinct().withColumn("there", F.lit(1))
    sums = expected.select(by, key).distinct().join(there, key, "left").groupBy(by).agg(F.count(F.lit(1)).alias("expected"), F.count("there").alias("found"))
    return sums.select(by, "expected", "found", F.round(rate(F.col("found"), F.col("expected"), 1.0), 6).alias("recall"))


def grounding_precision(texts: DataFrame, known: DataFrame) -> DataFrame:
    """references, grounded, precision over texts(tags): the distinct tags of each text, counted over all texts."""
    refs = texts.select(F.explode(F.array_distinct("tags")).alias("tag"))
    there = known.select("tag").distinct().withColumn("there", F.lit(1))
    sums = refs.join(there, "tag", "left").agg(F.count(F.lit(1)).alias("references"), F.count("there").alias("grounded"))
    return sums.select("references", "grounded", F.round(rate(F.col("grounded"), F.col("references"), 1.0), 6).alias("precision"))


def nearest_rank(values: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """by, n, percentile: the ceil(q n)-th smallest value.

    Equal values are counted before anything is gathered, and the values of a group are summed up in ranges: a range is
    one task's, and of the ranges only the sums are looked at together, so no group has all its values in one place."""
    each = values.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("times"))
    cut_ = cut(each.repartitionByRange(by, value).withColumn("range", F.spark_partition_id()))
    ranges = cut_.groupBy(by, "range").agg(F.sum("times").alias("held"))
    before = ranges.withColumns({"before": F.coalesce(F.sum("held").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("held").over(Window.partitionBy(by))})
    want = F.ceil(F.col("n") * q - 1e-9)
    hit = before.where((F.col("before") < want) & (F.col("before") + F.col("held") >= want)).select(by, "range", "before", "n")
    upto = cut_.join(hit, [by, "range"]).withColumn("upto", F.col("before") + F.sum("times").over(Window.partitionBy(by).orderBy(value)))
    found = upto.where(F.col("upto") >= want).groupBy(by, "n").agg(F.min(value).alias("percentile"))
    empty = values.groupBy(by).agg(F.count(value).alias("n")).where("n = 0").select(by, "n", F.lit(None).cast(values.schema[value].dataType).alias("percentile"))
    return found.select(by, "n", "percentile").union(empty)


def fabrication(findings: DataFrame, by: str) -> DataFrame:
    """Counters over findings(by, checked, failed, refused, verified), each with at least one citation."""
    count = lambda c: F.sum(c.cast("long"))
    sums = findings.groupBy(by).agg(
        F.count(F.lit(1)).alias("citation_bearing"),
        count(F.col("checked")).alias("checked"),
        count(F.col("checked") & F.col("failed")).alias("failures"),
        count(F.col("refused")).alias("refused"),
        count(~F.col("refused")).alias("released"),
        count(~F.col("refused") & ~F.col("verified")).alias("unverified"),
    )
    return sums.select("*", F.round(rate(F.col("failures"), F.col("checked"), 0.0), 6).alias("failure_rate"), F.round(rate(F.col("unverified"), F.col("released"), 0.0), 6).alias("unverified_rate"))


def omission_detection(seeded: DataFrame, reported: DataFrame) -> DataFrame:
    """kind, seeded, detected, rate for seeded(kind, label): found only where ``reported`` (kind, label) names it by its own kind."""
    found = seeded.join(reported.select("kind", "label", F.lit(1).alias("hit")).distinct(), ["kind", "label"], "left")
    sums = found.groupBy("kind").agg(F.count(F.lit(1)).alias("seeded"), F.count("hit").alias("detected"))
    return sums.select("kind", "seeded", "detected", F.round(rate(F.col("detected"), F.col("seeded"), 1.0), 6).alias("rate"))


def decisions(events: DataFrame) -> DataFrame:
    """kind, action, n with the totals of either and of all, as nulls, over events(kind, action)."""
    return events.rollup("action", "kind").count().select("action", "kind", F.col("count").alias("n")).union(events.groupBy("kind").count().select(F.lit(None).cast("string"), "kind", "count"))


def latest(events: DataFrame, by: str, order: list[Column], keep: list[str]) -> DataFrame:
    """The last event of each ``by``."""
    ranked = events.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where("__rank = 1").select(by, *keep)


def traceability(items: DataFrame) -> DataFrame:
    """section (null: all), total, progress over items(section, status): done counts 1, partial a half, out of scope nothing."""
    weight = F.when(F.col("status") == "done", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    scoped = F.col("status") != "out_of_scope"
    sums = items.rollup("section").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(scoped, weight)).alias("w"), F.sum(scoped.cast("long")).alias("n"))
    return sums.select("section", "total", F.round(rate(F.col("w"), F.col("n"), 1.0), 3).alias("progress"))


def first_hits(hits: DataFrame, by: str, order: list[str], most: int = 12) -> DataFrame:
    """The first ``most`` hits of each ``by`` in ``order``, with their rank."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def slot_recall(gold: DataFrame, rows: DataFrame) -> DataFrame:
    """label, slot, expected, matched, recall for gold(label, slot, item, match_any) against rows(label, slot, text).

    An item is matched if in some text of its slot all keywords of one of its alternatives stand; recall of nothing is 1.
    """
    items = gold.groupBy("label", "slot", "item").agg(F.flatten(F.collect_list("match_any")).alias("match_any"))
    ways = items.select("label", "slot", "item", F.posexplode("match_any").alias("way", "words")).withColumn("words", F.filter(F.transform("words", F.lower), lambda w: w != ""))
    words = cut(ways.select(F.explode("words").alias("word")).distinct())
    few = words.count() <= graph.FRONTIER
    small = F.broadcast if few else lambda df: df
    # a keyword may stand anywhere in a text, within words and across them, so it is looked for by its first letters
    leads = words.select(F.substring("word", 1, LEAD).alias("lead"), "word")
    texts = stored(rows.select("label", "slot", F.xxhash64("text").alias("text_id"), F.lower("text").alias("text")).where("text is not null").distinct())
    places = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(n) for n in range(1, LEAD + 1)]), lambda n: F.transform(places, lambda i: F.substr(F.col("text"), i, n)))))
    # few leads come to the texts, which aren't shuffled by each of their letters; of many, texts come after their leads
    near = texts.select("label", "slot", "text_id", *(["text"] if few else []), F.explode(grams).alias("lead")).join(small(leads.select("lead").distinct()), "lead", "left_semi")
    near = near if few else near.join(texts, ["label", "slot", "text_id"])
    met = stored(near.join(small(leads), "lead").where(F.contains("text", F.col("word"))).select("label", "slot", "text_id", "word"))
    # an alternative's rarest word leads to the texts, which must have the others too
    counts = met.groupBy("label", "slot", "word").agg(F.count(F.lit(1)).alias("texts"))
    needed = ways.select("label", "slot", "item", "way", F.array_distinct("words").alias("words"), F.explode(F.array_distinct("words")).alias("word")).join(counts, ["label", "slot", "word"], "left")
    rarest = needed.groupBy("label", "slot", "item", "way", "words").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "word")).alias("r")).where("r.texts > 0").select("label", "slot", "item", "way", "words", F.col("r.word").alias("word"))
    single = rarest.where(F.size("words") == 1).select("label", "slot", "item")
    several = rarest.where(F.size("words") > 1).select("label", "slot", "words", "word").distinct().join(met, ["label", "slot", "word"])
    both = several.select("label", "slot", "words", "text_id", F.explode("words").alias("word")).join(met, ["label", "slot", "text_id", "word"]).groupBy("label", "slot", "words", "text_id").agg(F.count(F.lit(1)).alias("n"))
    kept = both.where(F.col("n") == F.size("words")).select("label", "slot", "words").distinct()
    always = ways.where(F.size("words") == 0).select("label", "slot", "item").join(texts.select("label", "slot").distinct(), ["label", "slot"], "left_semi")
    hits = single.union(rarest.join(kept, ["label", "slot", "words"], "left_semi").select("label", "slot", "item")).union(always).distinct().withColumn("hit", F.lit(1))
    found = items.select("label", "slot", "item").join(hits, ["label", "slot", "item"], "left").fillna({"hit": 0})
    sums = found.groupBy("label", "slot").agg(F.count(F.lit(1)).alias("expected"), F.sum("hit").alias("matched"))
    return sums.select("label", "slot", "expected", "matched", F.round(rate(F.col("matched"), F.col("expected"), 1.0), 6).alias("recall"))
