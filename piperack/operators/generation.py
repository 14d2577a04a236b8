"""Findings without a model, safeguards from the graph, samples by a keyed hash, and what a lab measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piperack.operators.audit import rate


def first_sentence(text: Column) -> Column:
    return F.trim(F.split_part(F.coalesce(text, F.lit("")), F.lit("."), F.lit(1)))


def causes(evidence: DataFrame) -> DataFrame:
    """row_id, ordinal, text, confidence: one cause for each excerpt (row_id, ordinal, snippet), surer the more there are."""
    counts = evidence.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))  # joined back, so that no row's excerpts meet in one task
    said = evidence.select("row_id", "ordinal", first_sentence(F.col("snippet")).alias("text")).where("text <> ''")
    return said.join(counts, "row_id").select("row_id", "ordinal", "text", F.round(F.least(F.lit(0.95), 0.4 + 0.15 * F.col("n")), 3).alias("confidence"))


def consequence_confidence(supporting: Column, fallback: Column) -> Column:
    """What a consequence may claim: less where it is the default one, and never under 0.3."""
    base = F.least(F.lit(0.95), 0.4 + 0.15 * supporting)
    return F.round(F.greatest(F.lit(0.3), F.when(fallback, base * 0.6).otherwise(base)), 3)


def relief_safeguard(members: DataFrame, relief: DataFrame) -> DataFrame:
    """node_id, tag, confidence: the first member (node_id, ordinal, tag) with a verified relief path, else with a drawn one."""
    per_tag = relief.groupBy(F.col("start").alias("tag")).agg(F.bool_or("verified").alias("sure"))
    found = members.join(per_tag, "tag").groupBy("node_id").agg(F.min(F.struct((~F.col("sure")).alias("drawn"), "ordinal", "tag")).alias("m"))
    return found.select("node_id", "m.tag", F.when(F.col("m.drawn"), 0.60).otherwise(0.99).alias("confidence"))


def sample(rows: DataFrame, by: str, id: str, n: int, key: str) -> DataFrame:
    """The ``n`` rows of each ``by`` whose keyed hash is smallest: the same ones each time, whatever the order of rows."""
    order = F.md5(F.concat_ws("|", F.lit(key), F.col(id).cast("string")).cast("binary"))
    ranked = rows.withColumn("pick", F.row_number().over(Window.partitionBy(by).orderBy(order, id)))
    return ranked.where(F.col("pick") <= n)


def accuracy(runs: DataFrame, by: str) -> DataFrame:
    """by, questions, kind_right, intent_right, result_right, failed_closed over runs of a translator."""
    share = lambda c: F.round(rate(F.sum(F.col(c).cast("long")), F.count(F.lit(1)), 0.0), 6).alias(c)
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("questions"), share("kind_right"), share("intent_right"), share("result_right"), F.sum(F.col("failed_closed").cast("long")).alias("failed_closed"))


def speed(tokens: Column, nanoseconds: Column) -> Column:
    """Tokens a second; null where no time was measured."""
    return F.try_divide(tokens.cast("double"), nanoseconds / 1e9)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def label_precision(labels: DataFrame, by: str) -> DataFrame:
    """by, accepted, rejected, precision of what people accept or reject; null where neither has been said."""
    sums = labels.groupBy(by).agg(F.sum((F.col("label") == "accept").cast("long")).alias("accepted"), F.sum((F.col("label") == "reject").cast("long")).alias("rejected"))
    return sums.select(by, "accepted", "rejected", F.round(F.try_divide(F.col("accepted").cast("double"), F.col("accepted") + F.col("rejected")), 6).alias("precision"))


def seed_omissions(rows: DataFrame, n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (label, consequences array) with ``n`` gaps, and what was taken out as kind, label.

    A keyed hash picks the rows and, where there are consequences to blank, if they are blanked or the row is dropped: the
    same ones in every run, one gap a row. With fewer rows than ``n`` all have one.
    """
    digest = lambda what: F.md5(F.concat_ws("|", F.lit(f"{key} {what}"), F.col("label").cast("string")).cast("binary"))
    blanks = (F.coalesce(F.size("consequences"), F.lit(0)) > 0) & (F.substring(digest("kind"), 1, 1) >= "8")
    picked = rows.select("label", digest("row").alias("d"), F.when(blanks, "blanked_consequences").otherwise("dropped_row").alias("kind")).orderBy("d", "label").limit(n).select("kind", "label")
    seeded = rows.join(picked.select("label", F.col("kind").alias("__gap")), "label", "left").where("__gap is null or __gap <> 'dropped_row'")
    bare = F.when(F.col("__gap").isNotNull(), F.array().cast(rows.schema["consequences"].dataType)).otherwise(F.col("consequences"))
    return seeded.select(*[bare.alias(c) if c == "consequences" else F.col(c) for c in rows.columns]), picked
