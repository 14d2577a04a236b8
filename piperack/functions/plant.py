"""Fixed vocabulary of plants and studies, and expressions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, which results depend on: equipment types, study parameters, guidewords and which go together.
EQUIPMENT_TYPES = ("vessel", "pump", "compressor", "heat_exchanger", "valve", "check_valve", "control_valve", "relief_valve", "instrument", "line", "tank", "column")
PARAMETERS = ("flow", "pressure", "temperature", "level", "composition", "reaction", "phase")
GUIDEWORDS = ("NO", "MORE", "LESS", "AS_WELL_AS", "PART_OF", "REVERSE", "OTHER_THAN", "EARLY", "LATE", "BEFORE", "AFTER")
PARAMETER_GUIDEWORDS = {
    "flow": ("NO", "MORE", "LESS", "AS_WELL_AS", "PART_OF", "REVERSE", "OTHER_THAN", "EARLY", "LATE", "BEFORE", "AFTER"),
    "pressure": ("NO", "MORE", "LESS", "AS_WELL_AS", "PART_OF", "OTHER_THAN"),
    "temperature": ("NO", "MORE", "LESS", "AS_WELL_AS", "PART_OF", "OTHER_THAN"),
    "level": ("NO", "MORE", "LESS", "AS_WELL_AS", "PART_OF", "OTHER_THAN"),
    "composition": ("NO", "AS_WELL_AS", "PART_OF", "OTHER_THAN"),
    "reaction": ("NO", "MORE", "LESS", "AS_WELL_AS", "REVERSE", "OTHER_THAN", "EARLY", "LATE"),
    "phase": ("AS_WELL_AS", "PART_OF", "OTHER_THAN"),
}
# Words that carry no content in a claim.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "if", "in", "into", "is", "it", "its",
    "may", "of", "on", "or", "per", "possible", "potential", "such", "that", "the", "their", "then", "this", "to", "was", "were", "will", "with",
)
# Types that a relief path can't pass, types that isolate, types that a chain is folded over.
RELIEF_BLOCKING = ("pump", "compressor", "valve", "control_valve")
ISOLATING = ("valve", "control_valve")
IN_LINE = ("valve", "check_valve", "relief_valve")
PASS_THROUGH = ("valve", "check_valve", "relief_valve", "line")


def type_of_tag(tag: Column) -> Column:
    """Equipment type by the letters of a tag such as 2401-K-001; vessel where they say nothing else."""
    letters = F.regexp_extract(tag, r"^\d{4}-([A-Z]+)-\d+", 1)
    named = {"compressor": ("K", "C", "PK"), "vessel": ("V", "F", "D"), "tank": ("T",), "pump": ("P",), "heat_exchanger": ("E",)}
    out = F.lit(None).cast("string")
    for kind, codes in named.items():
        out = F.when(letters.isin(*codes), kind).otherwise(out)
    return F.coalesce(out, F.lit("vessel"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def content_words(text: Column) -> Column:
    """Distinct tokens of over two letters that aren't stop words."""
    return F.filter(F.array_distinct(tokens(text)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def deviation_matrix(spark: SparkSession) -> DataFrame:
    """parameter, guideword and their places, one row for each meaningful pair."""
    rows = [(p, PARAMETERS.index(p), g, GUIDEWORDS.index(g)) for p in PARAMETERS for g in PARAMETER_GUIDEWORDS[p]]
    return spark.createDataFrame(rows, "parameter string, parameter_pos int, guideword string, guideword_pos int")
