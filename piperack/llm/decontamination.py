"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned for in training texts.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. An item's windows are its n
consecutive words; an item of fewer words, but not none, is one window. A worker numbers the words that occur in the
benchmark, finds the stretches of such words, looks the rolling hash of each window in them up in the hash set, and
verifies each hit against the window's words.

The benchmark is broadcast in blocks of bounded size, one at a time, whose size is measured first. Each block but the
last has a pass of its own, which writes the hits only; the last pass joins them. So a benchmark of one block, the usual
case, takes one pass without a shuffle, and a larger one takes more passes, never more memory. A task builds the matcher
of its block once and drops it when it ends.

Cases: a null or empty text has no words and no hits; an item without words has no windows; an item without an id
marks words but isn't listed; texts of any length are scanned whole; repeated rows give repeated rows; empty tables
give empty tables or no hits; output columns replace columns of the same names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.llm.shared import kept
from piperack.llm.textcut import raw_rows

#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
FOUND = "struct<n_words:bigint,runs:array<struct<first:int,last:int>>,spans:array<struct<start:int,stop:int>>,items:array<string>>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_RUN = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def words_of(text: bytes | str | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(_TABLE).split()


class Matcher:
    """The windows of a block of the benchmark: their words, numbered, and by length their hashes and item ids."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        self.items: dict[bytes, set[str | None]] = defaultdict(set)
        lengths: dict[int, set[bytes]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
            n = min(len(words), window)
            for i in range(len(words) - n + 1 if n else 0):
                self.items[gram := b" ".join(words[i : i + n])].add(item)
                lengths[n].add(gram)
        self.hashes = {}
        for n, grams in lengths.items():
            ids = np.array([[self.number[w] for w in g.split(b" ")] for g in grams], np.uint64)
            self.hashes[n] = np.unique(self._rolling(ids.ravel(), n)[::n])

    @staticmethod
    def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each n consecutive ids; multiplication wraps."""
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for i in range(n):
            out = out * _BASE + ids[i : len(ids) - n + 1 + i]
        return out

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """For each word if it is hit, and the items whose windows occur."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        hit, items = np.zeros(len(words) + 1, np.int32), set()
        gaps = np.cumsum(np.concatenate(([0], ids == 0)))
        for n, known in self.hashes.items():
            if len(words) < n:
                continue
            starts = np.flatnonzero(gaps[n:] == gaps[:-n])
            if not len(starts):
                continue
            hashed = np.zeros(len(starts), np.uint64)
            for i in range(n):
                hashed = hashed * _BASE + ids[starts + i]
            at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
            for s in starts[known[at] == hashed].tolist():
                if found := self.items.get(b" ".join(words[s : s + n])):  # the words themselves
                    items |= found
                    hit[s] += 1
                    hit[s + n] -= 1
        return np.cumsum(hit[:-1]) > 0, items


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character positions [start, stop) of runs of words."""
    at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    return [(len(text[: at[a][0]].decode()), len(text[: at[b][1]].decode())) for a, b in runs]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[tuple[bool, Broadcast]]:
    """The benchmark in broadcast blocks of about ``block_bytes``, each fetched when it is asked for, and if it is the last."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text")).where(F.length(text) > 0).distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield k == n - 1, benchmark.sparkSession.sparkContext.broadcast([(r.item, bytes(r.text)) for r in block.collect()])


def _scanner(block: Broadcast, window: int):
    """A function that gives FOUND for each text."""

    own: list[Matcher] = []  # a task has its own copy of this list, and what is in it goes with the task

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        if not own:
            own.append(Matcher(block.value, window))
        counts, runs, spans, items = [], [], [], []
        for raw in raw_rows(texts):
            words = words_of(raw)
            hit, found = own[0].find(words)
            counts.append(len(words))
            runs.append(r := _runs(hit))
            spans.append(_spans(raw, r) if r else [])
            items.append(sorted(found - {None}))
        columns = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(columns, names=["n_words", "runs", "spans", "items"])

    return find


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_runs (first and last word of each stretch of hit words), hit_spans (their character
    positions, [start, stop)), n_hit and hit_items (sorted ids of the items with occurring windows)."""
    whole, key = F.coalesce(F.col(text), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    hits = None
    for last, block in _blocks(benchmark, item, item_text, block_bytes):
        find = _scanner(block, window)
        if last:
            found = docs.withColumn("__found", find(whole))
            break
        one = docs.select(key.alias("__key"), find(whole).alias("f")).where(F.size("f.runs") > 0).select("__key", "f.runs", "f.spans", "f.items")
        one = kept(one.dropDuplicates(["__key"]))
        block.unpersist()
        hits = one if hits is None else hits.union(one)
    columns = {"hit_runs": F.col("__found.runs"), "hit_spans": F.col("__found.spans"), "hit_items": F.col("__found.items")}
    if hits is not None:
        lists = hits.groupBy("__key").agg(*[F.flatten(F.collect_list(c)).alias(f"__{c}") for c in ("runs", "spans", "items")])  # a list a block at most
        found = found.withColumn("__key", key).join(lists, "__key", "left")
        both = {new: F.coalesce(F.concat(f"__{c}", f"__found.{c}"), F.col(f"__found.{c}")) for new, c in (("hit_runs", "runs"), ("hit_spans", "spans"), ("hit_items", "items"))}
        columns = {"hit_runs": _union(both["hit_runs"], "first", "last"), "hit_spans": _union(both["hit_spans"], "start", "stop"), "hit_items": F.array_sort(F.array_distinct(both["hit_items"]))}
    found = found.withColumns({"n_words": F.col("__found.n_words")} | columns).drop("__found", "__key", "__runs", "__spans", "__items")
    return found.withColumn("n_hit", F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1))


def _union(intervals: Column, low: str, high: str) -> Column:
    """The union of a list of intervals, as a sorted list of disjoint ones."""
    ordered = F.array_sort(intervals)
    adjacent = 1 if low == "first" else 0

    def add(done: Column, new: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last[low].alias(low), F.greatest(last[high], new[high]).alias(high))
        joins = (F.size(done) > 0) & (new[low] <= F.try_element_at(done, F.lit(-1))[high] + adjacent)
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(ordered, F.expr(f"cast(array() as array<struct<{low}:int,{high}:int>>)"), add)


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` less the characters of ``spans``."""
    kept = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text,
            F.when(i == 0, 0).otherwise(F.try_element_at(spans, i)["stop"]) + 1,
            F.coalesce(F.try_element_at(spans, i + 1)["start"], F.length(text)) - F.when(i == 0, 0).otherwise(F.try_element_at(spans, i)["stop"]),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(kept, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", **options) -> DataFrame:
    """``docs`` without what it shares with the benchmark.

    ``remove="spans"`` cuts the hit stretches out of the texts and drops documents that keep no word;
    ``remove="documents"`` drops every document with a hit. Documents without hits stay as they are, n_chars included.
    """
    found = scan(docs.select("*", F.struct("*").alias("__row")), benchmark, text=text, **options)
    if remove == "documents":
        return found.where("n_hit = 0").select("__row.*")
    if remove != "spans":
        raise ValueError("remove is spans or documents")
    left = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    cut = without_spans(F.col(f"__row.{text}"), F.col("hit_spans"))
    fresh = {text: cut} | ({"n_chars": F.when(F.col("n_hit") > 0, F.length(cut)).otherwise(F.col("__row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return left.select(*[fresh.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM low),
tests AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (SELECT item_id, words[i : i + least(len(words), 10) - 1] AS gram FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM tests WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(gram) AS n FROM windows),
spread AS (SELECT doc_id, n, i, words[i : i + n - 1] AS gram FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes WHERE len(words) >= n)),
hits AS (SELECT doc_id, n, i, item_id FROM spread JOIN windows USING (gram)),
hit_words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
