"""Target-distribution importance resampling over hashed n-gram features.

Documents are read in groups of bounded size. A group's words are numbered once, and its distinct features, words and
pairs of neighbouring words, are found by their numbers. Groups send each distinct feature once, with its count, to the
shard that its words name; a shard counts the strings of all groups, hashes each distinct string once to its bucket and
answers every group in the order in which that asked. Buckets are summed, their gains worked out, and joined back
through the answers to the features of each document. So a feature's string crosses a shuffle once for each group of
documents, however many documents hold it, and a frequent feature is no larger to a shard than any other.

A bucket's gain is ``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))`` with s of the S features of
the documents and t of the T features of the target in it. A document's weight is the floored mean of its gains, 0
without features. The draw adds a Gumbel number made of a digest of the id, and takes a share of the highest scores.

Cases: a null or empty text has no words and no features; a document without an id has a weight but no score, takes no
part in the draw and isn't counted for its share; ties of scores go to the smaller id; repeated rows give repeated
rows, which take ranks of their own; texts of any length are read whole, one that is longer than a group is a group of
its own; an empty target has no features, so every gain rests on S alone; an empty table gives an empty one; other
columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piperack.llm.decontamination import _TABLE
from piperack.llm.shared import kept, removed, shared_folder
from piperack.llm.textcut import raw_rows

#: Buckets, bytes of text in a group of documents, distinct features of groups aimed at in a shard.
BUCKETS, GROUP_BYTES, SHARD_FEATURES = 10_000, 12 << 20, 400_000
_ZSTD = pa.Codec("zstd", compression_level=1)
GROUPS = "batch string, ids array<bigint>, lengths array<int>, n_distinct bigint, words binary, n_words_bytes bigint, codes binary, n_codes bigint"


def _packed(raw: bytes | np.ndarray) -> bytes:
    return _ZSTD.compress(bytes(raw) if isinstance(raw, bytes) else raw.tobytes(), asbytes=True)


def _unpacked(blob: bytes, size: int) -> bytes:
    return _ZSTD.decompress(blob, size, asbytes=True) if size else b""


def numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text, the distinct words in order, and the number of each word in turn."""
    flat = np.frombuffer(b" ".join([*texts, b""]).translate(_TABLE), np.uint8)
    inside = np.concatenate(([False], flat != 32, [False]))
    starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
    offsets = np.concatenate(([0], np.cumsum(stops - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat[flat != 32]))])
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return counts, coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()] if len(starts) else np.empty(0, np.int64)


def _pairs(counts: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring words within a text, as one number each, and the text of each pair."""
    text = np.repeat(np.arange(len(counts)), counts)
    same = text[1:] == text[:-1]
    return (codes[:-1] * width + codes[1:])[same], text[1:][same]


def group_documents(texts: DataFrame, id: str | None, text: str) -> DataFrame:
    """Groups of documents, their words numbered."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group() -> pa.RecordBatch:
            counts, words, codes = numbered(held)
            n = len(words) + len(np.unique(_pairs(counts, codes, len(words))[0]))
            joined = b" ".join(words.to_pylist())
            row = {"batch": uuid4().hex, "ids": list(ids), "lengths": counts.tolist(), "n_distinct": n, "words": _packed(joined), "n_words_bytes": len(joined), "codes": _packed(codes.astype(np.int32)), "n_codes": len(codes)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("batch", pa.string()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_distinct", pa.int64()), ("words", pa.binary()), ("n_words_bytes", pa.int64()), ("codes", pa.binary()), ("n_codes", pa.int64())]))

        held: list[bytes] = []
        ids: list[int | None] = []
        size = 0
        for batch in batches:
            for each, found in zip(batch.column(0).to_pylist(), raw_rows(batch.column(1)), strict=True):
                found = found or b""
                if held and size + len(found) > GROUP_BYTES:
                    yield group()
                    held, ids, size = [], [], 0
                held.append(found)
                ids.append(each)
                size += len(found)
        if held:
            yield group()

    return texts.select((F.col(id) if id else F.lit(0)).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(rows, GROUPS)


def _features(row: dict, shards: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a group: words of each text, numbers of words, distinct words, distinct pairs, counts of all features (words
    first), the features' order by shard, where each shard begins, and the place of each pair among the distinct ones."""
    words = pa.array(_unpacked(row["words"], row["n_words_bytes"]).split(b" ") if row["n_codes"] else [], pa.large_binary())
    codes = np.frombuffer(_unpacked(row["codes"], 4 * row["n_codes"]), np.int32).astype(np.int64)
    counts = np.asarray(row["lengths"], np.int64)
    keys, _ = _pairs(counts, codes, len(words))
    pairs, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    totals = np.concatenate((np.bincount(codes, minlength=len(words)), n)).astype(np.int64)
    marks = np.fromiter((zlib.adler32(w) * 2654435761 + len(w) for w in words.to_pylist()), np.uint64, len(words))
    first, second = np.divmod(pairs, max(1, len(words)))
    mixed = np.concatenate((marks, marks[first] * np.uint64(31) + marks[second] * np.uint64(0x9E3779B97F4A7C15)))
    mixed ^= mixed >> np.uint64(29)
    shard = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return counts, codes, words, pairs, totals, order, np.searchsorted(shard[order], np.arange(shards + 1)), place


def _asked(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each group and shard: the features that the group has there, and their counts."""
    schema = pa.schema([("shard", pa.int32()), ("batch", pa.string()), ("features", pa.binary()), ("n_bytes", pa.int64()), ("counts", pa.binary()), ("n", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            _, _, words, pairs, totals, order, begins, _ = _features(row, shards)
            first, second = np.divmod(pairs, max(1, len(words)))
            names = pa.chunked_array([words, pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), pa.scalar(b" ", pa.large_binary()))]).combine_chunks()
            names = names.take(pa.array(order))
            out = []
            for k in np.flatnonzero(np.diff(begins)):
                low, high = int(begins[k]), int(begins[k + 1])
                joined = b"\n".join(names.slice(low, high - low).to_pylist())
                out.append({"shard": int(k), "batch": row["batch"], "features": _packed(joined), "n_bytes": len(joined), "counts": _packed(totals[order[low:high]]), "n": high - low})
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)


ASKED = "shard int, batch string, features binary, n_bytes bigint, counts binary, n bigint"
ANSWERS = "shard int, batch string, buckets binary, n bigint, sums array<struct<bucket:int,n:bigint>>"


def _answered(table: pa.Table, buckets: int) -> pa.Table:
    """Counts the shard's strings over all groups and hashes each once; a row for each group has its features' buckets,
    and the first row the shard's sums."""
    rows = table.to_pylist()
    names = pa.concat_arrays([pa.array(_unpacked(r["features"], r["n_bytes"]).split(b"\n"), pa.large_binary()) for r in rows]).dictionary_encode()
    place = names.indices.to_numpy()
    counts = np.concatenate([np.frombuffer(_unpacked(r["counts"], 8 * r["n"]), np.int64) for r in rows])
    total = np.bincount(place, weights=counts, minlength=len(names.dictionary))  # whole numbers below 2**53
    bucket = np.fromiter((zlib.crc32(x) % buckets for x in names.dictionary.to_pylist()), np.int64, len(names.dictionary))
    sums = np.bincount(bucket, weights=total, minlength=buckets).astype(np.int64)
    each, at, out = bucket[place].astype(np.int32), 0, []
    for k, r in enumerate(rows):
        found = [{"bucket": int(b), "n": int(sums[b])} for b in np.flatnonzero(sums)] if not k else None
        out.append({"shard": r["shard"], "batch": r["batch"], "buckets": each[at : at + r["n"]].astype(np.uint16 if buckets <= 1 << 16 else np.int32).tobytes(), "n": r["n"], "sums": found})
        at += r["n"]
    return pa.Table.from_pylist(out, pa.schema([("shard", pa.int32()), ("batch", pa.string()), ("buckets", pa.binary()), ("n", pa.int64()), ("sums", pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64())])))]))


def answers(groups: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """The dictionary of distinct features, answered to the groups, and its number of shards."""
    shards = max(64, -(-(groups.agg(F.sum("n_distinct")).first()[0] or 0) // SHARD_FEATURES))
    asked = groups.mapInArrow(lambda batches: _asked(batches, shards), ASKED)
    return asked.groupBy("shard").applyInArrow(lambda table: _answered(table, buckets), ANSWERS), shards


def bucket_sums(answered: DataFrame) -> DataFrame:
    """bucket, n: how many features fall in each bucket."""
    return answered.select(F.explode("sums").alias("x")).groupBy("x.bucket").agg(F.sum("x.n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; both tables have a row for each bucket at most."""
    spark = own.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    total = lambda df: F.lit(df.agg(F.sum("n")).first()[0] or 0).cast("double")
    s, t = total(own), total(target)
    both = every.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    ratio = (F.col("t") + 1.0) * (s + float(buckets)) / ((F.col("s") + 1.0) * (t + float(buckets)))
    found = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():  # one row a bucket
        found[r.bucket] = r.gain
    return found


def _weighed(group: pa.Table, answered: pa.Table, shards: int, gain: np.ndarray) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    if not len(group):
        return schema.empty_table()
    row = group.to_pylist()[0]
    counts, codes, words, _, totals, order, begins, place = _features(row, shards)
    kind = np.uint16 if len(gain) <= 1 << 16 else np.int32
    bucket = np.zeros(len(totals), np.int64)
    for shard, found in zip(answered.column("shard").to_pylist(), answered.column("buckets").to_pylist(), strict=True):
        bucket[order[begins[shard] : begins[shard + 1]]] = np.frombuffer(found, kind)
    each, width = gain[bucket].astype(float), len(counts)
    text = np.repeat(np.arange(width), counts)
    sums = np.bincount(text, weights=each[codes], minlength=width)
    _, holder = _pairs(counts, codes, len(words))
    sums += np.bincount(holder, weights=each[len(words) + place], minlength=width)
    n = counts + np.maximum(counts - 1, 0)
    return pa.table([pa.array(row["ids"], pa.int64()), pa.array(counts), pa.array(n), pa.array(sums.astype(np.int64) // np.maximum(n, 1))], schema=schema)


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    spark = docs.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{shared_folder(spark)}/features-{uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path), path

    groups, _ = written(group_documents(docs, id, text))
    asked, shards = answers(groups, buckets)
    answered, _ = written(asked)
    goal, path = written(answers(group_documents(target, None, text), buckets)[0])
    gain = gains(bucket_sums(answered), bucket_sums(goal), buckets)
    removed(spark, path)
    return groups.groupBy("batch").cogroup(answered.select("batch", "shard", "buckets").groupBy("batch")).applyInArrow(lambda a, b: _weighed(a, b, shards, gain), "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``place``, 1, 2, 3, ... in the order given: ranges are sorted each by itself and start after what the
    ranges before hold, so no task sees all rows. Only rows alike in all of ``order`` have to share a range."""
    cut = kept(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before, starts = 0, []
    for r in sorted(cut.groupBy("range").count().collect()):  # one row a partition
        starts.append((r[0], before))
        before += r[1]
    starts = rows.sparkSession.createDataFrame(starts, "range int, before long")
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return cut.withColumn("own", own).join(F.broadcast(starts), "range").withColumn("place", F.col("before") + F.col("own")).drop("range", "own", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank: ``percent`` of the documents of ``least_words`` words are drawn, by the
    highest scores; rank is null for the others."""
    weighed = kept(weights(docs, target, **options))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", F.col("weight") + noise)
    enters = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    entered = scored.where(enters)
    wanted = percent * entered.count() // 100
    drawn = ranked(entered, F.desc("score"), F.asc("doc_id"))
    drawn = drawn.withColumn("rank", F.when(F.col("place") <= wanted, F.col("place")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*out).union(scored.where(~enters).withColumn("rank", F.lit(None).cast("long")).select(*out))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL_FEATURES = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
#: The same in SQL over ``documents`` and ``benchmark``; the checksum is taken bit by bit.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT {_SQL_WORDS} AS w FROM benchmark),
f AS MATERIALIZED (SELECT r, x, count(*) AS n FROM (SELECT r, {_SQL_FEATURES} AS x FROM d) GROUP BY r, x),
g AS MATERIALIZED (SELECT x, count(*) AS n FROM (SELECT {_SQL_FEATURES} AS x FROM b) GROUP BY x),
k AS MATERIALIZED (
  SELECT x, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * octet_length(encode(x))), lambda i: CAST(get_bit(CAST(encode(x) AS BIT), CAST(i - i % 8 + 7 - i % 8 AS INTEGER)) AS BIGINT))),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT x FROM f UNION SELECT x FROM g)
),
s AS (SELECT bucket, sum(n) AS n FROM f JOIN k USING (x) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM g JOIN k USING (x) GROUP BY bucket),
gains AS (
  SELECT CAST(a.bucket AS BIGINT) AS bucket,
    CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * CAST((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS} AS DOUBLE) / ((coalesce(s.n, 0) + 1) * CAST((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM range({BUCKETS}) a(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
v AS (SELECT r, sum(n * gain) AS total FROM f JOIN k USING (x) JOIN gains USING (bucket) GROUP BY r),
z AS (
  SELECT doc_id, len(w) AS n_words, CAST(len(w) + greatest(len(w) - 1, 0) AS BIGINT) AS n_features, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE floor(CAST(total AS DOUBLE) / (2 * len(w) - 1)) END AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN v USING (r)
),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, n_words >= 20 AND doc_id IS NOT NULL AS enters FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY enters ORDER BY score DESC, doc_id) AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN enters AND place <= 25 * (SELECT count(*) FROM y WHERE enters) // 100 THEN place END AS rank FROM o
"""
