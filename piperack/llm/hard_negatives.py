"""Hard-negative mining by dual-tree search: trees over anchors and candidates, whole node pairs pruned at once.

A tree fitted on a bounded sample cuts the space into regions; a region and a class of labels make a cell, and every row
is in one. Anchors of a cell are a group, its other rows candidates. The inner products of a group and a cell lie in an
interval that the centres and radii give. What a group still needs is an interval as well: from the least score that
would improve any of its lists to the largest that any of them admits. A cell whose interval misses that is dropped for
all anchors of the group. Cells are asked in the order of their largest possible scores, in rounds of one, three,
twelve, ...; a round takes along the score of each list's last place so far, and brings back only what betters it.

Within a task both sides get trees of their own, down to leaves: pairs of nodes are pruned by the same rule, and only
pairs of leaves are scored. Cells are split into shards of like size by a hash of the id, anchors into blocks; a shard
goes to the blocks that ask it and to no others, so no task or group grows with the input.

The first search finds each anchor's positives, in cells of its class of labels; the second one fills, for each of
them, a list of the best rows of other labels within a band of the positive's score.

Cases: rows with a null id, label, vector or component, a non-finite component, or another length than the commonest
take no part; an id's rows count once, as the least label, then vector; ties go to the smaller id; anchors without
positives, and positives without negatives in their band, give no rows; a band below a negative score is empty; an empty
table gives an empty one; other columns are left out. Scores are exact up to 2**53, beyond that they are rounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piperack.llm.shared import kept

#: Vectors sampled, classes of labels, levels of the upper tree at most, rows aimed at in a region and held in a shard, anchors in a block, leaves of the lower trees.
SAMPLE, CLASSES, LEVELS, REGION_ROWS, SHARD_ROWS, BLOCK, ANCHOR_LEAF, ROW_LEAF = 10_000, 16, 6, 16_384, 8_192, 4_096, 32, 256


@dataclass
class Regions:
    """A binary tree over a sample, split at medians of the widest component; nodes stand as in a heap."""

    widest: np.ndarray
    middle: np.ndarray
    centres: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.centres)))):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.widest[at]] > self.middle[at])
        return at - (len(self.centres) - 1)


def regions(sample: np.ndarray, levels: int) -> Regions:
    inner = (1 << levels) - 1
    widest, middle, held = np.zeros(max(1, inner), np.int64), np.zeros(max(1, inner)), [sample]
    for k in range(inner):
        x = held[k]
        if len(x) and x.shape[1]:
            widest[k] = np.argmax(x.max(axis=0) - x.min(axis=0))
            middle[k] = np.median(x[:, widest[k]])
            right = x[:, widest[k]] > middle[k]
            held += [x[~right], x[right]]
        else:
            held += [x, x]
    whole = sample.mean(axis=0)
    return Regions(widest, middle, np.array([x.mean(axis=0) if len(x) else whole for x in held[inner:]]))


def lower_tree(x: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray, float, float, int]]:
    """Nodes of a ball tree: rows, centre, radius, norm of the centre, and the first of two children, 0 at a leaf."""
    nodes, todo = [(np.arange(len(x)), 0)], [0]
    links = [0]
    while todo:
        k = todo.pop()
        own = nodes[k][0]
        if len(own) > leaf:
            wide = np.argmax(np.ptp(x[own], axis=0)) if x.shape[1] else 0
            order = own[np.argpartition(x[own, wide], len(own) // 2)] if x.shape[1] else own
            links[k] = len(nodes)
            for part in (order[: len(own) // 2], order[len(own) // 2 :]):
                todo.append(len(nodes))
                nodes.append((np.sort(part), 0))
                links.append(0)
    out = []
    for (own, _), link in zip(nodes, links, strict=True):
        centre = x[own].mean(axis=0)
        out.append((own, centre, float(np.sqrt(((x[own] - centre) ** 2).sum(axis=1).max())), float(np.sqrt((centre**2).sum())), link))
    return out


def _interval(dot, norm_a, radius_a, norm_b, radius_b) -> tuple:
    """Least and largest inner products of two balls, a little widened against rounding."""
    spread = norm_a * radius_b + norm_b * radius_a + radius_a * radius_b
    spread = spread + 1 + 1e-9 * (np.abs(dot) + spread)
    return dot - spread, dot + spread


def search_pair(asked: pa.Table, rows: pa.Table, k: int, same: bool) -> pa.Table:
    """For each list of each anchor, the ``k`` rows of one shard that better it: by a dual-tree walk."""
    schema = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    if not len(asked) or not len(rows):
        return schema.empty_table()
    matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    rows = rows.sort_by("id")
    q, e = matrix(asked), matrix(rows)
    aid, eid = asked.column("anchor").to_numpy(), rows.column("id").to_numpy()
    labels = pa.concat_arrays([asked.column("label").combine_chunks(), rows.column("label").combine_chunks()]).dictionary_encode().indices.to_numpy()
    al, el = labels[: len(q)], labels[len(q) :]
    lists = asked.column("lists").combine_chunks()
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    key, low, high, bound, last = (flat.field(n).to_numpy(zero_copy_only=False).copy() for n in ("key", "low", "high", "bound", "last"))
    need = np.minimum.reduceat(np.maximum(low, bound), first[:-1])
    most = np.maximum.reduceat(high, first[:-1])
    left, right = lower_tree(q, ANCHOR_LEAF), lower_tree(e, ROW_LEAF)
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        ia, ca, ra, na, la = left[i]
        ib, cb, rb, nb, lb = right[j]
        least, largest = _interval(float(ca @ cb), na, ra, nb, rb)
        if largest < need[ia].min() or least > most[ia].max():
            continue
        if la or lb:  # the larger side is opened, and what may score higher is looked at first
            pairs = [(la, j), (la + 1, j)] if la and (not lb or len(ia) * (ROW_LEAF // ANCHOR_LEAF) >= len(ib)) else [(i, lb), (i, lb + 1)]
            stack += sorted(pairs, key=lambda p: float(left[p[0]][1] @ right[p[1]][1]))
            continue
        near = q[ia] @ e[ib].T
        fits = (near >= need[ia][:, None]) & (near <= most[ia][:, None]) & ((al[ia][:, None] == el[ib][None]) == same) & (aid[ia][:, None] != eid[ib][None])
        a, b = np.nonzero(fits)
        if not len(a):
            continue
        n = first[ia[a] + 1] - first[ia[a]]
        of = np.repeat(first[ia[a]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        score, id = np.repeat(near[a, b], n), np.repeat(eid[ib[b]], n)
        better = (score >= low[of]) & (score <= high[of]) & ((score > bound[of]) | (score == bound[of]) & (id < last[of]))
        of, score, id = of[better], score[better], id[better]
        if i in held:
            of, score, id = (np.concatenate(x) for x in zip(held[i], (of, score, id), strict=True))
        order = np.lexsort((id, -score, of))
        of, score, id = of[order], score[order], id[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        ends = rank == k - 1
        bound[of[ends]], last[of[ends]] = score[ends], id[ends]
        held[i] = of[rank < k], score[rank < k], id[rank < k]
        for x in ia:
            need[x] = np.maximum(low[first[x] : first[x + 1]], bound[first[x] : first[x + 1]]).min()
    if not held:
        return schema.empty_table()
    of, score, id = (np.concatenate(x) for x in zip(*held.values(), strict=True))
    anchor = aid[np.searchsorted(first, of, side="right") - 1]
    return pa.table([pa.array(anchor), pa.array(key[of]), pa.array(id), pa.array(score)], schema=schema)


class Mine:
    """The cells of a table and the searches over them."""

    def __init__(self, vectors: DataFrame, anchor: Column, scale: float, id: str, label: str, vector: str):
        spark = self.spark = vectors.sparkSession
        rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"), anchor.alias("anchors"))
        rows = rows.where("id is not null and label is not null and vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        commonest = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        rows = rows.where(F.size("vector") == (commonest[0].n if commonest else 0))
        rows = kept(rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchors")).alias("r")).select("id", "r.*"))
        taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()  # bounded by SAMPLE
        self.empty = not len(taken)
        if self.empty:
            return
        total = rows.count()
        levels = int(min(LEVELS, max(0, np.ceil(np.log2(total / REGION_ROWS)))))
        tree = spark.sparkContext.broadcast(regions(np.floor(scale * taken.flatten().to_numpy(zero_copy_only=False).reshape(len(taken), -1)), levels))
        self.centres, width = tree.value.centres, 1 << levels

        @F.arrow_udf("struct<region:int,distance:double,vector:array<double>>")
        def placed(x: pa.Array) -> pa.Array:
            v = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))
            at = tree.value.of(v)
            away = np.sqrt(((v - tree.value.centres[at]) ** 2).sum(axis=1))
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
            return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(away), whole], names=["region", "distance", "vector"])

        cell = F.pmod(F.xxhash64("label"), F.lit(CLASSES)).cast("int") * width + F.col("p.region")
        self.rows = kept(rows.withColumn("p", placed("vector")).select("id", "label", "anchors", F.col("p.vector").alias("vector"), F.col("p.distance").alias("distance"), cell.alias("cell")))
        count = CLASSES * width
        self.n, self.radius, self.anchors, self.reach = (np.zeros(count) for _ in range(4))
        lead = F.when(F.col("anchors"), F.col("distance"))
        for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)), F.max("distance"), F.count(lead), F.max(lead)).collect():  # CLASSES cells a region at most
            self.n[r[0]], self.radius[r[0]], self.anchors[r[0]], self.reach[r[0]] = r[1], r[2], r[3], r[4] or 0
        self.width = width
        self.parts = np.maximum(1, np.ceil(self.n / SHARD_ROWS)).astype(int)
        self.shard = np.concatenate(([0], np.cumsum(self.parts)))[:-1]
        blocks, self.block, self.split = 0, np.zeros(count, int), np.maximum(1, np.ceil(self.anchors / BLOCK)).astype(int)
        filled = 0
        for g in range(count):  # small groups share a block, a large one has blocks of its own
            if filled and filled + self.anchors[g] > BLOCK:
                blocks, filled = blocks + 1, 0
            self.block[g] = blocks
            filled += self.anchors[g]
            if self.split[g] > 1:
                blocks, filled = blocks + self.split[g], 0
        layout = spark.createDataFrame([(c, int(self.shard[c]), int(self.parts[c]), int(self.block[c]), int(self.split[c])) for c in range(count) if self.n[c]], "cell int, shard0 int, parts int, block0 int, split int")
        home = lambda first, parts: (F.col(first) + F.pmod(F.xxhash64("id"), F.col(parts))).cast("int")
        self.rows = kept(self.rows.join(F.broadcast(layout), "cell").select("id", "label", "anchors", "vector", "cell", home("shard0", "parts").alias("shard"), home("block0", "split").alias("block")))

    def leads(self) -> DataFrame:
        """anchor, label, vector, cell, block of the rows that are anchors."""
        return self.rows.where("anchors").select(F.col("id").alias("anchor"), "label", "vector", "cell", "block")

    def cells(self, group: int, same: bool) -> list[tuple[int, float, float]]:
        """Cells with the least and largest scores that anchors of ``group`` may have there, the largest first."""
        low, centre = group % self.width, self.centres[group % self.width]
        norms = np.sqrt((self.centres**2).sum(axis=1))
        found = np.flatnonzero(self.n)
        if same:
            found = found[found // self.width == group // self.width]
        at = found % self.width
        least, most = _interval(self.centres[at] @ centre, norms[low], self.reach[group], norms[at], self.radius[found])
        return sorted(zip(found.tolist(), least.tolist(), most.tolist(), strict=True), key=lambda x: -x[2])

    def search(self, lists: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor, key, id, score, rank: the best ``k`` rows of each list; ``lists`` has anchor, label, vector, cell, block and
        lists, an array of key, low and high. ``same``: of the anchor's label or of others."""
        spark = self.spark
        queues = {g: self.cells(g, same) for g in range(len(self.n)) if self.anchors[g]}
        order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "id")
        best, count = spark.createDataFrame([], "anchor long, key long, id long, score double, rank int"), 1
        first = True
        while queues:
            each = lists.select("anchor", "label", "vector", "cell", "block", F.explode("lists").alias("x")).select("anchor", "label", "vector", "cell", "block", "x.*")
            if first:
                each = each.withColumn("bound", F.lit(float("-inf"))).withColumn("last", F.lit(0).cast("long"))
            else:
                ends = best.where(F.col("rank") == k).select("anchor", "key", F.col("score").alias("bound"), F.col("id").alias("last"))
                each = each.join(ends, ["anchor", "key"], "left").fillna({"bound": float("-inf"), "last": 0})
            each = kept(each)
            pairs = []
            for r in each.groupBy("cell").agg(F.min(F.greatest("low", "bound")), F.max("high")).collect():  # a row a group, as many as cells at most
                queue = [x for x in queues.get(r[0], ()) if x[2] >= r[1] and x[1] <= r[2]]  # a cell that misses what the group needs goes for all its anchors
                pairs += [(r[0], c, int(self.shard[c]), int(self.parts[c])) for c, _, _ in queue[:count]]
                queues[r[0]] = queue[count:]
            asking = {p[0] for p in pairs}
            queues = {g: x for g, x in queues.items() if x and g in asking}
            if not pairs:
                break
            paired = spark.createDataFrame(pairs, "cell int, asked int, shard0 int, parts int").select("cell", F.explode(F.sequence("shard0", F.col("shard0") + F.col("parts") - 1)).alias("shard"))
            fields = F.struct("key", "low", "high", "bound", "last")
            grouped = each.groupBy("anchor", "label", "cell", "block").agg(F.first("vector").alias("vector"), F.collect_list(fields).alias("lists"))
            asked = grouped.join(F.broadcast(paired), "cell")
            needed = each.select("cell", "block").distinct().join(F.broadcast(paired), "cell").select("shard", "block").distinct()
            held = self.rows.select("id", "label", "vector", "shard").join(needed, "shard").select(*(F.col(c).alias(c) for c in ("shard", "block", "id", "label", "vector")))  # columns of its own
            near = asked.select("shard", "block", "anchor", "label", "vector", "lists").groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(lambda a, b: search_pair(a, b, k, same), "anchor long, key long, id long, score double")
            best = kept(near.union(best.drop("rank")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            first, count = False, 3 if count == 1 else 4 * count
        return best


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, band: tuple[int, int] = (30, 90), scale: float = 256, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor, a row whose id ``every``
    divides, and each of its ``positives`` nearest rows of the same label, the nearest ``negatives`` rows of other labels
    whose score is within ``band``, in hundredths of the positive's. Scores are inner products of the floors of the
    components times ``scale``."""
    found = Mine(vectors, F.col(id) % every == 0, scale, id, label, vector)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if found.empty:
        return vectors.sparkSession.createDataFrame([], out)
    any_score = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    leads = found.leads()
    own = found.search(leads.withColumn("lists", any_score), positives, same=True)
    bands = F.struct(F.col("id").alias("key"), F.ceil(band[0] * F.col("score") / 100).cast("double").alias("low"), F.floor(band[1] * F.col("score") / 100).cast("double").alias("high"))
    lists = own.groupBy("anchor").agg(F.collect_list(bands).alias("lists"))  # ``positives`` of them at most
    others = found.search(kept(leads.join(lists, "anchor")), negatives, same=False)
    scores = own.select("anchor", F.col("id").alias("key"), F.col("score").cast("long").alias("positive_score"))
    named = [F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score")]
    return others.join(scores, ["anchor", "key"]).select(*named)


#: The same in SQL, over ``embeddings`` with the labels moved as the query moves them.
ORACLE = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
"""
