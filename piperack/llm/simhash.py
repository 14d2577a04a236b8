"""SimHash near-duplicates: exact pairs of 64-bit fingerprints through vantage-point trees.

Of two fingerprints at d bits, one 32-bit half differs by d // 2 bits at most. So each half has a vantage-point tree: a
tree whose leaves follow the count of fingerprints, built from a bounded sample, deals all distinct fingerprints to shards by their Hamming distances
from vantage points. A fingerprint is at home in one shard, and asks every shard that its search ball overlaps by the
triangle bounds. Inside a shard the tree goes on, now built from the shard's own members, down to small leaves, whose
pairs are verified on all 64 bits. A shard returns a spanning forest of its pairs, not the pairs.

Large shards deal their askers over several tasks. Equal fingerprints are one entry everywhere; connected components
run over fingerprints, and documents get their component by a join whose hot keys can be split.

Cases: a null or empty text has fingerprint zero, linked like any other; a document without id gets the smallest id of
its component, or null where no member has one; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.llm.shared import connected_components, kept
from piperack.llm.textcut import raw_rows

#: Fingerprints sampled for the upper trees (at least, and for each shard aimed at), most shards of a tree, members aimed
#: at in a shard, askers in one task. The shards are enough for 10^8 fingerprints; beyond that their own trees grow.
SAMPLE, EACH, SHARDS, MEMBERS, ASKERS = 20_000, 8, 1 << 15, 4096, 200_000
LAST = (1 << 63) - 1


def fingerprint_words(words: list[bytes], size: int) -> int:
    """The fingerprint of a list of words by their shingles of ``size`` words, repeats included."""
    import xxhash

    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        padded = np.zeros((-(-len(bits) // 255) * 255, 64), np.uint8)
        padded[: len(bits)] = bits
        lanes = padded.view(np.uint64).reshape(-1, 255, 8).sum(axis=1)  # 255 bytes of 0 or 1 don't overflow a byte
        ones += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def fingerprint(text: Column, size: int = 3) -> Column:
    """The fingerprint of a text as a long with the same 64 bits."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        values = [fingerprint_words((raw or b"").lower().split(), size) for raw in raw_rows(texts)]
        return pa.array(np.array(values, np.uint64).view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _half(prints: np.ndarray, which: int) -> np.ndarray:
    return (prints >> np.uint64(32) if which else prints & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _split(halves: np.ndarray, radius: int) -> tuple[int, int] | None:
    """A vantage point and a distance that part ``halves`` evenly with few at the boundary; None where nothing parts them."""
    best, chosen = np.inf, None
    for point in halves[np.linspace(0, len(halves) - 1, min(24, len(halves))).astype(int)]:
        shells = np.bincount(np.bitwise_count(halves ^ point), minlength=33)
        inner = np.cumsum(shells)
        for bound in range(32):
            larger = max(inner[bound], len(halves) - inner[bound])
            if larger < len(halves):
                both = shells[max(0, bound - radius + 1) : bound + radius + 1].sum()
                if larger + both < best:
                    best, chosen = larger + both, (int(point), bound)
    return chosen if best < 1.9 * len(halves) else None


def grow(halves: np.ndarray, leaves: int, radius: int) -> list[tuple[int, int, int, int]]:
    """A tree as nodes (vantage point, bound, inner child, outer child); a child below 0 is the leaf with number -child - 1."""
    nodes: list[tuple[int, int, int, int]] = []
    count = 0

    def build(part: np.ndarray, share: int) -> int:
        nonlocal count
        found = _split(part, radius) if share > 1 and len(part) > 1 else None
        if found is None:
            count += 1
            return -count
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        inside = np.bitwise_count(part ^ np.uint32(found[0])) <= found[1]
        nodes[at] = (*found, build(part[inside], share // 2), build(part[~inside], share - share // 2))
        return at

    root = build(halves, leaves)
    return nodes if root == 0 else []


def route(halves: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, leaf and if it is at home there, for each leaf that an entry must ask; ``nodes`` may be empty: one leaf."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0 if nodes else -1, np.arange(len(halves)), np.ones(len(halves), bool))]
    while todo:
        at, index, home = todo.pop()
        if not len(index):
            continue
        if at < 0:
            out.append((index, -at - 1, home))
            continue
        point, bound, inner, outer = nodes[at]
        far = np.bitwise_count(halves[index] ^ np.uint32(point)).astype(int)
        for child, asks, lives in ((inner, far - radius <= bound, far <= bound), (outer, far + radius > bound, far > bound)):
            todo.append((child, index[asks], (home & lives)[asks]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*((i, np.full(len(i), leaf), h) for i, leaf, h in out), strict=True))


def _close(prints: np.ndarray, askers: np.ndarray, members: np.ndarray, which: int, radius: int, bits: int):
    """Arrays of indices of pairs within ``bits``, leaf by leaf of the shard's own tree."""
    todo = [(askers, members)]
    while todo:
        q, m = todo.pop()
        if not len(q) or not len(m):
            continue
        found = _split(_half(prints[m], which), radius) if len(m) > 128 else None
        if found is None:
            for k in range(0, len(q), step := max(1, (1 << 20) // len(m))):
                a, b = np.nonzero(np.bitwise_count(prints[q[k : k + step], None] ^ prints[m][None]) <= bits)
                yield q[k : k + step][a], m[b]
            continue
        point, bound = np.uint32(found[0]), found[1]
        qd = np.bitwise_count(_half(prints[q], which) ^ point).astype(int)
        md = np.bitwise_count(_half(prints[m], which) ^ point)
        todo += [(q[qd - radius <= bound], m[md <= bound]), (q[qd + radius > bound], m[md > bound])]


def forest(n: int, pairs) -> np.ndarray:
    """For each of n indices the root of its tree, the smallest index that the pairs reach."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        differ = root[a] != root[b]
        for x, y in zip(a[differ].tolist(), b[differ].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        while (deeper := root[root] != root).any():
            root[deeper] = root[root[deeper]]
    return root


def fingerprint_components(prints: DataFrame, bits: int = 3) -> DataFrame:
    """print, component (a struct of the smallest id and its print) for distinct ``prints`` (print, least).

    ``least`` is the smallest id of a print, not null. Prints link at ``bits`` or fewer differing bits.
    """
    radius = bits // 2
    prints = kept(prints)
    total = prints.count()
    leaves = min(SHARDS, -(-total // MEMBERS))
    sample = prints.select("print").orderBy(F.xxhash64("print"), "print").limit(max(SAMPLE, EACH * leaves)).collect()  # bounded by SHARDS
    taken = np.array([r[0] for r in sample], np.int64).view(np.uint64)
    trees = prints.sparkSession.sparkContext.broadcast([grow(_half(taken, k), leaves, radius) for k in (0, 1)])

    @F.arrow_udf("array<int>")
    def shards(values: pa.Array) -> pa.Array:
        own = values.to_numpy(zero_copy_only=False).view(np.uint64)
        index, code = [], []
        for k in (0, 1):
            i, leaf, home = route(_half(own, k), trees.value[k], radius)
            index.append(i)
            code.append((leaf * 2 + k) * 2 + home)
        index, code = np.concatenate(index), np.concatenate(code)
        order = np.argsort(index, kind="stable")
        ends = np.searchsorted(index[order], np.arange(len(own) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order], pa.int32()))

    dealt = prints.select("print", "least", F.explode(shards("print")).alias("code"))
    dealt = dealt.select("print", "least", F.shiftright("code", 1).alias("shard"), F.col("code").bitwiseAND(1).alias("home"))
    large = {r.shard: -(-r["count"] // ASKERS) for r in dealt.groupBy("shard").count().where(F.col("count") > ASKERS).collect()}  # at most two for each of SHARDS
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in large.items() for x in kv]), F.col("shard")), F.lit(1)) if large else F.lit(1)
    own = F.pmod(F.xxhash64("print"), parts.cast("long")).cast("int")
    asks = dealt.select("*", own.alias("part"), F.lit(1).alias("asks"))
    if large:
        lent = dealt.where("home = 1").select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("asks")).where(F.col("part") != own)
        asks = asks.union(lent)

    def search(table: pa.Table) -> pa.Table:
        values = table.column("print").to_numpy().view(np.uint64)
        flag = lambda name: np.flatnonzero(table.column(name).to_numpy())
        which = int(table.column("shard")[0].as_py()) & 1 if len(values) else 0
        root = forest(len(values), _close(values, flag("asks"), flag("home"), which, radius, bits))
        linked = np.flatnonzero(root != np.arange(len(root)))
        take = lambda name, at: table.column(name).take(pa.array(at))
        return pa.table({"pa": take("print", linked), "la": take("least", linked), "pb": take("print", root[linked]), "lb": take("least", root[linked])})

    links = asks.groupBy("shard", "part").applyInArrow(search, "pa bigint, la bigint, pb bigint, lb bigint")
    node = lambda k: F.struct(F.col(f"l{k}").alias("least"), F.col(f"p{k}").alias("print"))
    found = connected_components(links.select(node("a").alias("a"), node("b").alias("b")))
    found = kept(found.select(F.col("node.print").alias("print"), "component"))
    alone = F.struct("least", prints["print"])
    return kept(prints.join(found, "print", "left").select("print", F.coalesce("component", alone).alias("component")))


def components(docs: DataFrame, bits: int = 3, size: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, text_key, print and component of every row of ``docs``."""
    rows = kept(docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_key"), fingerprint(F.col(text), size).alias("print")))
    classes = fingerprint_components(rows.groupBy("print").agg(F.coalesce(F.min("id"), F.lit(LAST)).alias("least")), bits)
    return rows.join(classes, "print", "left").select("id", "text_key", "print", "component")


def digest(found: DataFrame) -> DataFrame:
    least = F.col("component.least")
    return found.select(F.col("id").alias("doc_id"), as_hex(F.col("print")).alias("fingerprint"), F.when(least != LAST, least).alias("component_id"))


def deduplicate(docs: DataFrame, bits: int = 3, size: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and one of the rows that repeat it."""
    found = kept(components(docs, bits, size, text, id).select(F.coalesce("id", F.lit(LAST)).alias("__id"), F.col("text_key").alias("__text"), "component"))
    key = ["__id", "__text"]
    best = kept(found.groupBy("component").agg(F.min(F.struct(*key)).alias("best")).select("best.*"))
    repeated = kept(found.groupBy(*key).count().where("count > 1").join(best, key, "left_semi").select(*key))
    rows = docs.withColumns({"__id": F.coalesce(F.col(id), F.lit(LAST)), "__text": F.xxhash64(text)})
    left = rows.join(best, key, "left_semi")
    if not repeated.isEmpty():
        again = left.join(repeated, key, "left_semi").dropDuplicates(key)
        left = left.join(repeated, key, "left_anti").union(again)
    return left.select(*docs.columns)
