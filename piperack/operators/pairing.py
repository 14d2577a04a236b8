"""Heads that face each other, paired one to one in the order of their ids.

A head takes the first free one after it that fits, and on a crowded page that comes soon. So a page's heads are gone
through in turn, each is tried against those in reach of it until one fits, and pairs that nobody takes are never listed.
Each page is a task; a page of more heads than ``AT_ONCE`` is gone through in as many blocks of ids, whose heads without
a partner meet the next block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from piperack.checkpoints import Grown, cut

#: Heads of a page that are gone through at once, those left over from earlier blocks not counted.
AT_ONCE = 1 << 18
#: Heads tried at once: at first, and at most once these don't fit.
TRIED, MOST_TRIED = 64, 1 << 16
# Unlike radii, distances by the radius, and how far a head may open aside.
UNLIKE, FAR, ASIDE = (2.0, 0.15), (0.5, 12.0), 55.0


def _aside(angle: np.ndarray) -> np.ndarray:
    """How far an angle is from zero, either way round."""
    turned = np.fmod(angle, 360.0)
    turned = np.where(turned < 0, np.fmod(turned + 360.0, 360.0), turned)
    return np.minimum(turned, 360.0 - turned)


class _Page:
    """The heads of a page in the order of their ids, and who may be in reach of whom."""

    def __init__(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, opening: np.ndarray):
        self.x, self.y, self.r, self.opening = x, y, r, opening
        self.level = np.frexp(r)[1] - 1.0
        # heads that may fit have radii of the same class or of the next one, so each is known in three
        keys = np.concatenate([np.stack([k, *self._cell(k)], axis=1) for k in (self.level - 1, self.level, self.level + 1)])
        order = np.lexsort(keys.T[::-1])
        new = np.flatnonzero(np.any(np.diff(keys[order], axis=0) != 0, axis=1)) + 1
        own = np.split((order % len(x)).astype(np.int32), new)
        self.cells = {tuple(keys[order[at]].tolist()): places for at, places in zip([0, *new.tolist()], own, strict=True)}
        self.around: dict[tuple, np.ndarray] = {}
        self.at = list(zip(self.level.tolist(), *(c.tolist() for c in self._cell(self.level)), strict=True))

    def _cell(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = FAR[1] * np.exp2(level + 1)  # as wide as the largest reach of a radius class
        return np.floor(self.x / side), np.floor(self.y / side)

    def near(self, k: int) -> np.ndarray:
        """The places of the heads in the cells around the ``k``-th one, in their order."""
        if (found := self.around.get(self.at[k])) is None:
            level, cx, cy = self.at[k]
            keys = {(level, cx + i, cy + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
            found = self.around[self.at[k]] = np.sort(np.concatenate([self.cells[c] for c in keys if c in self.cells]))
        return found

    def first(self, k: int, start: int, free: np.ndarray) -> int:
        """The first free head from ``start`` on that fits the ``k``-th one, -1 without one."""
        near, r = self.near(k), self.r[k]
        at, size = int(np.searchsorted(near, start)), TRIED
        while at < len(near):
            j = near[at : at + size]
            at, size = at + size, min(4 * size, MOST_TRIED)
            j = j[free[j]]
            dx, dy = self.x[j] - self.x[k], self.y[j] - self.y[k]
            d = np.sqrt(dx * dx + dy * dy)
            like = (np.abs(r - self.r[j]) <= max(UNLIKE[0], r * UNLIKE[1])) & (d >= r * FAR[0]) & (d <= r * FAR[1])
            j, axis = j[like], np.degrees(np.arctan2(dy[like], dx[like]))
            fits = (_aside(self.opening[k] - axis) <= ASIDE) & (_aside(self.opening[j] - (axis + 180.0)) <= ASIDE)
            if fits.any():
                return int(j[fits.argmax()])
        return -1


def _paired(table: pa.Table, rest: bool) -> pa.Table:
    """The pairs among a page's heads, and with ``rest`` the heads without a partner, whose b is null."""
    table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("id", "x", "y", "r", "opening")]))
    number = lambda c: table.column(c).to_numpy().astype(float)
    page, n = _Page(*map(number, ("x", "y", "r", "opening"))), len(table)
    rank = pc.rank(table.column("id").combine_chunks(), tiebreaker="dense").to_numpy()
    begin, end = np.searchsorted(rank, rank).tolist(), np.searchsorted(rank, rank, "right").tolist()  # rows of one id are one head
    old = pc.sum(table.column("old")).as_py() or 0  # these come first, and none fits another of them
    free, pairs = np.ones(n, bool), []
    for i in range(n):
        if begin[i] < i or not free[i]:
            continue
        met = [(page.first(k, max(end[i], old), free), k) for k in range(i, end[i])]
        met = [(begin[j], j, k) for j, k in met if j >= 0]
        if met:
            _, j, k = min(met)
            free[i : end[i]] = free[begin[j] : end[j]] = False
            pairs.append((k, j))
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    left = np.flatnonzero(free) if rest else np.empty(0, np.int64)
    one, other = table.take(pa.array(np.concatenate([a, left]))), table.take(pa.array([*b.tolist(), *[None] * len(left)], pa.int64()))
    columns = {"page": one["page"], "a": one["id"], "b": other["id"], "x": one["x"], "y": one["y"], "r": one["r"], "opening": one["opening"]}
    return pa.table(columns | {f"o_{c}": other[c] for c in ("x", "y", "r")})


def _with_rest(table: pa.Table) -> pa.Table:
    return _paired(table, True)


def _pairs_only(table: pa.Table) -> pa.Table:
    return _paired(table, False)


def facing(heads: DataFrame) -> DataFrame:
    """page, a, b, x, y, r, opening, o_x, o_y, o_r: the heads (page, id, x, y, r, opening) that pair, each a with the first b
    after it that fits and is free once all before a have paired. Heads without a place, size or opening pair with none."""
    known = [F.abs(c) < float("inf") for c in ("x", "y", "r", "opening")]
    heads = heads.where(F.col("page").isNotNull() & F.col("id").isNotNull() & known[0] & known[1] & known[2] & known[3])
    heads = cut(heads.select("page", "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "r", "opening")]))
    pages, most = heads.groupBy("page").count().agg(F.count(F.lit(1)), F.max("count")).first()
    blocks = -(-(most or 1) // AT_ONCE)
    if blocks > 1:
        turn = F.rank().over(Window.partitionBy("page").orderBy("id")) - 1
        heads = cut(heads.withColumn("block", F.floor(turn / AT_ONCE)))
    of = {c: heads.schema[c].dataType.simpleString() for c in ("page", "id")}
    schema = f"page {of['page']}, a {of['id']}, b {of['id']}, " + ", ".join(f"{c} double" for c in ("x", "y", "r", "opening", "o_x", "o_y", "o_r"))
    own, found, left = ["page", "id", "x", "y", "r", "opening"], None, None
    for k in range(blocks):
        rows = (heads.where(F.col("block") == k) if blocks > 1 else heads).select(*own, F.lit(False).alias("old"))
        rows = rows if left is None else rows.union(left)
        paired = _with_rest if k + 1 < blocks else _pairs_only  # heads left over from the last block meet nobody
        # by number, so that small pages aren't put into one task
        met = cut(rows.repartition(max(1, min(4 * pages, 2048)), "page").groupBy("page").applyInArrow(paired, schema))
        left = met.where("b is null").select("page", F.col("a").alias("id"), "x", "y", "r", "opening", F.lit(True).alias("old"))
        if found is None:
            found = Grown(met.where("b is not null"))
        else:
            found.add(met.where("b is not null"))
    return found.whole
