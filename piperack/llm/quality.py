"""Quality classifier: a generalised additive model with pairwise interactions, scored by vectorised bin additions.

Every feature of the whole text is cut into quantile bins. Boosting goes round the features in turn; each step fits a
shallow tree over one feature's bins to the current gradients and adds it, shrunk, to that feature's lookup table.
Then the pairs with the largest remaining gain on a coarse grid get tables of their own the same way. A score is the
logistic function of the sum of the table entries that a text's bins select.

The model is fitted on the driver on at most ``max_rows`` labelled rows, taken in the order of a hash of their ids.
Everything else runs over all rows.

Cases: a null or empty text has the features of an empty one and gets a score; a document labelled twice counts once,
with the lower label, and of an id with different texts the least features do; labels that are null are left out; without labels of both kinds every score is the base rate;
repeated rows give repeated rows; an empty table gives an empty table; output columns replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.llm.textcut import raw_rows

#: Labelled rows to fit on, bins of a feature, bins of a feature in a pair, pairs.
MAX_ROWS, BINS, PAIR_BINS, PAIRS = 20_000, 48, 10, 8
FEATURES = (
    "log_bytes", "log_words", "word_length", "unique_words", "letters", "upper", "digits", "marks", "bars", "bangs", "signs",
    "spaces", "stops", "commas", "lines_per_word", "repeated_lines", "commonest_line", "commonest_word", "longest_word", "lead_capitals",
)


def _class_of_byte() -> np.ndarray:
    """For each byte its classes, as rows: letters, upper, digits, marks, bars, bangs, signs, spaces, stops, commas."""
    out = np.zeros((10, 256))
    for b in range(256):
        c = chr(b)
        letter = b >= 128 or c.isalpha()
        kinds = (letter, "A" <= c <= "Z", "0" <= c <= "9", b < 128 and c.isprintable() and not c.isalnum() and c != " ", c == "|", c in "!?", c in "#$%&*@^~=<>+_{}[]\\/", c in " \t\r\n\v\f", c == ".", c in ",;:")
        out[:, b] = kinds
    return out


_CLASSES = _class_of_byte()


def text_features(raw: bytes) -> list[float]:
    """The features of one whole text."""
    n = max(1, len(raw))
    shares = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    k = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    m = max(1, len(lines))
    capitals = sum(1 for w in words if 65 <= w[0] <= 90)
    head = [np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / k, len(counts) / k**0.8]
    tail = [len(lines) / k, 1 - len(seen) / m if lines else 0.0, max(seen.values(), default=0) / m, max(counts.values(), default=0) / k, max(map(len, words), default=0), capitals / k]
    return [*head, *shares, *tail]


def features(text: Column) -> Column:
    """The features of a text as an array of double, in the order of FEATURES."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        rows = [text_features(raw or b"") for raw in raw_rows(texts)]
        flat = np.array(rows, float).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), pa.array(flat))

    return of(F.coalesce(text, F.lit("")))


def _tree(grad: np.ndarray, weight: np.ndarray, count: np.ndarray, depth: int, least: int = 20) -> np.ndarray:
    """A shallow regression tree over ordered bins, as the value of each bin: Newton steps of its leaves."""
    best, at = 1e-9, None
    if depth and len(grad) > 1:
        g, w, c = np.cumsum(grad)[:-1], np.cumsum(weight)[:-1], np.cumsum(count)[:-1]
        gain = g**2 / (w + 1) + (grad.sum() - g) ** 2 / (weight.sum() - w + 1) - grad.sum() ** 2 / (weight.sum() + 1)
        gain[(c < least) | (count.sum() - c < least)] = 0
        if gain.max(initial=0) > best:
            at = int(gain.argmax()) + 1
    if at is None:
        return np.full(len(grad), grad.sum() / (weight.sum() + 1))
    return np.concatenate([_tree(grad[s], weight[s], count[s], depth - 1, least) for s in (slice(None, at), slice(at, None))])


def _grid(grad: np.ndarray, weight: np.ndarray, count: np.ndarray, least: int = 20) -> tuple[np.ndarray, float]:
    """The best tree with one cut on either axis of a grid, as a value for each cell, and its gain."""
    corner = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, w, c = corner(grad), corner(weight), corner(count)
    i, j = np.meshgrid(np.arange(1, grad.shape[0]), np.arange(1, grad.shape[1]), indexing="ij")
    quarters = lambda x: (x[i, j], x[i, -1] - x[i, j], x[-1, j] - x[i, j], x[-1, -1] - x[i, -1] - x[-1, j] + x[i, j])
    parts = list(zip(quarters(g), quarters(w), quarters(c), strict=True))
    gain = sum(np.where(n >= least, a**2 / (b + 1), 0) for a, b, n in parts) - g[-1, -1] ** 2 / (w[-1, -1] + 1)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(grad)
    areas = ((slice(None, a + 1), slice(None, b + 1)), (slice(None, a + 1), slice(b + 1, None)), (slice(a + 1, None), slice(None, b + 1)), (slice(a + 1, None), slice(b + 1, None)))
    for area, (x, y, n) in zip(areas, parts, strict=True):
        out[area] = x[a, b] / (y[a, b] + 1) if n[a, b] >= least else 0
    return out, float(gain[a, b])


@dataclass
class AdditiveModel:
    """Cuts and lookup tables of features and pairs."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, f], "right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit_model(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 30, rate: float = 0.15) -> AdditiveModel:
    """The model of features ``x`` (rows, features) and labels ``y`` (0 or 1)."""
    rows, width = x.shape if len(y) else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (rows + 1)
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    quantiles = lambda f, n: np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) if rows else np.empty(0)
    model.cuts = [quantiles(f, BINS) for f in range(width)]
    model.pair_cuts = [quantiles(f, PAIR_BINS) for f in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not rows or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    sums = lambda b, v, n: np.bincount(b, v, n)
    counts = [sums(b, None, len(t)) for b, t in zip(bins, model.tables, strict=True)]
    margin = np.full(rows, model.base)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-margin))
            step = rate * _tree(sums(bins[f], y - p, len(table)), sums(bins[f], p * (1 - p), len(table)), counts[f], 2)
            table += step
            margin += step[bins[f]]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.pair_cuts)]
    p = 1 / (1 + np.exp(-margin))
    gains = []
    for a in range(width):
        for b in range(a + 1, width):
            shape = (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)
            if min(shape) > 1:
                cell = coarse[a] * shape[1] + coarse[b]
                grids = [sums(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p), None)]
                gains.append((_grid(*grids)[1], a, b, shape, cell, grids[2]))
    chosen = sorted(gains, key=lambda g: g[:3], reverse=True)[:PAIRS]
    tables = [np.zeros(shape) for _, _, _, shape, _, _ in chosen]
    for _ in range(pair_rounds):
        for table, (_, _, _, shape, cell, n) in zip(tables, chosen, strict=True):
            p = 1 / (1 + np.exp(-margin))
            step = rate * _grid(sums(cell, y - p, table.size).reshape(shape), sums(cell, p * (1 - p), table.size).reshape(shape), n)[0]
            table += step
            margin += step.ravel()[cell]
    model.pairs = [(a, b, t) for t, (_, a, b, *_) in zip(tables, chosen, strict=True)]
    return model


def held_out(id: Column) -> Column:
    """If a row's label is kept from fitting: crc32 of the id as text leaves 1 by 3. A null id is not."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, max_rows: int = MAX_ROWS, least: bool = True) -> DataFrame:
    """Up to ``max_rows`` ids with their label that may be learnt from, in the order of a hash of the id."""
    one = F.min(label) if least else F.max(label)
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(one.cast("int").alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, text: str = "text") -> AdditiveModel:
    """The model of the labelled documents; the ids broadcast and the rows collected number ``max_rows`` at most, texts stay where they are."""
    ids = labelled_sample(labels, label, max_rows)
    rows = docs.select("doc_id", text).join(F.broadcast(ids), "doc_id").select("doc_id", "__label", features(F.col(text)).alias("x"))
    least = F.min(F.struct(F.col("__label").alias("y"), "x")).alias("row")  # of an id with different texts the same one in every run
    found = rows.groupBy("doc_id").agg(least).orderBy("doc_id").select("row.*").toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return fit_model(x, found.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from a score of 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand table entries

    @F.arrow_udf("double")
    def scored(rows: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))))

    return docs.withColumn("score", scored(features(F.col(text)))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without those that the model fitted on their labels predicts to be bad."""
    model = fit(docs, labels, **options)
    kept = score(docs.select("*", F.struct("*").alias("__row")), model)
    return kept.where("predicted = 1").select("__row.*")
