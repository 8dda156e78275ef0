"""Boosted trees on histograms of quantile bins, grown leaf by leaf, with early stopping on average precision.

Rows stay where they are: each holds the bins of its features and a margin. One aggregate per level sums gradients by (leaf,
feature, bin), combined in each partition before the shuffle; what reaches the driver is bounded by leaves x features x bins.
The best split of a leaf does not depend on other leaves, so the levels are grown in full and the leaf-wise order, best
gain first, is taken afterwards. Gradients are added up as whole numbers, so a fit gives the same trees again.
"""

from collections.abc import Iterator
from dataclasses import dataclass
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from txrisk.operators.metrics import quality_metrics
from txrisk.operators.prefix import running_totals
from txrisk.options import TrainingOptions
from txrisk.schemas import FEATURE_COLS
from txrisk.session import checkpointed

#: Gradients are whole numbers of 2^-20.
UNIT = float(1 << 20)
_ROW = "key long, label double, weight double, is_val boolean, bins binary, margin double"


def bin_edges(rows: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Per column at most `bins` - 1 of its values, ascending: the exact quantiles at 1/bins, 2/bins, ... without the largest
    value. The values of a column are counted and ranked in slices, never in one task."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    hist = rows.select(F.inline(F.array(*cells))).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    upto, total = F.col("n_upto"), F.col("n_total")
    steps = running_totals(hist, ["column"], "value", ["n"]).filter(
        F.expr(f"n_upto * {bins} div n_total > (n_upto - n) * {bins} div n_total") & (upto < total))
    edges: dict[str, list[float]] = {c: [] for c in columns}
    for r in steps.select("column", "value").collect():
        edges[r.column].append(r.value)
    return {c: sorted(v) for c, v in edges.items()}


def binned(rows: DataFrame, columns: list[str], edges: dict[str, list[float]], key: str = "transaction_id") -> DataFrame:
    """(key, label, weight, is_val, bins, margin): the bin of a value is the number of edges below it, a null is in bin 0."""
    cuts = [np.array(edges[c]) for c in columns]

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(columns)), np.uint8)
            for i, c in enumerate(columns):
                value = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                out[:, i] = np.where(np.isnan(value), 0, np.searchsorted(cuts[i], value, "left"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), batch.column("weight"), batch.column("is_val"),
                 pa.array([r.tobytes() for r in out], pa.binary()), pa.array(np.zeros(batch.num_rows))],
                names=["key", "label", "weight", "is_val", "bins", "margin"])

    used = rows.select(F.xxhash64(key).alias("key"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"),
                       "is_val", *[F.col(c).cast("double").alias(c) for c in columns])
    return used.mapInArrow(to_bins, _ROW)


@dataclass
class Tree:
    """A tree as a heap: node i has the children 2i + 1 (value <= edge of `bin`) and 2i + 2; `feature` is -1 at a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        size = 2 ** (depth + 1) - 1
        return Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            own = at[rows]
            at[rows] = 2 * own + 1 + (bins[rows, self.feature[own]] > self.bin[own])
        return at


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)


def _margins(batch: pa.RecordBatch, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    margin = batch.column("margin").to_numpy().copy()
    for tree in trees:
        margin += tree.value[tree.leaves(bins)]
    return margin


def _drawn(keys: np.ndarray, seed: int, share: float) -> np.ndarray:
    """A part of the rows that depends on their keys and the seed alone."""
    x = keys.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(float) < share * (1 << 24)


def level_histogram(rows: DataFrame, trees: list[Tree], tree: Tree, level: int, features: list[int], width: int, base: float,
                    seed: int, subsample: float) -> DataFrame:
    """(node, feature, bin, g, h): summed gradients of the training rows in the open nodes of one level."""
    first = 2 ** level - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 ** level * len(features) * 256
        g_sum, h_sum = np.zeros(size), np.zeros(size)
        for batch in batches:
            bins = _matrix(batch, width)
            keep = ~batch.column("is_val").to_numpy(zero_copy_only=False).astype(bool)
            keep &= _drawn(batch.column("key").to_numpy(), seed, subsample)
            node = tree.leaves(bins) - first
            keep &= node >= 0
            p = 1 / (1 + np.exp(-(_margins(batch, bins, trees) + base)))
            weight = batch.column("weight").to_numpy()
            g = np.rint(weight * (p - batch.column("label").to_numpy()) * UNIT)[keep]
            h = np.rint(weight * p * (1 - p) * UNIT)[keep]
            for i, f in enumerate(features):
                cell = (node[keep] * len(features) + i) * 256 + bins[keep, f]
                g_sum += np.bincount(cell, g, size)
                h_sum += np.bincount(cell, h, size)
        at = np.flatnonzero(h_sum)
        place = at >> 8
        yield pa.RecordBatch.from_arrays([
            pa.array(place // len(features) + first, pa.int32()), pa.array(np.array(features)[place % len(features)], pa.int32()),
            pa.array(at & 255, pa.int32()), pa.array(g_sum[at].astype(np.int64)), pa.array(h_sum[at].astype(np.int64))],
            names=["node", "feature", "bin", "g", "h"])

    return rows.mapInArrow(count, "node int, feature int, bin int, g long, h long").groupBy("node", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"))


def split_gains(histogram: DataFrame, ridge: float, least_weight: float) -> DataFrame:
    """(node, feature, bin, gain, g, h, g_left, h_left) of every cut that leaves `least_weight` of hessian on both sides.

    Rows of a bin up to `bin` go to the left; gains are rounded to six digits, so that ties are ties.
    """
    whole = Window.partitionBy("node", "feature")
    upto = whole.orderBy("bin")
    cut = histogram.select(
        "node", "feature", "bin", (F.sum("g").over(upto) / UNIT).alias("g_left"), (F.sum("h").over(upto) / UNIT).alias("h_left"),
        (F.sum("g").over(whole) / UNIT).alias("g"), (F.sum("h").over(whole) / UNIT).alias("h"))
    g_right, h_right = F.col("g") - F.col("g_left"), F.col("h") - F.col("h_left")
    gain = (F.col("g_left") * F.col("g_left") / (F.col("h_left") + ridge) + g_right * g_right / (h_right + ridge)
            - F.col("g") * F.col("g") / (F.col("h") + ridge)) / 2
    return cut.filter((F.col("h_left") >= least_weight) & (h_right >= least_weight)).withColumn("gain", F.round(gain, 6))


def best_splits(gains: DataFrame) -> DataFrame:
    """The best cut of each node: ties go to the first feature, then to the lowest bin."""
    place = F.struct("gain", -F.col("feature"), -F.col("bin"))
    best = F.max_by(F.struct("feature", "bin", "gain", "g", "h", "g_left", "h_left"), place)
    return gains.filter("gain > 0").groupBy("node").agg(best.alias("best")).select("node", "best.*")


def grow_tree(rows: DataFrame, trees: list[Tree], columns: list[str], base: float, round_: int, leaves: int, opts: TrainingOptions) -> Tree:
    """One more tree: levels in full, then the `leaves` leaves that growing by best gain first would give."""
    chosen = np.random.default_rng([opts.seed, round_]).permutation(len(columns))
    features = sorted(int(i) for i in chosen[:max(1, round(len(columns) * opts.column_sample))])
    tree = Tree.empty(opts.depth)
    sums: dict[int, tuple[float, float]] = {}
    for level in range(opts.depth):
        hist = level_histogram(rows, trees, tree, level, features, len(columns), base, opts.seed * 1_000_003 + round_, opts.subsample)
        found = best_splits(split_gains(hist, opts.ridge, opts.min_rows_per_leaf)).collect()
        for r in found:
            tree.feature[r.node], tree.bin[r.node], tree.gain[r.node] = r.feature, r.bin, r.gain
            sums[r.node] = (r.g, r.h)
            sums[2 * r.node + 1] = (r.g_left, r.h_left)
            sums[2 * r.node + 2] = (r.g - r.g_left, r.h - r.h_left)
        if not found:
            break
    split, open_ = set(), {0} if tree.feature[0] >= 0 else set()
    while open_ and len(split) + 1 < leaves:
        node = max(open_, key=lambda i: (tree.gain[i], -i))
        open_ = (open_ - {node}) | {c for c in (2 * node + 1, 2 * node + 2) if tree.feature[c] >= 0}
        split.add(node)
    tree.feature[[i for i in range(len(tree.feature)) if i not in split]] = -1
    for node, (g, h) in sums.items():
        tree.value[node] = -opts.rate * g / (h + opts.ridge)
    return tree


def base_margin(train: DataFrame) -> float:
    """The margin at which a model without trees predicts the weighted share of label 1."""
    sums = train.agg(F.sum(F.col("weight") * F.col("label")).alias("pos"), F.sum("weight").alias("all")).first()
    rate = min(max((sums.pos or 0) / (sums["all"] or 1), 1e-6), 1 - 1e-6)
    return float(np.log(rate / (1 - rate)))


def first_splits(rows: DataFrame, columns: list[str], opts: TrainingOptions, key: str = "transaction_id") -> DataFrame:
    """(node, feature, threshold, gain) of the first tree: one row per split, at most leaves - 1."""
    train = rows.filter(~F.col("is_val"))
    edges = bin_edges(train, columns, opts.bins)
    tree = grow_tree(binned(rows, columns, edges, key), [], columns, base_margin(train), 0, opts.leaves, opts)
    found = [(i, columns[f], float(round(edges[columns[f]][tree.bin[i]], 6)), float(tree.gain[i])) for i, f in enumerate(tree.feature) if f >= 0]
    return rows.sparkSession.createDataFrame(found, "node int, feature string, threshold double, gain double")


def staged_scores(rows: DataFrame, trees: list[Tree], done: int, width: int, base: float) -> DataFrame:
    """(round, label, probability) of the validation rows after each of the trees that are not in their margin yet."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("is_val"))
            bins = _matrix(batch, width)
            margin = batch.column("margin").to_numpy().copy()
            for i, tree in enumerate(trees):
                margin = margin + tree.value[tree.leaves(bins)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, done + i + 1), pa.int32()), batch.column("label"), pa.array(1 / (1 + np.exp(-(margin + base))))],
                    names=["round", "label", "probability"])

    return rows.filter("is_val").mapInArrow(score, "round int, label double, probability double")


def staged_precision(scores: DataFrame) -> DataFrame:
    """(round, pr_auc): average precision after each round, from (round, label, probability)."""
    return quality_metrics(scores, ["round"]).select("round", "pr_auc")


def with_staleness(precision: DataFrame, patience: int) -> DataFrame:
    """`best_round` so far (the first of the best), `stale` rounds since, and `stopped`: whether a round before or this one
    was stale for `patience` rounds. A round without a value is no better than any other."""
    upto = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce("pr_auc", F.lit(-1.0))
    best = F.max(F.struct(value.alias("value"), (-F.col("round")).alias("place"))).over(upto)
    found = precision.withColumn("best_round", -best["place"]).withColumn("stale", F.col("round") - F.col("best_round"))
    return found.withColumn("stopped", F.max(F.col("stale") >= patience).over(upto))


def fit(rows: DataFrame, leaves: int, opts: TrainingOptions = TrainingOptions(), columns: list[str] = FEATURE_COLS,
        key: str = "transaction_id") -> tuple["BoostedTrees", list[tuple[int, float]]]:
    """Fit on rows with `label`, `weight` and `is_val`; returns the model of the best round and (round, average precision).

    Trees are added in chunks; after a chunk the validation rows are scored after each of its trees. The fit ends after `rounds`
    trees or once `patience` rounds brought nothing better. Without validation positives all rounds are kept.
    """
    train = rows.filter(~F.col("is_val"))
    edges = bin_edges(train, columns, opts.bins)
    base = base_margin(train)
    now = checkpointed(binned(rows, columns, edges, key))
    trees: list[Tree] = []
    history: list[tuple[int, float]] = []
    best, stopped = 0, False
    while len(trees) < opts.rounds and not stopped:
        chunk: list[Tree] = []
        while len(chunk) < opts.chunk and len(trees) + len(chunk) < opts.rounds:
            chunk.append(grow_tree(now, chunk, columns, base, len(trees) + len(chunk), leaves, opts))
        scored = staged_precision(staged_scores(now, chunk, len(trees), len(columns), base)).collect()
        history += sorted((r["round"], r["pr_auc"]) for r in scored)
        trees += chunk
        # one row per round, at most `rounds`
        table = now.sparkSession.createDataFrame(history, "round int, pr_auc double").coalesce(1) if history else None
        if table is not None:
            known = with_staleness(table, opts.patience).orderBy("round").collect()
            cut = next((r for r in known if r.stopped), known[-1])
            best, stopped = cut.best_round, bool(cut.stopped)
        if not stopped and len(trees) < opts.rounds:
            now = checkpointed(_moved(now, chunk, len(columns)))
    if all(v is None for _, v in history):
        best = len(trees)
    return BoostedTrees.of(trees[:best], columns, edges, base), history


def _moved(rows: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The rows with the trees in their margin."""
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _margins(batch, _matrix(batch, width), trees)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margin)], names=batch.schema.names)
    return rows.mapInArrow(move, _ROW)


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble as a pipeline stage: adds the probability of label 1 as the column `outputCol`."""

    model = Param(Params._dummy(), "model", "trees, columns, edges and base margin as JSON", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "name of the probability column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str | None = None, outputCol: str = "probability"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(trees: list[Tree], columns: list[str], edges: dict[str, list[float]], base: float) -> "BoostedTrees":
        body = {"columns": columns, "edges": [edges[c] for c in columns], "base": base, "trees": [
            {"feature": t.feature.tolist(), "bin": t.bin.tolist(), "value": t.value.tolist()} for t in trees]}
        return BoostedTrees(model=json.dumps(body), outputCol="probability")

    def trees(self) -> int:
        return len(json.loads(self.getOrDefault(self.model))["trees"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        body = json.loads(self.getOrDefault(self.model))
        edges = [np.array(e) for e in body["edges"]]
        trees = [Tree(np.array(t["feature"]), np.array(t["bin"]), np.array(t["value"]), np.zeros(0)) for t in body["trees"]]
        base = body["base"]

        @pandas_udf("double")
        def probability(*values: pd.Series) -> pd.Series:
            bins = np.zeros((len(values[0]), len(values)), np.uint8)
            for i, v in enumerate(values):
                x = v.to_numpy(dtype=float)
                bins[:, i] = np.where(np.isnan(x), 0, np.searchsorted(edges[i], x, "left"))
            margin = np.full(len(bins), base)
            for tree in trees:
                margin += tree.value[tree.leaves(bins)]
            return pd.Series(1 / (1 + np.exp(-margin)))

        return dataset.withColumn(self.getOrDefault(self.outputCol), probability(*[F.col(c).cast("double") for c in body["columns"]]))
