"""A random forest grown level by level, one Spark job per level for all trees at once.

Rows are coded once into at most 32 quantile bins per feature (models/boosting.py). At a level every
task walks its blocks of rows down the trees so far and adds up, per open node and for the features
drawn for that node, the weights of both labels in every bin. The sums are shuffled by tree, each
tree's best splits are found where its sums meet, and only the splits reach the driver. Tasks hold
one block of rows and one set of sums, whatever the size of the table.

- Each tree sees each row as often as a Poisson(1) draw says; each node looks at the square root of
  the number of features, drawn without replacement. A single tree sees every row and feature once.
- Draws depend on the seed and the block, and weights are whole multiples of a power of two, small
  enough that sums stay exact. So the trees do not depend on the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from riskweave.models.boosting import ROWS_PER_TASK, Coded, TreesModel, coded_vectors
from riskweave.models.forest import Forest

BINS = 32
LEAST_GAIN = 1e-12
# counts by 16 random bits: Poisson(1) to within 2^-16
_POISSON = np.searchsorted(
    np.cumsum([np.exp(-1.0) / factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)
).astype(np.uint8)

SPLIT = "tree int, node int, feature int, code int, left array<double>, right array<double>, own array<double>"


def drawn(seed: int, block: int, trees: int, n: int) -> np.ndarray:
    """How often each tree (rows) sees each row of a block (columns)."""
    if trees == 1:
        return np.ones((1, n), np.uint8)
    rng = np.random.default_rng((seed & 0xFFFFFFFF, block))
    return _POISSON[rng.integers(0, 1 << 16, (trees, n), np.uint16)]


def looked_at(seed: int, level: int, trees: int, width: int) -> np.ndarray:
    """Features (tree x node of the level x slot) drawn for each node."""
    if trees == 1:
        return np.broadcast_to(np.arange(width), (1, 1 << level, width))
    rng = np.random.default_rng((seed & 0xFFFFFFFF, level, trees))
    order = rng.random((trees, 1 << level, width)).argsort(axis=-1)
    return np.sort(order[..., : int(np.ceil(np.sqrt(width)))], axis=-1)


def best_splits(sums: np.ndarray, features: np.ndarray) -> list[tuple]:
    """Per node with rows: (node, feature, code, left, right, own), feature -1 where no split
    lowers the Gini impurity. `sums` is node x slot x code x label; own, left and right are sums
    per label."""
    own = sums[:, 0].sum(axis=1)
    left = sums.cumsum(axis=2)[:, :, :-1]
    right = own[:, None, None] - left

    def purity(of: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (of**2).sum(axis=-1) / of.sum(axis=-1)

    whole = own.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (purity(left) + purity(right) - purity(own)[:, None, None]) / whole[:, None, None]
    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), gain, -np.inf)
    out = []
    for node in np.nonzero(whole)[0].tolist():
        slot, code = np.unravel_index(int(gain[node].argmax()), gain.shape[1:]) if gain[node].size else (0, 0)
        if gain[node].size and gain[node, slot, code] > LEAST_GAIN:
            pair = left[node, slot, code].tolist(), right[node, slot, code].tolist()
            out.append((node, int(features[node, slot]), int(code), *pair, own[node].tolist()))
        else:
            out.append((node, -1, -1, [], [], own[node].tolist()))
    return out


def _level_sums(
    flat: np.ndarray, n: int, rows: np.ndarray, label: np.ndarray, weight: np.ndarray,
    feature: np.ndarray, code: np.ndarray, features: np.ndarray, level: int, bins: int,
) -> np.ndarray:
    """One tree's sums over one block. `flat` holds the codes feature by feature; nodes are
    numbered 1 for the root, 2k and 2k + 1 for the children of k. Sums are slot x (node, code, label)."""
    start, node = feature * n, np.ones(len(rows), np.intp)
    for depth in range(level):
        if (feature[1 << depth : 2 << depth] < 0).any():  # a leaf, or nothing at all
            inner = np.flatnonzero(feature.take(node) >= 0)
            node, rows, label, weight = node[inner], rows[inner], label[inner], weight[inner]
        at = start.take(node)
        at += rows
        right = flat.take(at) > code.take(node)
        node += node
        node += right
    node -= 1 << level
    place = node * (2 * bins) + label  # behind it comes twice the code
    twice = flat << 1
    out = np.empty((features.shape[1], bins * 2 << level))
    for slot, of_slot in enumerate((features * n).T.copy()):
        at = of_slot.take(node)
        at += rows
        out[slot] = np.bincount(twice.take(at) + place, weight, out.shape[1])
    return out


def grown(coded: Coded, trees: int, depth: int, seed: int, tasks: int | None = None) -> Forest:
    """The trees of one fit; their values add up to the mean share of label 1 in the leaves.
    What reaches the driver is the model."""
    width = len(coded.edges)
    conf = coded.blocks.sparkSession.conf
    most = max(coded.blocks.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
    held = coded.blocks.repartition(tasks or min(-(-coded.rows // ROWS_PER_TASK) * 4, most))
    bins = max(len(e) for e in coded.edges) + 1
    # a tree's drawn weight stays below 2^53 steps
    scale = 2.0 ** (48 - int(np.ceil(np.log2(max(coded.weight, 1.0)))))
    feature = np.full((trees, 2 << depth), -1, np.intp)
    code = np.zeros((trees, 2 << depth), np.uint8)
    sums = np.zeros((trees, 2 << depth, 2))

    def level_splits(level: int) -> pd.DataFrame:
        features = looked_at(seed, level, trees, width).astype(np.intp)
        shape = (features.shape[2], 1 << level, bins, 2)

        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((trees, shape[0], bins * 2 << level))
            for b in batches:
                for n, codes, y, w, block in zip(b["n"], b["codes"], b["y"], b["w"], b["block"]):
                    flat, label = np.frombuffer(codes, np.uint8), np.frombuffer(y, np.uint8).astype(np.intp)
                    weight = np.rint(np.frombuffer(w, np.float64) * scale)
                    for t, often in enumerate(drawn(seed, int(block), trees, int(n))):
                        rows = np.flatnonzero(often.astype(bool))
                        total[t] += _level_sums(
                            flat, int(n), rows, label[rows], weight[rows] * often[rows],
                            feature[t], code[t], features[t], level, bins,
                        )
            yield pd.DataFrame({"tree": range(trees), "sums": [s.tobytes() for s in total]})

        def choose(parts: pd.DataFrame) -> pd.DataFrame:
            tree = int(parts["tree"].iloc[0])
            total = np.zeros(shape)
            for part in parts["sums"]:
                total += np.frombuffer(part, np.float64).reshape(shape)
            found = best_splits(total.swapaxes(0, 1), features[tree])
            out = pd.DataFrame(found, columns=["node", "feature", "code", "left", "right", "own"])
            out["node"] += 1 << level
            out.insert(0, "tree", tree)
            return out

        return held.mapInPandas(add_up, "tree int, sums binary").groupBy("tree").applyInPandas(choose, SPLIT).toPandas()

    for level in range(depth):
        found = level_splits(level)
        for s in found.itertuples():
            sums[s.tree, s.node] = s.own
            if s.feature >= 0:
                feature[s.tree, s.node], code[s.tree, s.node] = s.feature, s.code
                sums[s.tree, 2 * s.node], sums[s.tree, 2 * s.node + 1] = s.left, s.right
        if not (found["feature"] >= 0).any():
            break
    share = coded.positive / coded.weight if coded.weight else 0.0
    return _forest(feature, code, sums / scale, coded.edges, share)


def _forest(
    feature: np.ndarray, code: np.ndarray, sums: np.ndarray, edges: list[np.ndarray], share: float
) -> Forest:
    """Flat arrays of the trees. A tree that drew no row votes as all rows do; `count` is the
    drawn weight, whole."""
    trees = len(feature)
    start, nodes = [], []
    for t in range(trees):
        start.append(len(nodes))
        places, pending = {}, [1]
        while pending:
            k = pending.pop(0)
            places[k] = len(nodes)
            nodes.append((t, k))
            if feature[t, k] >= 0:
                pending += [2 * k, 2 * k + 1]
        for i in range(start[-1], len(nodes)):
            k = nodes[i][1]
            below = sums[t, k].sum()
            if feature[t, k] >= 0:
                f, c = int(feature[t, k]), int(code[t, k])
                nodes[i] = (f, edges[f][c], places[2 * k], places[2 * k + 1], 0.0, below)
            else:
                vote = sums[t, k, 1] / below if below > 0 else share
                nodes[i] = (0, 0.0, -1, -1, vote / trees, below)
    f, cut, left, right, value, count = (np.array(v) for v in zip(*nodes))
    return Forest(
        0.0,
        np.array(start, np.int32),
        f.astype(np.int32),
        cut.astype(np.float64),
        np.zeros(len(nodes), bool),
        left.astype(np.int32),
        right.astype(np.int32),
        value.astype(np.float64),
        np.rint(count).astype(np.int64),
    )


def mean_votes(margins: np.ndarray) -> np.ndarray:
    return np.clip(margins, 0.0, 1.0)


class RandomForestModel(TreesModel):
    """Adds `p`, the trees' mean share of label 1. Saved with its pipeline."""

    hasSummary = False  # as Spark's own classifiers tell
    probability = staticmethod(mean_votes)


class RandomForest(Estimator):
    """pyspark.ml estimator of the above on `features` without missing values, `is_fraud` and `weight`."""

    def __init__(
        self, trees: int, depth: int, seed: int,
        features: str = "features", label: str = "is_fraud", weight: str = "weight",
    ):
        super().__init__()
        self.size, self.seed, self.columns = (trees, depth), seed, (features, label, weight)

    def _fit(self, dataset: DataFrame) -> RandomForestModel:
        found = grown(coded_vectors(dataset, *self.columns, bins=BINS), *self.size, self.seed)
        return RandomForestModel()._set(featuresCol=self.columns[0], forest=found.packed())
