"""Leaf-wise boosted trees on histograms, grown by Spark tasks that keep their rows.

Values are coded once into at most 255 quantile bins per feature, with one code more for missing
ones. A fit is one Spark job: every task holds the codes of its share of the rows, and all tasks
grow the same trees. To find a split, tasks add up gradient histograms: each gives its own to all
others, and every task draws the same conclusion from the sum. They meet in the shared folder, by
small files; where that is not mounted, by `allGather` of their barrier stage.

- Gradients are whole multiples of a power of two, small enough that sums stay exact. So the
  trees do not depend on the number of tasks or the order of rows.
- The number of tasks follows the number of rows. A single task, on up to `ROWS_PER_TASK` rows,
  has nobody to wait for. With several tasks all leaves that may still be split are looked at in
  one exchange, about one per level, since `allGather` takes about a second whatever its size.
- If a task is lost, Spark runs the whole stage again, which gives the same trees.
"""

from __future__ import annotations

import base64
import contextlib
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.models.forest import Forest, probabilities, unpacked
from riskweave.session import scratch_path, store

BINS = 255
MISSING = 255  # the code of a missing value
EDGE_ROWS = 100_000  # distinct rows, about, that quantile edges are read from
ROWS_PER_TASK = 1 << 18
MOST_TASKS = 64  # every task reads all others' histograms
LEAST_HESSIAN = 1e-3
SPARSE = 4  # joint cells per row beyond which features are added up one by one


@dataclass(frozen=True)
class Growth:
    """How trees grow: rounds, step, leaves at most, rows in a leaf at least, penalty on leaves."""

    rounds: int = 200
    learning_rate: float = 0.1
    leaves: int = 31
    smallest: int = 20
    l2: float = 0.0


@dataclass(frozen=True)
class Coded:
    """Rows as codes: `blocks` holds (n, codes, y, w, block), the codes feature by feature, `block`
    a number that stays with them."""

    blocks: DataFrame
    edges: list[np.ndarray]
    rows: int
    positive: float  # weight of the positives
    weight: float  # of all rows


def feature_edges(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between the distinct values, or between weighted quantiles where there are too many."""
    known = ~np.isnan(values)
    v, place = np.unique(values[known], return_inverse=True)
    if len(v) > bins:
        below = np.cumsum(np.bincount(place, counts[known]))
        wanted = np.arange(1, bins) / bins * below[-1]
        v = v[np.unique(np.r_[np.searchsorted(below, wanted), len(v) - 1])]
    middle = v[:-1] / 2 + v[1:] / 2
    # the middle of two neighbouring doubles may be the upper one
    return np.where(middle < v[1:], middle, v[:-1])


def coded_rows(df: DataFrame, x: str = "x", y: str = "y", w: str = "w", bins: int = BINS) -> Coded:
    """`df` (x ARRAY<DOUBLE> of one width, null or NaN where missing; y 0 or 1; w the weight)
    written as codes. Edges come from distinct rows chosen by their hash, all of them up to
    EDGE_ROWS, so they depend neither on partitions nor on how often a row repeats."""
    slim = df.select(F.col(x).alias("x"), F.col(y).cast("int").alias("y"), F.col(w).cast("double").alias("w"))
    n, positive, weight = slim.agg(
        F.count(F.lit(1)), F.sum(F.when(F.col("y") == 1, F.col("w"))), F.sum("w")
    ).first()
    if not n:
        raise ValueError("no rows to fit on")
    chosen = slim.where(F.pmod(F.xxhash64("x"), F.lit(-(-n // EDGE_ROWS))) == 0)
    seen = chosen.groupBy("x").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if seen.empty:  # many copies of few rows
        seen = slim.groupBy("x").agg(F.count(F.lit(1)).alias("n")).limit(EDGE_ROWS).toPandas()
    sample = np.stack([np.asarray(v, np.float64) for v in seen["x"]])
    counts = seen["n"].to_numpy(np.float64)
    edges = [feature_edges(sample[:, f], counts, bins) for f in range(sample.shape[1])]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            rows = np.stack([np.asarray(v, np.float64) for v in b["x"]])
            codes = [
                np.where(np.isnan(rows[:, f]), MISSING, np.searchsorted(e, rows[:, f], "left"))
                for f, e in enumerate(edges)
            ]
            yield pd.DataFrame(
                {
                    "n": [len(b)],
                    "codes": [np.stack(codes).astype(np.uint8).tobytes()],
                    "y": [b["y"].to_numpy(np.uint8).tobytes()],
                    "w": [b["w"].to_numpy(np.float64).tobytes()],
                }
            )

    blocks = slim.mapInPandas(code, "n int, codes binary, y binary, w binary")
    blocks = store(blocks.withColumn("block", F.monotonically_increasing_id()), "coded")
    return Coded(blocks, edges, int(n), float(positive or 0.0), float(weight))


@dataclass
class _Leaf:
    rows: np.ndarray  # places of this task's rows
    sums: np.ndarray  # histogram over all tasks: (gradient, hessian, rows) x feature x code
    node: int
    gain: float = 0.0
    split: tuple = ()
    children: tuple | None = None
    total: np.ndarray = field(default_factory=lambda: np.zeros(3))


def packs(bits: list[int], most: int = 16) -> list[list[int]]:
    """Features put together so that their codes fill at most `most` bits."""
    out: list[list[int]] = []
    room: list[int] = []
    for f in sorted(range(len(bits)), key=lambda f: -bits[f]):
        at = next((i for i, r in enumerate(room) if r >= bits[f]), len(out))
        if at == len(out):
            out.append([])
            room.append(most)
        out[at].append(f)
        room[at] -= bits[f]
    return out


class _Codes:
    """Codes of rows, some features to a 16-bit number: adding up by it takes one pass for all of
    them. Feature f has the codes up to `known[f]`, and one for missing values behind them."""

    def __init__(self, known: list[int]):
        self.absent = [k + 1 for k in known]
        self.bits = [a.bit_length() for a in self.absent]
        self.packs = packs(self.bits)
        self.place = {}
        for i, pack in enumerate(self.packs):
            shift = 0
            for f in pack:
                self.place[f] = (i, shift)
                shift += self.bits[f]
        self.packed = np.zeros((len(self.packs), 0), np.uint16)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Feature x row to pack x row."""
        out = np.zeros((len(self.packs), codes.shape[1]), np.uint16)
        for f, (i, shift) in self.place.items():
            out[i] |= np.minimum(codes[f], self.absent[f]).astype(np.uint16) << np.uint16(shift)
        return out

    def _own(self, f: int, packed: np.ndarray) -> np.ndarray:
        return (packed >> np.uint16(self.place[f][1])) & np.uint16((1 << self.bits[f]) - 1)

    def column(self, f: int, rows: np.ndarray) -> tuple[np.ndarray, int]:
        """The feature's codes of some rows, and the one that stands for missing."""
        return self._own(f, self.packed[self.place[f][0]].take(rows)), self.absent[f]

    def histogram(self, rows: np.ndarray | None, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(gradient, hessian, rows) x feature x code."""
        out = np.zeros((3, len(self.absent), 256))

        def put(of: np.ndarray, f: int, sums: np.ndarray) -> None:
            absent = self.absent[f]
            of[f, :absent] = sums[:absent]
            of[f, MISSING] = sums[absent]

        for packed, pack in zip(self.packed, self.packs):
            held = packed if rows is None else packed.take(rows)
            cells = 1 << sum(self.bits[f] for f in pack)
            if len(held) < cells // SPARSE:  # joint sums would be mostly empty
                for f in pack:
                    at = self._own(f, held).astype(np.intp)
                    for of, weight in zip(out, (g, h, None)):
                        put(of, f, np.bincount(at, weight, 1 << self.bits[f]))
                continue
            at = held.astype(np.intp)
            for of, weight in zip(out, (g, h, None)):
                joint = np.bincount(at, weight, cells).astype(np.float64, copy=False)
                for f in pack:  # the first has the lowest bits
                    joint = joint.reshape(-1, 1 << self.bits[f])
                    put(of, f, np.ones(len(joint)) @ joint)
                    joint = joint @ np.ones(joint.shape[1])
        return out


class _Grower:
    """One task's part in growing trees. `add_up` gives the sum of an array over all tasks."""

    def __init__(self, codes: _Codes, growth: Growth, scale: float, add_up: Callable, alone: bool):
        self.codes, self.growth, self.scale = codes, growth, scale
        self.add_up, self.alone = add_up, alone

    def _histogram(self, rows: np.ndarray | None) -> np.ndarray:
        if rows is None:
            return self.codes.histogram(None, self.g, self.h)
        return self.codes.histogram(rows, self.g.take(rows), self.h.take(rows))

    def _best_split(self, leaf: _Leaf) -> None:
        """The split with the largest gain: (feature, code, missing left); none, no gain."""
        grow, one = self.growth, 1.0 / self.scale
        sums = leaf.sums
        leaf.total = total = sums[:, 0].sum(axis=1)
        if total[2] < 2 * grow.smallest:
            return
        missing = sums[:, :, MISSING : MISSING + 1]
        left = sums[:, :, : BINS - 1].cumsum(axis=2)
        left = np.stack([left, left + missing], axis=1)  # missing right, missing left
        right = total[:, None, None, None] - left
        good = (left[2] >= grow.smallest) & (right[2] >= grow.smallest)
        left[:2] *= one
        right[:2] *= one
        good &= (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
        if not good.any():
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + grow.l2) + right[0] ** 2 / (right[1] + grow.l2)
        gain = np.where(good, gain, -np.inf)
        best = int(gain.argmax())
        way, f, code = np.unravel_index(best, gain.shape)
        own = gain[way, f, code] - (total[0] * one) ** 2 / (total[1] * one + grow.l2)
        if own > 1e-12:
            to_left = bool(way)
            if not missing[2, f, 0]:  # none to learn from: with the larger side
                to_left = bool(left[2, way, f, code] > right[2, way, f, code])
            leaf.gain, leaf.split = float(own), (int(f), int(code), to_left)

    def _expand(self, leaves: list[_Leaf]) -> None:
        """Children of all `leaves`, from one exchange of the smaller child's histograms."""
        parts, smaller = [], []
        for leaf in leaves:
            f, code, to_left = leaf.split
            column, absent = self.codes.column(f, leaf.rows)
            goes = (column <= code) & (column != absent)
            if to_left:
                goes |= column == absent
            left = leaf.sums[2, f, : code + 1].sum() + (leaf.sums[2, f, MISSING] if to_left else 0)
            first = left <= leaf.total[2] - left
            parts.append((leaf.rows[goes], leaf.rows[~goes], first))
            smaller.append(self._histogram(parts[-1][0] if first else parts[-1][1]))
        sums = self.add_up(np.stack(smaller))
        for leaf, (left, right, first), own in zip(leaves, parts, sums):
            other = leaf.sums - own
            pair = (own, other) if first else (other, own)
            leaf.children = (_Leaf(left, pair[0], -1), _Leaf(right, pair[1], -1))
            for child in leaf.children:
                self._best_split(child)

    def tree(self, g: np.ndarray, h: np.ndarray, margin: np.ndarray) -> list[tuple]:
        """Nodes (feature, code, missing left, left, right, value, rows) of one tree, the leaf
        with the largest gain split first. Adds its values to `margin`."""
        self.g, self.h = g, h
        root = _Leaf(np.arange(len(g), dtype=np.int32), self.add_up(self._histogram(None)[None])[0], 0)
        self._best_split(root)
        nodes, made, leaves = [root], 1, [root]
        inner: dict[int, tuple[int, int]] = {}
        while made < self.growth.leaves:
            open_ = [k for k in leaves if k.split]
            if not open_:
                break
            best = max(open_, key=lambda k: (k.gain, -k.node))
            if best.children is None:
                room = self.growth.leaves - made
                ahead = sorted((k for k in open_ if k.children is None), key=lambda k: (-k.gain, k.node))
                self._expand([best] if self.alone else ahead[:room])
            for child in best.children:
                child.node = len(nodes)
                nodes.append(child)
            inner[best.node] = (best.children[0].node, best.children[1].node)
            leaves = [k for k in leaves if k is not best] + list(best.children)
            made += 1
        grow, one = self.growth, 1.0 / self.scale
        out = []
        for k in nodes:
            below = k.total[1] * one + grow.l2
            value = -grow.learning_rate * k.total[0] * one / below if below > 0 else 0.0
            if k.node in inner:
                out.append((*k.split, *inner[k.node], 0.0, int(k.total[2])))
            else:
                out.append((0, 0, False, -1, -1, float(value), int(k.total[2])))
                margin[k.rows] += value
        return out


def _exchange(tasks: int, folder: str, used: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Sums (leaf x 3 x feature x code) over all tasks. Only the codes in use are sent, as whole
    numbers below 2^53."""
    if tasks == 1:
        return lambda own: own
    context = BarrierTaskContext.get()
    place = _meeting_place(context, folder)
    swap = _by_message(context) if place is None else _by_file(place, context.partitionId(), tasks)

    def add_up(own: np.ndarray) -> np.ndarray:
        total = np.zeros(own.shape)
        total[:, :, used] = swap(own[:, :, used].astype(np.int64))
        return total

    return add_up


def _by_message(context: BarrierTaskContext) -> Callable[[np.ndarray], np.ndarray]:
    """By Spark's `allGather`, which takes about a second whatever is sent."""

    def swap(own: np.ndarray) -> np.ndarray:
        total = np.zeros(own.shape, np.int64)
        for text in context.allGather(base64.b64encode(zlib.compress(own.tobytes(), 1)).decode()):
            total += np.frombuffer(zlib.decompress(base64.b64decode(text)), np.int64).reshape(own.shape)
        return total

    return swap


def _by_file(place: str, rank: int, tasks: int) -> Callable[[np.ndarray], np.ndarray]:
    """By one file per task and exchange. Two exchanges' files exist at a time: who wrote one has
    read the one before."""
    step = 0

    def swap(own: np.ndarray) -> np.ndarray:
        nonlocal step
        _put(f"{place}/{step}-{rank}", own.tobytes())
        total = own.copy()
        for other in range(tasks):
            if other != rank:
                total += np.frombuffer(_taken(f"{place}/{step}-{other}"), np.int64).reshape(own.shape)
        if step:
            os.remove(f"{place}/{step - 1}-{rank}")
        step += 1
        return total

    return swap


def _put(path: str, data: bytes) -> None:
    """A file that is there as a whole or not at all."""
    with open(f"{path}.part", "wb") as out:
        out.write(data)
    os.rename(f"{path}.part", path)


def _taken(path: str) -> bytes:
    """The file's content, once there is one. If the task that writes it is lost, Spark ends the
    whole stage, and with it this wait."""
    pause = 0.0005
    while True:
        try:
            with open(path, "rb") as given:
                return given.read()
        except FileNotFoundError:
            time.sleep(pause)
            pause = min(pause * 1.5, 0.02)


def _meeting_place(context: BarrierTaskContext, folder: str) -> str | None:
    """A new folder below `folder` for this attempt, if every task can write and all see the
    first one's file there; none where the shared folder is not mounted as a file system."""
    at = urlparse(folder)
    mounted, first = at.scheme in ("", "file"), context.partitionId() == 0
    place = f"{at.path}/{uuid.uuid4().hex}"
    if mounted and first:
        with contextlib.suppress(OSError):
            os.makedirs(place)
            _put(f"{place}/first", b"")
    place = context.allGather(place)[0]
    seen = mounted and os.path.exists(f"{place}/first")
    if seen:
        try:
            _put(f"{place}/joined-{context.partitionId()}", b"")
        except OSError:
            seen = False
    return place if all(context.allGather("seen" if seen else "")) else None


NODE = "tree int, node int, feature int, code int, missing_left boolean, lft int, rgt int, value double, rows long"


def grown(coded: Coded, growth: Growth, tasks: int | None = None) -> Forest:
    """The trees of one fit. What reaches the driver is the model."""
    width, slots = len(coded.edges), coded.blocks.sparkSession.sparkContext.defaultParallelism
    wanted = tasks or min(-(-coded.rows // ROWS_PER_TASK), MOST_TASKS, slots)
    # below this many steps the sum of all weights is a whole number that a double holds
    scale = 2.0 ** (51 - int(np.ceil(np.log2(max(coded.weight, 1.0)))))
    # codes that a row can have: one more than edges, and the one of the missing
    used = np.zeros((width, 256), bool)
    used[:, MISSING] = True
    for f, edges in enumerate(coded.edges):
        used[f, : len(edges) + 1] = True
    known = [len(edges) for edges in coded.edges]
    folder = scratch_path(coded.blocks.sparkSession, "sums")
    rate = coded.positive / coded.weight if coded.weight else 0.0
    rate = min(max(rate, 1e-12), 1 - 1e-12)
    base = float(np.log(rate / (1 - rate)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, parts, ys, ws, first = _Codes(known), [], [], [], True
        for b in batches:
            for n, codes, y, w in zip(b["n"], b["codes"], b["y"], b["w"]):
                parts.append(held.pack(np.frombuffer(codes, np.uint8).reshape(width, n)))
                ys.append(np.frombuffer(y, np.uint8))
                ws.append(np.frombuffer(w, np.float64))
        if parts:
            held.packed = np.concatenate(parts, axis=1)
        y = np.concatenate(ys).astype(np.float64) if ys else np.zeros(0)
        w = np.concatenate(ws) if ws else np.zeros(0)
        grower = _Grower(held, growth, scale, _exchange(wanted, folder, used), wanted == 1)
        if wanted > 1:
            first = BarrierTaskContext.get().partitionId() == 0
        margin = np.full(len(y), base)
        for tree in range(growth.rounds):
            p = probabilities(margin)
            g, h = np.rint(w * (p - y) * scale), np.rint(w * p * (1 - p) * scale)
            nodes = grower.tree(g, h, margin)
            if first:
                out = pd.DataFrame(nodes, columns=["feature", "code", "missing_left", "lft", "rgt", "value", "rows"])
                out.insert(0, "node", range(len(nodes)))
                out.insert(0, "tree", tree)
                yield out

    blocks = coded.blocks.coalesce(1) if wanted == 1 else coded.blocks.repartition(wanted)
    found = blocks.mapInPandas(run, NODE, barrier=wanted > 1).toPandas().sort_values(["tree", "node"], ignore_index=True)
    return _forest(found, coded.edges, base)


def _forest(found: pd.DataFrame, edges: list[np.ndarray], base: float) -> Forest:
    start = np.nonzero(found["node"].to_numpy() == 0)[0]
    shift = np.repeat(start, np.diff(np.r_[start, len(found)]))
    left, right = found["lft"].to_numpy(), found["rgt"].to_numpy()
    feature, code = found["feature"].to_numpy(), found["code"].to_numpy()
    # a code beyond the last edge parts known values from missing ones
    cut = np.array(
        [0.0 if s < 0 else (edges[f][c] if c < len(edges[f]) else np.inf) for f, c, s in zip(feature, code, left)]
    )
    return Forest(
        base,
        start.astype(np.int32),
        feature.astype(np.int32),
        cut,
        found["missing_left"].to_numpy(bool),
        np.where(left < 0, -1, left + shift).astype(np.int32),
        np.where(right < 0, -1, right + shift).astype(np.int32),
        found["value"].to_numpy(np.float64),
        found["rows"].to_numpy(np.int64),
    )


def coded_vectors(dataset: DataFrame, features: str, label: str, weight: str, bins: int = BINS) -> Coded:
    """`coded_rows` of a vector column."""
    x = vector_to_array(F.col(features)).alias("x")
    return coded_rows(dataset.select(x, F.col(label).alias("y"), F.col(weight).alias("w")), bins=bins)


class TreesModel(Model, DefaultParamsWritable, DefaultParamsReadable):
    """Adds `p`, the probability of label 1, from the vector column: `probability` of the sums of
    the trees' values. Saved with its pipeline."""

    probability: Callable[[np.ndarray], np.ndarray]
    featuresCol = Param(Params._dummy(), "featuresCol", "vectors", typeConverter=TypeConverters.toString)
    forest = Param(Params._dummy(), "forest", "packed trees", typeConverter=TypeConverters.toString)

    def trees(self) -> Forest:
        return unpacked(self.getOrDefault("forest"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text, probability = self.getOrDefault("forest"), self.probability

        @F.arrow_udf("double")
        def score(rows):
            import pyarrow as pa

            x = rows.flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(len(rows), -1) if len(rows) else x.reshape(0, 1)
            return pa.array(probability(unpacked(text).margins(x)) if len(rows) else [], pa.float64())

        return dataset.withColumn("p", score(vector_to_array(F.col(self.getOrDefault("featuresCol")))))


class BoosterModel(TreesModel):
    probability = staticmethod(probabilities)


class Booster(Estimator):
    """pyspark.ml estimator of the above on the columns `features`, `is_fraud` and `weight`."""

    def __init__(self, growth: Growth, features: str = "features", label: str = "is_fraud", weight: str = "weight"):
        super().__init__()
        self.growth, self.columns = growth, (features, label, weight)

    def coded(self, dataset: DataFrame) -> Coded:
        return coded_vectors(dataset, *self.columns)

    def fitted(self, coded: Coded) -> BoosterModel:
        model = BoosterModel()
        return model._set(featuresCol=self.columns[0], forest=grown(coded, self.growth).packed())

    def _fit(self, dataset: DataFrame) -> BoosterModel:
        return self.fitted(self.coded(dataset))
