"""Boosted trees as flat arrays, and two ways to score with them.

`margins` scores a whole batch without walking: for each feature the cuts of all trees are
sorted, and every place between cuts has, for each tree, the mask of leaves that a value there
can still reach. ANDing a row's masks over the features leaves its exit leaf as the lowest bit.
`walked` follows the arrays node by node; it is the plain counterpart.
"""

from __future__ import annotations

import base64
import io
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

MOST_LEAVES = 64  # bits of a mask
ROWS_AT_ONCE = 1024


@dataclass(frozen=True, eq=False)
class Forest:
    """Nodes of all trees, one after the other; `start` has each tree's first node, its root.

    A node with `left` of -1 is a leaf. Values up to `cut` go left; a missing value goes left
    where `missing_left` says so. `count` is the number of train rows that reached the node.
    """

    base: float
    start: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    count: np.ndarray

    def packed(self) -> str:
        out = io.BytesIO()
        arrays = {k: v for k, v in self.__dict__.items() if isinstance(v, np.ndarray)}
        np.savez_compressed(out, base=self.base, **arrays)
        return base64.b64encode(out.getvalue()).decode()

    @property
    def trees(self) -> int:
        return len(self.start)

    def leaves_of(self, tree: int) -> list[int]:
        """Leaf nodes from left to right."""
        out, pending = [], [int(self.start[tree])]
        while pending:
            node = pending.pop()
            if self.left[node] < 0:
                out.append(node)
            else:
                pending += [int(self.right[node]), int(self.left[node])]
        return out

    @cached_property
    def _tables(self):
        """(feature, sorted cuts, masks by place and tree) per used feature, and leaf values."""
        values = np.zeros((self.trees, MOST_LEAVES))
        out_of_left: dict[int, int] = {}  # node to the mask that removes the leaves on its left
        tree_of = np.zeros(len(self.left), np.int64)
        for t in range(self.trees):
            leaves = self.leaves_of(t)
            if len(leaves) > MOST_LEAVES:
                raise ValueError(f"a tree has more than {MOST_LEAVES} leaves")
            values[t, : len(leaves)] = self.value[leaves]
            below = {node: 1 << k for k, node in enumerate(leaves)}

            def reach(node: int, below=below) -> int:
                if node not in below:
                    below[node] = reach(int(self.left[node])) | reach(int(self.right[node]))
                return below[node]

            reach(int(self.start[t]))
            for node, mask in below.items():
                tree_of[node] = t
                if self.left[node] >= 0:
                    out_of_left[node] = ((1 << MOST_LEAVES) - 1) & ~below[int(self.left[node])]
        inner = np.nonzero(self.left >= 0)[0]
        tables = []
        for f in np.unique(self.feature[inner]).tolist():
            nodes = inner[self.feature[inner] == f]
            cuts = np.unique(self.cut[nodes])
            # one place more for missing values
            masks = np.full((len(cuts) + 2, self.trees), ~np.uint64(0))
            for node in nodes.tolist():
                # a value at place c is above the first c cuts
                place, mask = int(np.searchsorted(cuts, self.cut[node])), np.uint64(out_of_left[node])
                masks[place + 1, tree_of[node]] &= mask
                if not self.missing_left[node]:
                    masks[-1, tree_of[node]] &= mask
            masks[:-1] = np.bitwise_and.accumulate(masks[:-1], axis=0)
            tables.append((f, cuts, masks))
        return tables, values

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x (rows x features, NaN where missing)."""
        tables, values = self._tables
        flat, offset = values.ravel(), np.arange(self.trees) * MOST_LEAVES
        out = np.full(len(x), self.base)
        if not self.trees:
            return out
        places = []
        for f, cuts, _ in tables:
            place = np.searchsorted(cuts, x[:, f], "left")
            places.append(np.where(np.isnan(x[:, f]), len(cuts) + 1, place))
        one = np.uint64(1)
        for k in range(0, len(x), ROWS_AT_ONCE):
            rows = slice(k, k + ROWS_AT_ONCE)
            mask = np.full((len(out[rows]), self.trees), ~np.uint64(0))
            for (_, _, masks), place in zip(tables, places):
                mask &= masks[place[rows]]
            leaf = np.bitwise_count(~mask & (mask - one))  # zeros below the lowest bit
            out[rows] += flat[leaf + offset].sum(axis=1)
        return out

    def walked(self, x: np.ndarray) -> np.ndarray:
        """The same, node by node and tree by tree."""
        out = np.full(len(x), self.base)
        total = np.zeros((len(x), self.trees))
        for t in range(self.trees):
            node = np.full(len(x), self.start[t])
            while True:
                inner = np.nonzero(self.left[node] >= 0)[0]
                if not len(inner):
                    break
                at = node[inner]
                v = x[inner, self.feature[at]]
                goes_left = np.where(np.isnan(v), self.missing_left[at], v <= self.cut[at])
                node[inner] = np.where(goes_left, self.left[at], self.right[at])
            total[:, t] = self.value[node]
        return out + total.sum(axis=1)


@lru_cache(maxsize=8)
def unpacked(text: str) -> Forest:
    """One copy per Python process of each packed forest."""
    with np.load(io.BytesIO(base64.b64decode(text))) as held:
        return Forest(float(held["base"]), *[held[k] for k in list(Forest.__dataclass_fields__)[1:]])


def probabilities(margins: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margins))
