"""Vector codes: parts of integer vectors, each coded by the nearest entry of its codebook.

The nearest entry is found by slicing and intersecting bit masks. For every dimension of a
codebook the entries' coordinates are sorted, and before each place of that order stands the mask
of the entries up to it. An entry within a radius of a part lies within that radius in each
dimension, that is in one range of each order; the two prefix masks at the ends of a range give
its entries, and the ranges' masks are ANDed. With the distance to some entry as the radius, no
nearer entry and no tie can be missed, and exact distances are worked out for the few left.

Codebooks are learnt from all vectors: tasks send the sums and counts of each entry's parts,
and the entries, whose number is a parameter, are the only thing that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import store

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LABEL_PARTS = 64
MOST_ENTRIES = 64  # bits of a mask


class Codebook:
    """Entries of one part position, with the sorted coordinates and prefix masks of each
    dimension."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > MOST_ENTRIES:
            raise ValueError(f"a mask holds at most {MOST_ENTRIES} entries")
        self.entries = entries.astype(np.int64)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, axis=0)
        bits = np.uint64(1) << order.astype(np.uint64)
        none = np.zeros((1, entries.shape[1]), np.uint64)
        self.prefix = np.concatenate([none, np.bitwise_or.accumulate(bits, axis=0)])

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within `radius` of each row of x in every dimension."""
        mask = np.full(len(x), ~np.uint64(0))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.prefix[high, d] ^ self.prefix[low, d]
        return mask

    def nearest(self, x: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, the lower index among equals.

        The first radius is the distance to `guess`; without one, to the entry that is nearest
        in the dimension that spreads the entries most.
        """
        if not len(x) or not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if guess is None:
            guess = self._first_guess(x)
        at = guess.astype(np.int64)
        best = ((x - self.entries[at]) ** 2).sum(axis=1)
        # the root rounded up: the box must hold everything at that distance
        radius = np.sqrt(best.astype(np.float64)).astype(np.int64) + 1
        mask = self.candidates(x, radius)
        for k in range(len(self.entries)):
            rows = np.nonzero((mask >> np.uint64(k)) & np.uint64(1))[0]
            if len(rows):
                found = ((x[rows] - self.entries[k]) ** 2).sum(axis=1)
                better = (found < best[rows]) | ((found == best[rows]) & (k < at[rows]))
                at[rows[better]], best[rows[better]] = k, found[better]
        return at, best

    def _first_guess(self, x: np.ndarray) -> np.ndarray:
        d = int(np.argmax(self.sorted[-1] - self.sorted[0]))
        column = self.sorted[:, d]
        place = np.clip(np.searchsorted(column, x[:, d]), 1, max(len(column) - 1, 1))
        left = np.abs(x[:, d] - column[place - 1])
        right = np.abs(x[:, d] - column[np.minimum(place, len(column) - 1)])
        place = np.where(left <= right, place - 1, np.minimum(place, len(column) - 1))
        return np.argsort(self.entries[:, d], kind="stable")[place]


def part_edges(dim: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts, equal where the length allows it, else the first ones longer by one."""
    small, longer = divmod(dim, parts)
    edges = [0]
    for k in range(parts):
        edges.append(edges[-1] + small + (k < longer))
    return list(zip(edges, edges[1:]))


def integer_vectors(
    df: DataFrame, id_column: str, vector_column: str, label_column: str | None, scale: int = SCALE
) -> DataFrame:
    """(id, label, dim, vec): floor(scale * x) of each component as 32-bit bytes; rows whose
    vector is null or holds a null or non-finite component are left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep, packed = [], []
            for k, v in enumerate(b["vec"]):
                x = np.asarray(v, np.float64)
                if np.isfinite(x).all():
                    x = np.floor(scale * x)
                    # squared distances of such vectors stay below 2^63
                    if x.size and np.abs(x).max() * np.sqrt(x.size) >= 2.0**30:
                        raise OverflowError("a vector's components are too large for 64-bit distances")
                    keep.append(k)
                    packed.append((x.size, x.astype("<i4").tobytes()))
            if keep:
                out = pd.DataFrame(packed, columns=["dim", "vec"])
                for c in ("_id", "label"):
                    out[c] = b[c].iloc[keep].reset_index(drop=True)
                yield out

    label = F.col(label_column) if label_column else F.lit(None).cast("int")
    slim = df.select(
        F.col(id_column).alias("_id"), label.alias("label"), F.col(vector_column).cast("array<double>").alias("vec")
    ).where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("_id", "label")}
    return slim.mapInPandas(pack, f"_id {kinds['_id']}, label {kinds['label']}, dim int, vec binary")


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), dim).astype(np.int64)


Books = dict[int, list[Codebook]]  # by vector length, then part position


def first_books(rows: DataFrame, parts: int, entries: int) -> Books:
    """The parts of the vectors with the smallest ids, ascending; equal ids in order of bytes."""
    order = Window.partitionBy("dim").orderBy(F.col("_id").asc_nulls_last(), "vec")
    first = rows.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= entries)
    held = first.select("dim", "_at", "vec").toPandas()  # `entries` rows per vector length
    books: Books = {}
    for dim, some in held.groupby("dim"):
        x = _matrix(some.sort_values("_at")["vec"], int(dim))
        books[int(dim)] = [Codebook(x[:, p:q]) for p, q in part_edges(int(dim), parts)]
    return books


def assigned(x: np.ndarray, books: list[Codebook], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts) indexes and squared distances."""
    edges = part_edges(x.shape[1], parts)
    found = [book.nearest(x[:, p:q]) for book, (p, q) in zip(books, edges)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def improved(rows: DataFrame, books: Books, parts: int) -> Books:
    """Every entry moved to the floor of its parts' mean; entries without parts stay."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list[np.ndarray]] = {}
        count: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for dim, some in b.groupby("dim"):
                own, x = books[dim], _matrix(some["vec"], dim)
                if dim not in total:
                    total[dim] = [np.zeros_like(c.entries) for c in own]
                    count[dim] = [np.zeros(len(c.entries), np.int64) for c in own]
                at, _ = assigned(x, own, parts)
                for k, (p, q) in enumerate(part_edges(dim, parts)):
                    np.add.at(total[dim][k], at[:, k], x[:, p:q])
                    count[dim][k] += np.bincount(at[:, k], minlength=len(own[k].entries))
        for dim in total:
            for k in range(parts):
                for e in np.nonzero(count[dim][k])[0].tolist():
                    values = [int(count[dim][k][e]), *total[dim][k][e].tolist()]
                    yield pd.DataFrame(
                        {"dim": dim, "part": k, "entry": e, "at": range(len(values)), "value": values}
                    )

    # a row per number of a codebook, whatever the number of vectors
    found = (
        rows.select("dim", "vec")
        .mapInPandas(sums, "dim int, part int, entry int, at int, value long")
        .groupBy("dim", "part", "entry", "at")
        .agg(F.sum("value").alias("value"))
        .toPandas()
        .sort_values("at")
    )
    moved = {dim: [book.entries.copy() for book in own] for dim, own in books.items()}
    for (dim, part, entry), values in found.groupby(["dim", "part", "entry"])["value"]:
        numbers = values.to_numpy(np.int64)
        moved[dim][part][entry] = numbers[1:] // numbers[0]
    return {dim: [Codebook(e) for e in own] for dim, own in moved.items()}


def learn_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = improved(rows, books, parts) if books else books
    return books


def books_text(books: list[Codebook]) -> str:
    """All entries' components by part, entry and position, joined by commas."""
    return ",".join(str(v) for book in books for v in book.entries.ravel().tolist())


def compressed(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str | None = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(id, code, error, label, label_error, codebooks_sha256), a row for each usable vector.

    `code` holds the index of each part's entry, two hex digits each. `error` adds the parts'
    squared distances to their entries, `label_error` the errors of all rows with that label,
    missing labels together. Vectors of each length are coded by codebooks of their own; a
    length that the number of parts does not divide makes the first parts longer by one. Fewer
    vectors than entries give fewer entries. Repeated rows and null ids are kept; null ids come
    last in the choice of first entries. Components beyond 64-bit distances raise OverflowError.
    An empty table gives an empty result.
    """
    rows = store(integer_vectors(df, id_column, vector_column, label_column, scale), "vectors")
    books = learn_books(rows, parts, entries, rounds)
    digests = {dim: hashlib.sha256(books_text(own).encode()).hexdigest() for dim, own in books.items()}

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, some in b.groupby("dim"):
                at, error = assigned(_matrix(some["vec"], dim), books[dim], parts)
                raw = at.astype(np.uint8).tobytes().hex()
                yield pd.DataFrame(
                    {
                        "_id": some["_id"],
                        "label": some["label"],
                        "code": [raw[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(at))],
                        "error": error.sum(axis=1),
                        "codebooks_sha256": digests[dim],
                    }
                )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "label")}
    coded = store(
        rows.mapInPandas(
            code, f"_id {kinds['_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string"
        ).withColumn("_part", F.pmod(F.xxhash64("_id", "code"), F.lit(LABEL_PARTS)).cast("int")),
        "codes",
    )
    # a label may hold most rows: its sum is copied to several parts, which its rows spread over
    every = F.explode(F.sequence(F.lit(0), F.lit(LABEL_PARTS - 1)))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = sums.select("_label", "label_error", every.alias("_p"))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_p"))
    return coded.join(sums, same).select(
        F.col("_id").alias(id_column), "code", "error", "label", "label_error", "codebooks_sha256"
    )
