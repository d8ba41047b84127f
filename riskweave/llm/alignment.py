"""Alignment of two tokenizers' tokens over the same bytes, and counts of the linked ids.

Both tokenizers cut a text into byte ranges. Where a token of each ends at the same byte, a group
ends. The two arrays of ends are compared at the current shift of their indices: while tokens
are one to one, slices of doubling length are compared as wholes, so a long stretch is jumped in
a few steps; a slice that differs is halved down to where the stretch ends. The irregular group
that follows is resolved locally, one token at a time, and leaves a new shift.

Documents are encoded and aligned where they lie, in blocks of a bounded number of links. A
block sends each of its id pairs once, with a count, and gets the corpus-wide counts of just
these pairs back, so a frequent pair travels once per block and not once per occurrence.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.bpe import split_pattern
from riskweave.llm.packing import vocabulary_path
from riskweave.session import store

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
BLOCK_LINKS = 1 << 19
BLOCK_DOCUMENTS = 1 << 14
SLAB = 1 << 15  # pieces of a text that are aligned at a time
MEMO_ENTRIES = 600_000
MEMO_LENGTH = 64

# Neither tokenizer has a token that runs from a visible character into a space, so both end one
# at every space behind a visible character.
_CUT = re.compile(r"(?<=\S) ")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def run_length(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from a[i] and b[j] on are equal one to one, by exponential probing."""
    p, q, step = i, j, 1
    while True:
        x, y = a[p : p + step], b[q : q + step]
        if x != y:
            break
        p += len(x)
        q += len(y)
        if len(x) < step:  # both lists end here
            return p - i
        step *= 2
    while step > 1:  # the slices hold a difference: keep to their equal halves
        step //= 2
        x = a[p : p + step]
        if len(x) == step and x == b[q : q + step]:
            p += step
            q += step
    return p - i


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places of the tokens of both sides that do not end a group: their ends have no
    counterpart. Both lists rise and end alike."""
    inner_a: list[int] = []
    inner_b: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            run = run_length(a, b, i, j)
            i += run
            j += run
            continue
        while x != y:
            if x < y:
                inner_a.append(i)
                i += 1
                x = a[i]
            else:
                inner_b.append(j)
                j += 1
                y = b[j]
        i += 1  # the shift of the indices has changed
        j += 1
    return inner_a, inner_b


Slabs = list[tuple[np.ndarray, np.ndarray]]


def _objects(items: list[bytes]) -> np.ndarray:
    out = np.empty(len(items), object)
    out[:] = items
    return out


class TwoEncoders:
    """Ids of space+text by both tokenizers. What stands between cuts is encoded once and looked
    up from then on; the memory is bounded and starts anew when it is full."""

    def __init__(
        self,
        byte_vocabulary: str = BYTE_VOCABULARY,
        piece_vocabulary: str = PIECE_VOCABULARY,
        memo_entries: int = MEMO_ENTRIES,
    ):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(vocabulary_path(byte_vocabulary))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(piece_vocabulary))
        alphabet = byte_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = _objects([bytes(alphabet.get(c, 0) for c in t) for t in names])
        self.bytes_b = _objects([self._piece(i) for i in range(self.b.get_piece_size())])
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        # decimal ids with the marks that may stand behind them
        self.name_a, self.last_a = (_objects([b"%d%b" % (i, m) for i in range(size)]) for m in (b",", b"|"))
        pieces = range(len(self.bytes_b))
        self.name_b, self.last_b = (_objects([b"%d%b" % (i, m) for i in pieces]) for m in (b",", b";"))
        self.space = self.b.piece_to_id("▁")
        self.fast = self._ranked(vocabulary_path(byte_vocabulary))
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.memo_entries = memo_entries

    def _ranked(self, path: str):
        """The byte vocabulary as ranks, which give the same ids in a fraction of the time; None
        if its merges are not in the order of the ids or it cuts texts in another way."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        ids = model["vocab"]
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        rising = [ids.get(m) for m in merged] == list(range(256, 256 + len(merged)))
        if not (plain and rising and spec["normalizer"] is None and not model.get("ignore_merges")):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(_BYTE_PIECE.fullmatch(name)[1], 16)])
        return name.replace("▁", " ").encode()

    def _byte_ids(self, pieces: list[str], sizes: np.ndarray) -> list[bytes]:
        """Ids of " " + piece for each of the pieces, which take `sizes` bytes.

        They are encoded as one text and cut where the pieces end, since a token ends there."""
        if self.fast is None:
            found = self.a.encode_batch([f" {p}" for p in pieces], add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() for x in found]
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(pieces)), "<u4")
        ends = self.length_a[ids].cumsum()
        cuts = np.searchsorted(ends, sizes.cumsum(), "right")
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[p:q] for p, q in zip(at, at[1:])]

    def _learn(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of both sides as little-endian 32-bit numbers; none if the bytes do not return."""
        inner = [p for p in pieces if p and not p[-1].isspace()]
        last = [p for p in pieces if not p or p[-1].isspace()]  # white space may only end a text
        out = {}
        for some in [inner, *([p] for p in last)]:
            if not some:
                continue
            texts = [f" {p}".encode() for p in some]
            sizes = np.array([len(t) for t in texts], np.int64)
            first = self._byte_ids(some, sizes)
            second = [y if p else [self.space] for p, y in zip(some, self.b.encode(some, num_threads=1))]
            flat = np.fromiter(chain.from_iterable(second), "<u4")
            ends = np.cumsum([0] + [len(y) for y in second])
            raw, at = flat.tobytes(), (4 * ends).tolist()
            second = [raw[p:q] for p, q in zip(at, at[1:])]
            good = self._same(self.bytes_b, self.length_b, flat, ends, texts, sizes)
            if self.fast is None:  # ranks hold every byte, so nothing can get lost on that side
                ids = np.frombuffer(b"".join(first), "<u4")
                cut = np.cumsum([0] + [len(x) // 4 for x in first])
                good = [u and v for u, v in zip(good, self._same(self.bytes_a, self.length_a, ids, cut, texts, sizes))]
            for p, x, y, fine in zip(some, first, second, good):
                out[p] = (x, y) if fine else (b"", b"")
        return out

    @staticmethod
    def _same(
        table: np.ndarray, length: np.ndarray, ids: np.ndarray, ends: np.ndarray, texts: list[bytes], sizes: np.ndarray
    ) -> list[bool]:
        """Whether each text's bytes come back from its ids, ids[ends[k]:ends[k + 1]]."""
        flat = table[ids].tolist()
        held = np.diff(np.r_[0, length[ids].cumsum()][ends])
        if (held == sizes).all() and b"".join(flat) == b"".join(texts):
            return [True] * len(texts)
        at = ends.tolist()
        return [b"".join(flat[p:q]) == t for p, q, t in zip(at, at[1:], texts)]

    def _found(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        memo = self.memo
        try:
            return [memo[p] for p in pieces]
        except KeyError:
            pass
        found = list(map(memo.get, pieces))
        gaps = [k for k, f in enumerate(found) if f is None]
        new = list(dict.fromkeys([pieces[k] for k in gaps]))
        fresh: dict[str, tuple[bytes, bytes]] = {}
        for k in range(0, len(new), 10_000):
            fresh |= self._learn(new[k : k + 10_000])
        for k in gaps:
            found[k] = fresh[pieces[k]]
        if len(memo) + len(new) > self.memo_entries:
            memo.clear()
        memo.update((p, v) for p, v in fresh.items() if len(p) <= MEMO_LENGTH)
        return found

    def encode(self, text: str | None) -> Slabs:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[Slabs]:
        """For each text the ids of both sides, in slabs that end at a common byte. Empty for a
        null or empty text and for one whose bytes do not come back from both. New pieces of
        several texts are learnt at a time."""
        held, size = [], 0
        for text in texts:
            held.append((text, _CUT.split(text) if text else []))
            size += len(held[-1][1])
            if size >= SLAB:
                yield from self._slabs(held)
                held, size = [], 0
        yield from self._slabs(held)

    def _slabs(self, held: list[tuple[str | None, list[str]]]) -> Iterator[Slabs]:
        every = [p for _, pieces in held for p in pieces]
        found = [f for k in range(0, len(every), SLAB) for f in self._found(every[k : k + SLAB])]
        at = 0
        for text, pieces in held:
            slabs, size = [], 0
            for k in range(at, at + len(pieces), SLAB):
                some = found[k : min(k + SLAB, at + len(pieces))]
                x = np.frombuffer(b"".join([f[0] for f in some]), "<u4")
                y = np.frombuffer(b"".join([f[1] for f in some]), "<u4")
                slabs.append((x, y))
                size += int(self.length_a[x].sum())
            at += len(pieces)
            # every piece gives its own bytes or none at all
            yield slabs if text and size == len(text.encode()) + 1 else []


@lru_cache(maxsize=2)
def encoders(byte_vocabulary: str, piece_vocabulary: str) -> TwoEncoders:
    """One pair of encoders per Python worker."""
    return TwoEncoders(byte_vocabulary, piece_vocabulary)


def groups_of(e: TwoEncoders, slab: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Group ends of a slab, as token counts of both sides."""
    x, y = slab
    inner = align(e.length_a[x].cumsum().tolist(), e.length_b[y].cumsum().tolist())
    out = []
    for ids, places in zip(slab, inner):
        ends = np.ones(len(ids), bool)
        ends[places] = False
        out.append(np.flatnonzero(ends) + 1)
    return out[0], out[1]


def groups_text(
    e: TwoEncoders, slab: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray]
) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: decimal ids of both sides, group by group.

    Every id is put, with the mark behind it, in its place of the whole."""
    x, y = slab
    a, b = ends
    if not len(a):
        return b""
    parts = np.empty(len(x) + len(y), object)
    # in front of a group's A ids stand the B ids of earlier groups, of its B ids also its A ids
    before_b, with_a = np.r_[0, b[:-1]], a
    first = e.name_a[x]
    first[a - 1] = e.last_a[x[a - 1]]
    parts[np.arange(len(x)) + np.repeat(before_b, np.diff(np.r_[0, a]))] = first
    second = e.name_b[y]
    second[b - 1] = e.last_b[y[b - 1]]
    parts[np.arange(len(y)) + np.repeat(with_a, np.diff(np.r_[0, b]))] = second
    return b"".join(parts.tolist())[:-1]


def aligned_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    byte_vocabulary: str = BYTE_VOCABULARY,
    piece_vocabulary: str = PIECE_VOCABULARY,
) -> DataFrame:
    """(id, a_ids, b_ids, a_ends, b_ends), a row for each row of `docs`, without any shuffle.

    `a_ends` and `b_ends` hold, group by group, how many tokens of each side lie before its end.
    Texts without tokens (null, empty, bytes that do not come back) have empty arrays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoders(byte_vocabulary, piece_vocabulary)
        for batch in batches:
            rows = []
            for doc, slabs in zip(batch["_id"], e.encode_all(batch["_text"])):
                parts, at = ([], [], [], []), [0, 0]
                for slab in slabs:
                    ends = groups_of(e, slab)
                    for k in (0, 1):
                        parts[k].append(slab[k].astype(np.int32))
                        parts[2 + k].append(ends[k] + at[k])
                        at[k] += len(slab[k])
                rows.append((doc, *[np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts]))
            yield pd.DataFrame(rows, columns=["_id", "a_ids", "b_ids", "a_ends", "b_ends"]).astype(
                {"_id": batch["_id"].dtype}
            )

    slim = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, a_ids array<int>, b_ids array<int>, a_ends array<long>, b_ends array<long>"
    return slim.mapInPandas(run, schema).withColumnRenamed("_id", id_column)


_COUNTS = "n_a long, n_b long, n_groups long, groups_sha256 string"
_BLOCK = ["_id", "n_a", "n_b", "n_groups", "groups_sha256", "block", "links", "pair", "n"]


def _blocks(
    docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, block_links: int, block_documents: int
) -> DataFrame:
    """Rows of two sorts: a document with `links`, the places of its pairs among its block's
    pairs, and a `pair` (A id * 2^32 + B id) of a block with its number `n` of links there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoders(byte_vocabulary, piece_vocabulary)
        first, made = TaskContext.get().partitionId() << 32, 0
        rows, keys, held = [], [], 0

        def flush() -> pd.DataFrame:
            pairs, place, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            place = place.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
            size, cuts = place.itemsize, np.cumsum([0] + [len(k) for k in keys]).tolist()
            raw = place.tobytes()
            own = pd.DataFrame(rows, columns=_BLOCK[:5])
            own["links"] = [raw[size * p : size * q] for p, q in zip(cuts, cuts[1:])]
            own["pair"] = own["n"] = pd.Series(pd.NA, own.index, "Int64")
            lookup = pd.DataFrame({"pair": pairs, "n": n}).astype("Int64")
            both = pd.concat([own, lookup.reindex(columns=own.columns)], ignore_index=True)
            both["block"] = first + made
            for c in ("n_a", "n_b", "n_groups"):
                both[c] = both[c].astype("Int64")
            both["_id"] = both["_id"].astype(own["_id"].dtype if own["_id"].dtype == object else "Int64")
            return both[_BLOCK]

        for batch in batches:
            for doc, slabs in zip(batch["_id"], e.encode_all(batch["_text"])):
                n_a, n_b, n_groups, digest, own = 0, 0, 0, None, []
                for slab in slabs:
                    ends = groups_of(e, slab)
                    part = groups_text(e, slab, ends)
                    if digest is None:
                        digest = hashlib.sha256(part)
                    else:
                        digest.update(b";" + part)
                    n_a, n_b, n_groups = n_a + len(slab[0]), n_b + len(slab[1]), n_groups + len(ends[0])
                    last_a = slab[0][ends[0] - 1].astype(np.int64)
                    own.append(last_a << 32 | slab[1][ends[1] - 1].astype(np.int64))
                keys.append(np.concatenate(own) if own else np.zeros(0, np.int64))
                rows.append((doc, n_a, n_b, n_groups, digest.hexdigest() if digest else ""))
                held += n_groups
                if held >= block_links or len(rows) >= block_documents:
                    yield flush()
                    rows, keys, held, made = [], [], 0, made + 1
        if rows:
            yield flush()

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"_id {kind}, {_COUNTS}, block long, links binary, pair long, n long")


def link_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best) from `pair` and `n`: links corpus-wide, and whether no other A id is
    linked more often to the pair's B id. A B id has at most as many pairs as there are A ids."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))


def alignment_report(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    byte_vocabulary: str = BYTE_VOCABULARY,
    piece_vocabulary: str = PIECE_VOCABULARY,
    block_links: int = BLOCK_LINKS,
    block_documents: int = BLOCK_DOCUMENTS,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row.

    Two tokens are linked if their byte ranges end together: the last of each side of a group. A
    link counts for `n_best` if no other A id is linked more often, corpus-wide, to its B id, ties
    included; `count_sum` adds the corpus-wide counts of the links' id pairs. Texts without
    tokens (null, empty, or bytes that do not come back) have zeros and an empty digest. Repeated
    rows and null ids are kept, each row counts; an empty table gives an empty result. Ids are
    whole numbers or strings.
    """
    slim = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    slim = slim.withColumn("_id", F.col("_id").cast("long" if whole else "string"))
    # block numbers come from the task that wrote a block: written once, then only read
    written = store(_blocks(slim, byte_vocabulary, piece_vocabulary, block_links, block_documents), "aligned")
    pairs = written.where(F.col("pair").isNotNull()).select(F.col("block").alias("of_block"), "pair", "n")
    own = written.where(F.col("pair").isNull()).drop("pair", "n")
    counts = link_counts(pairs)
    lookup = pairs.select("of_block", "pair").join(counts, "pair")

    def settle(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("pair")
        count, best = found["count"].to_numpy(np.int64), found["best"].to_numpy(np.int64)
        out = rows[["_id", "n_a", "n_b", "n_groups"]].copy()
        size = "<u2" if len(count) <= 1 << 16 else "<u4"
        places = [np.frombuffer(x, size) for x in rows["links"]]
        out["n_links"] = [len(p) for p in places]
        out["n_best"] = [int(best[p].sum()) for p in places]
        out["count_sum"] = [int(count[p].sum()) for p in places]
        out["groups_sha256"] = rows["groups_sha256"]
        return out

    schema = (
        f"_id {'long' if whole else 'string'}, n_a long, n_b long, n_groups long, n_links long, "
        "n_best long, count_sum long, groups_sha256 string"
    )
    settled = own.groupBy("block").cogroup(lookup.groupBy("of_block")).applyInPandas(settle, schema)
    return settled.withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", id_column)
