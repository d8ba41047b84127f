"""Byte-level BPE encoding and decoding of whole texts, in chunks that overlap.

A long text is cut into chunks that share some characters with the next. Chunks are split into
pre-tokens in parallel. Where two neighbours have a pre-token boundary in common, both go on
alike, since what follows a boundary depends only on the text after it; there the text is cut
into pieces, which are encoded in parallel. Neighbours without a common boundary stay one piece.
Decoding puts the raw bytes of the ids together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.packing import vocabulary_path
from riskweave.session import store

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK = 1 << 15
OVERLAP = 1 << 9
MEMO_ENTRIES = 600_000


_SPACE = regex.compile(r"\s")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteEncoder:
    """Ids and decoded bytes of pre-tokens, each worked out once, up to a bound."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str | None = None, memo_entries: int = MEMO_ENTRIES):
        import tiktoken

        with open(vocabulary_path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        pattern = pattern or split_pattern()
        self.encoding = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.pattern = regex.compile(pattern)
        self.by_id = {r: t for t, r in ranks.items()}
        self.ids: dict[str, str] = {}  # pre-token to its ids, in decimal, each after a space
        self.memo_entries = memo_entries

    def _learn(self, word: str) -> str:
        if len(self.ids) >= self.memo_entries:
            self.ids.clear()
        found = "".join(f" {i}" for i in self.encoding._encode_single_piece(word))
        self.ids[word] = found
        return found

    def encode(self, text: str) -> str:
        """The ids of a piece of text, in decimal, each after a space."""
        get, learn = self.ids.get, self._learn
        return "".join([get(w) or learn(w) for w in self.pattern.findall(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join([self.by_id[i] for i in map(int, ids.split())])

    def boundaries(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> ByteEncoder:
    """One encoder per Python worker and vocabulary."""
    return ByteEncoder(vocabulary)


def chunk_edges(text: str, number: int, last: bool, chunk: int, overlap: int, cut) -> tuple[list[int], list[int]]:
    """Boundaries, as positions in the whole text, in the overlap with the chunk before and after.

    Unless the text ends here, the last two are left out: more text could have moved them. So
    are those behind white space: a piece that ended there would split it in another way, as
    the pattern looks ahead of white space.
    """
    base, marks = number * chunk, cut(text)
    if not last:
        marks = marks[:-2]
    marks = [m for m in marks if m and not _SPACE.match(text[m - 1])]
    head = [base + m for m in marks if m < overlap] if number else []
    tail = [] if last else [base + m for m in marks if m >= chunk]
    return head, tail


def piece_cuts(edges: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Where the pieces of a text start: 0 and the first common boundary of each two neighbours.

    `edges` holds (chunk number, head, tail), in order. If neighbours share none, boundaries of
    the later chunk are unproven until a common one is found with what is proven.
    """
    cuts, proven = [0], edges[0][2] if edges else []
    for _, head, tail in edges[1:]:
        common = set(head) & set(proven)
        if common:
            cuts.append(min(common))
            proven = [t for t in tail if t >= cuts[-1]]
        else:
            proven = []  # the piece runs on; the next chunk's boundaries start from an unproven place
    return cuts


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def encoded_pieces(
    docs: DataFrame,
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """`docs` (a unique `_row`, the text) of long texts, as rows (_row, at, ids, raw).

    `ids` are the decimal ids of the piece that starts at `at`, each after a space; `raw` is
    their decoding.
    """
    text = F.col(text_column)
    chunks = F.ceil(F.length(text) / chunk).cast("int")
    spread = (
        docs.select("_row", text.alias("_text"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_no"), chunks.alias("_of"))
        .select(
            "_row",
            "_no",
            (F.col("_no") == F.col("_of") - 1).alias("_last"),
            F.substring("_text", F.col("_no") * chunk + 1, F.lit(chunk + overlap)).alias("_part"),
        )
        .repartition("_row", "_no")
    )

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = encoder(vocabulary).boundaries
        for b in batches:
            found = [
                chunk_edges(t, n, end, chunk, overlap, cut)
                for t, n, end in zip(b["_part"], b["_no"], b["_last"])
            ]
            yield pd.DataFrame(
                {"_row": b["_row"], "_no": b["_no"], "head": [h for h, _ in found], "tail": [t for _, t in found]}
            )

    def cuts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_no")
        found = piece_cuts([(n, list(h), list(t)) for n, h, t in zip(rows["_no"], rows["head"], rows["tail"])])
        return pd.DataFrame({"_row": rows["_row"].iat[0], "at": found, "to": found[1:] + [None]}).astype(
            {"to": "Int64"}
        )

    found = (
        spread.mapInPandas(edges, "_row long, _no int, head array<int>, tail array<int>")
        .groupBy("_row")
        .applyInPandas(cuts, "_row long, at long, to long")
    )
    pieces = (
        docs.select("_row", text.alias("_text"))
        .join(found, "_row")
        .select(
            "_row",
            "at",
            F.substring(
                "_text",
                (F.col("at") + 1).cast("int"),
                (F.coalesce("to", F.length("_text")) - F.col("at")).cast("int"),
            ).alias("_piece"),
        )
        .repartition("_row", "at")
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        for b in batches:
            ids = [e.encode(t) for t in b["_piece"]]
            yield pd.DataFrame(
                {"_row": b["_row"], "at": b["at"], "ids": ids, "raw": [e.decode(i) for i in ids]}
            )

    return pieces.mapInPandas(encode, "_row long, at long, ids string, raw binary")


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(ids: list[str], raw: list[bytes]) -> tuple[int, str, str]:
    """Of the pieces of one text, in order."""
    plain, blob = hashlib.sha256(), hashlib.sha256()
    for i, part in enumerate(ids):
        plain.update((part if any(ids[:i]) else part[1:]).encode())
    for part in raw:
        blob.update(part)
    return sum(part.count(" ") for part in ids), plain.hexdigest(), blob.hexdigest()


def encode_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), a row for each row of `docs`.

    Ids are those that the whole text gets in one go, each match of the pattern on its own, and
    no special tokens. Digests are of the decimal ids joined by a space and of the decoded
    bytes. A null text is an empty one. Repeated rows and null ids are kept; an empty table
    gives an empty result.
    """
    kind = _kind(docs, id_column)
    slim = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    short = slim.where(F.length("_text") <= chunk)
    # numbered once and kept, since later passes must see the same numbers
    long = store(
        slim.where(F.length("_text") > chunk).withColumn("_row", F.monotonically_increasing_id()), "long-texts"
    )

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        for b in batches:
            rows = []
            for t in b["_text"]:
                ids = e.encode(t)
                rows.append(_digest([ids], [e.decode(ids)]))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "_id", b["_id"])
            yield out

    def stitched(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        found = _digest(list(rows["ids"]), list(rows["raw"]))
        return pd.DataFrame([(rows["_row"].iat[0], *found)], columns=["_row", "n_tokens", "ids_sha256", "decoded_sha256"])

    pieces = encoded_pieces(long, "_text", vocabulary, chunk, overlap)
    digests = pieces.groupBy("_row").applyInPandas(stitched, f"_row long, {_DIGEST}")
    named = long.select("_id", "_row").join(digests, "_row").drop("_row")
    both = short.mapInPandas(whole, f"_id {kind}, {_DIGEST}").unionByName(named)
    return both.withColumnRenamed("_id", id_column)
