"""Packing of tokenised documents into sequences of a fixed capacity, by best-two-fit.

A sequence is filled greedily with the largest documents that fit. When nothing fits the gap,
its smallest document gives way to two unpacked ones that fill the widened gap more tightly.

Documents are tokenised where they lie. Only narrow rows are shuffled, into pools of a bounded
number of rows that are packed on their own; a pool loses at most its last sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import store

CAPACITY = 2048
END = 0  # the id that follows every document
VOCABULARY = "word_bpe_49k.json"
POOL_ROWS = 40_000
MEMO_ENTRIES = 1_000_000

# In Latin-1 texts the vocabulary's own splitting and lower-casing can be done here: white space,
# letters and numbers of that range. All other texts, and those with characters that Python
# splits at and the vocabulary does not, go to the tokenizer as they are.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def vocabulary_path(name: str) -> str:
    """A path as it is; a plain file name is looked up among the installed vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    No token crosses white space, so what stands between is encoded once and looked up from
    then on. The memory is bounded: when it is full, it starts anew.
    """

    def __init__(self, vocabulary: str = VOCABULARY, memo_entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[str, bytes] = {}
        self.memo_entries = memo_entries

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """All of `words` in one call; each is one or more pieces between spaces."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, at = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
        pieces = np.cumsum([0] + [len(_PIECES.findall(w)) for w in words])
        if len(at) and at[-1] == pieces[-1] - 1:
            cuts = (4 * np.searchsorted(at, pieces)).tolist()
            self.memo.update(
                (w, ids[a:b]) for w, a, b in zip(words, cuts, cuts[1:])
            )
        else:
            self.memo.update((w, self._whole(w)) for w in words)

    def encode(self, text: str) -> bytes:
        if not _is_latin(text) or any(c in text for c in _CONTROLS):
            return self._whole(text)
        words = text.lower().split()
        try:
            return b"".join(map(self.memo.__getitem__, words))
        except KeyError:
            pass
        new = list(dict.fromkeys(w for w in words if w not in self.memo))
        if len(self.memo) + len(new) > self.memo_entries:
            self.memo.clear()
            new = list(dict.fromkeys(words))
        for i in range(0, len(new), 10_000):
            self._learn(new[i : i + 10_000])
        return b"".join(map(self.memo.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    return WordEncoder(vocabulary)


def tokenized_pieces(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): documents, cut only beyond the capacity.

    A null text is an empty one, which has the closing id alone. `ids` holds the token ids as
    little-endian unsigned 32-bit numbers.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, closing = encoder(vocabulary).encode, np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"]):
                ids = encode(text or "") + closing
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (part,) if with_ids else row)
            yield pd.DataFrame(rows, columns=names).astype({"id": batch["id"].dtype})

    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return slim.mapInPandas(cut, schema).withColumnRenamed("id", id_column)


def _bits(mask: int) -> Iterable[int]:
    """Set bits, the highest first."""
    while mask:
        top = mask.bit_length() - 1
        yield top
        mask ^= 1 << top


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each of the lengths (1 to `capacity`), in their order.

    Lengths that are left are bits of one number, so the largest that fits and pairs of a given
    sum are found by shifts, whatever their count.
    """
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(-np.arange(len(lengths)), kind="stable").tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    left = sum(1 << n for n in stacks)  # bit n: length n is there
    turned = sum(1 << (capacity - n) for n in stacks)  # bit capacity - n
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal left, turned
        item = stacks[n].pop()
        if not stacks[n]:
            left ^= 1 << n
            turned ^= 1 << (capacity - n)
        return item

    def give_back(n: int, item: int) -> None:
        nonlocal left, turned
        if not stacks[n]:
            left ^= 1 << n
            turned ^= 1 << (capacity - n)
        stacks[n].append(item)

    def tightest_pair(most: int, more_than: int) -> tuple[int, int] | None:
        for total in range(most, more_than, -1):
            for a in _bits(left & (turned >> (capacity - total))):
                if a * 2 != total or len(stacks[a]) > 1:
                    return a, total - a
        return None

    number = 0
    while left:
        gap, inside = capacity, []
        while True:
            fits = left & ((1 << (gap + 1)) - 1)
            while fits:
                n = fits.bit_length() - 1
                inside.append((n, take(n)))
                gap -= n
                fits = left & ((1 << (gap + 1)) - 1)
            if not gap or not left:
                break
            small = min(range(len(inside)), key=lambda k: inside[k][0])
            pair = tightest_pair(gap + inside[small][0], inside[small][0])
            if pair is None:
                break
            n, item = inside.pop(small)
            inside += [(m, take(m)) for m in pair]
            give_back(n, item)
            gap += n - sum(pair)
        at = 0
        for n, item in inside:
            sequence[item], offset[item] = number, at
            at += n
        number += 1
    return sequence, offset


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    pool_rows: int = POOL_ROWS,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Pieces of a sequence follow each other without gaps from offset 0 and fill at most
    `capacity`. Null and empty texts are pieces of one id. Repeated rows and null ids are
    packed like any other; an empty table gives an empty result.
    """
    pieces = tokenized_pieces(docs, id_column, text_column, capacity, vocabulary)
    pieces = store(
        pieces.withColumnRenamed(id_column, "_id").withColumn("_row", F.monotonically_increasing_id()),
        "pieces",
    )
    pools = max(1, -(-pieces.count() // pool_rows))
    kind = pieces.schema["_id"].dataType.simpleString()

    def pack_pool(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        number, offset = best_two_fit(rows["length"].to_numpy(), capacity)
        pool = int(rows["_pool"].iat[0])
        return rows.drop(columns=["_row", "_pool"]).assign(
            sequence_id=number * pools + pool, offset=offset
        )

    dealt = pieces.withColumn("_pool", F.pmod(F.xxhash64("_row"), F.lit(pools)))
    packed = dealt.groupBy("_pool").applyInPandas(
        pack_pool,
        f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return packed.withColumnRenamed("_id", id_column)
