"""Toxicity scores of texts whose words may be disguised.

A noisy channel turns intended letters into what is read: look-alike digits and signs, letters
drawn out, words spaced out. Disguised tokens become lattices of intended characters, a Viterbi
search under a character trigram model picks the likeliest reading, and the restored words are
scored. The language model counts every text of the corpus. The word weights and the
calibration come from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.rows import unwrapped, wrapped
from riskweave.session import store

SAMPLE_ROWS = 20_000  # labelled rows to learn from, at most
THRESHOLD = 0.3
SUPPORT = 0.1  # what the second and third heaviest words count
PREFIXES = range(3, 8)
MEMO_ENTRIES = 400_000
RUN_MEMO = 64  # characters of a remembered run
CHUNK = 1 << 20

MODEL_ROWS = 1 << 20  # trigrams that tasks are sent, the most frequent; the rest back off

# The letters counted in a table of their own, as most texts have no others: a-z and the
# lower-case letters of Latin-1. Class 0 is everything that ends a word.
_LATIN = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
_LETTERS = [chr(c) for c in range(97, 123)] + _LATIN
_OTHER = len(_LETTERS) + 1  # any other letter, counted by its code point
_CLASSES = _OTHER + 1
_BITS = 21  # of a code point

# Readings of look-alike signs.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e",
}
_ANY = "*#"
# Letters that look like Latin ones; resolved only where a word mixes scripts.
_HOMOGLYPHS = str.maketrans(
    {"\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0445": "x", "\u0443": "y",
     "\u0456": "i", "\u043a": "k", "\u043c": "m", "\u0442": "t", "\u0455": "s", "\u0458": "j", "\u0501": "d",
     "\u03bf": "o", "\u03b1": "a", "\u03b9": "i", "\u03c1": "p", "\u03bd": "v", "\u03ba": "k"}
)
_INVISIBLE = {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None}
_WIDE = re.compile("[\u00ad\u0100-\U0010ffff]")
_SIGNS = re.escape("".join(LOOK_ALIKES)) + re.escape(_ANY)
_WORD = "a-zß-öø-ÿ"
_TOKEN = re.compile(f"[{_WORD}{_SIGNS}]+")
_PLAIN = re.compile(f"[{_WORD}]+")
_LETTER = re.compile(f"[{_WORD}]")
# the same for letters and marks of any script, for texts that have others than the above
_TOKEN_ANY = regex.compile(rf"[\p{{L}}\p{{M}}{_SIGNS}]+")
_PLAIN_ANY = regex.compile(r"[\p{L}\p{M}]+")
_LETTER_ANY = regex.compile(r"\p{L}")
_MIXED = regex.compile(r"(?=.*\p{Latin})(?=.*[\p{Cyrillic}\p{Greek}])", regex.DOTALL)
# scripts written without spaces: short runs of characters stand for words
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_GRAMS = (2, 3, 4)
_DRAWN = re.compile(r"(.)\1")
_ENDS = "!|+" + _ANY  # signs that may also be marks behind a word
_GROUP = 2  # letters in a group of a spaced-out word, at most
_SPACED_LETTERS = 3  # letters in a spaced-out word, at least
_SOFT = "~"  # between groups of which one is as long as a short word

# Log probabilities of the channel.
_LOOK, _MASK, _DROP, _KEEP, _EVEN, _NOISE, _SILENT, _REPEAT = (
    math.log(p) for p in (0.5, 0.02, 0.9, 0.1, 0.5, 0.2, 0.0001, 0.3)
)


def fold(text: str | None) -> str:
    """Lower case; beyond Latin-1 also compatibility forms (full-width and mathematical letters,
    accents on their own) in their plain form, and no invisible characters."""
    low = (text or "").lower()
    if _WIDE.search(low):
        low = unicodedata.normalize("NFKC", low.translate(_INVISIBLE)).lower()
    return low


def is_wide(text: str) -> bool:
    return _WIDE.search(text) is not None


def tokens_of(folded: str) -> list[str]:
    """Runs of letters, marks and signs that can hide letters. Letters of other scripts that look
    Latin become Latin inside words that mix scripts, and only there."""
    if not is_wide(folded):
        return _TOKEN.findall(folded)
    found = _TOKEN_ANY.findall(folded)
    return [t.translate(_HOMOGLYPHS) if not t.isascii() and _MIXED.match(t) else t for t in found]


def is_plain(token: str) -> bool:
    """Whether a token has letters and marks only."""
    if _PLAIN.fullmatch(token):
        return True
    return not token.isascii() and _PLAIN_ANY.fullmatch(token) is not None


def has_letter(token: str) -> bool:
    if _LETTER.search(token):
        return True
    return not token.isascii() and _LETTER_ANY.search(token) is not None


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the class, and the code point itself for letters and marks, else 0."""
    points = np.zeros(0x110000, np.int64)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for run in _PLAIN_ANY.finditer(every):
        a, b = ord(run[0][0]), ord(run[0][-1])
        points[a : b + 1] = np.arange(a, b + 1)
    points[0xD800:0xE000] = 0
    classes = np.where(points > 0, _OTHER, 0).astype(np.int32)
    for k, ch in enumerate(_LETTERS):
        classes[ord(ch)] = k + 1
    return classes, points


_CLASS_POINTS = np.array([0] + [ord(c) for c in _LETTERS], np.int64)


def packed(a, b, c):
    """Three code points as one number."""
    return (a << 2 * _BITS) | (b << _BITS) | c


class GramCounts:
    """How often each letter follows each two others, over all texts added. Code points are
    counted as they are, none is folded into a class with others; 0 stands for all that is not a
    letter, and for the ends of texts."""

    def __init__(self) -> None:
        self.dense = np.zeros(_CLASSES**3, np.int64)
        self.wide: list[np.ndarray] = []
        self.held = 0
        self.sparse: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, text: str | None) -> None:
        low = fold(text)
        classes, letters = _tables()
        for at in range(0, len(low), CHUNK):
            # two characters of context, and the closing boundary at the end
            part = low[max(0, at - 2) : at + CHUNK]
            head = [0, 0] if at == 0 else []
            tail = [0] if at + CHUNK >= len(low) else []
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            points = np.concatenate([np.array(head, np.uint32), points, np.array(tail, np.uint32)])
            codes = classes[points]
            grams = (codes[:-2] * _CLASSES + codes[1:-1]) * _CLASSES + codes[2:]
            if int(codes.max(initial=0)) == _OTHER:
                other = (codes[:-2] == _OTHER) | (codes[1:-1] == _OTHER) | (codes[2:] == _OTHER)
                p = letters[points]
                self.wide.append(packed(p[:-2], p[1:-1], p[2:])[other])
                self.held += len(self.wide[-1])
                grams = grams[~other]
                if self.held > 1 << 22:
                    self._merge()
            self.dense += np.bincount(grams, minlength=_CLASSES**3)

    def _merge(self) -> None:
        keys = np.concatenate([self.sparse[0], *self.wide])
        n = np.concatenate([self.sparse[1], np.ones(self.held, np.int64)])
        kinds, place = np.unique(keys, return_inverse=True)
        self.sparse = kinds, np.bincount(place, n, len(kinds)).astype(np.int64)
        self.wide, self.held = [], 0

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """(packed trigram, count) of all that occurred."""
        self._merge()
        k = np.flatnonzero(self.dense)
        c = _CLASS_POINTS
        own = packed(c[k // _CLASSES**2], c[k // _CLASSES % _CLASSES], c[k % _CLASSES])
        return np.concatenate([own, self.sparse[0]]), np.concatenate([self.dense[k], self.sparse[1]])


def trigram_counts(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    total = GramCounts()
    for text in texts:
        total.add(text)
    return total.counted()


class LanguageModel:
    """Log probability of a letter after two others, discounted towards shorter contexts. A
    trigram that is not held backs off to pairs and single letters."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.n = np.asarray(grams, np.int64)[order], np.asarray(n, np.float64)[order]
        self._index()

    def _index(self) -> None:
        low = (1 << _BITS) - 1

        def summed(keys, n):
            kinds, place = np.unique(keys, return_inverse=True)
            return dict(zip(kinds.tolist(), zip(np.bincount(place, n, len(kinds)).tolist(), np.bincount(place).tolist())))

        self.after_two = summed(self.grams >> _BITS, self.n)
        pairs, place = np.unique(self.grams & ((1 << 2 * _BITS) - 1), return_inverse=True)
        pair_n = np.bincount(place, self.n, len(pairs))
        self.pairs = dict(zip(pairs.tolist(), pair_n.tolist()))
        self.after_one = summed(pairs >> _BITS, pair_n)
        letters = summed(pairs & low, pair_n)
        self.letters = {c: n for c, (n, _) in letters.items()}
        self.total, self.kinds = float(pair_n.sum()), len(self.letters) + 1
        self.memo: dict[int, float] = {}

    def __getstate__(self):
        return {"grams": self.grams, "n": self.n}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._index()

    def log(self, a: int, b: int, c: int) -> float:
        key = packed(a, b, c)
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > MODEL_ROWS:
                self.memo.clear()
            found = self.memo[key] = math.log(self._chance(a, b, c, key))
        return found

    def _chance(self, a: int, b: int, c: int, key: int) -> float:
        p = (self.letters.get(c, 0.0) + 1.0) / (self.total + self.kinds)
        n, kinds = self.after_one.get(b, (0.0, 1))
        p = (self.pairs.get((b << _BITS) | c, 0.0) + kinds * p) / (n + kinds)
        n, kinds = self.after_two.get((a << _BITS) | b, (0.0, 1))
        at = int(np.searchsorted(self.grams, key))
        own = float(self.n[at]) if at < len(self.grams) and self.grams[at] == key else 0.0
        return (own + kinds * p) / (n + kinds)

    def alphabet(self, like: str) -> str:
        """Letters that a masked one may be: a-z beside Latin letters or none, else those that the
        corpus has in the block of 256 code points of a letter beside it."""
        for ch in like:
            if ord(ch) > 0x24F and _LETTER_ANY.match(ch) and not _UNSPACED.match(ch):
                block = ord(ch) >> 8
                return "".join(sorted(chr(c) for c in self.letters if c >> 8 == block))
        return "".join(_LETTERS[:26])


def language_model(counts: tuple[np.ndarray, np.ndarray]) -> LanguageModel:
    return LanguageModel(*counts)


def _lattice(token: str, model: LanguageModel) -> list[list[tuple[str, float]]]:
    """Per run of equal characters: the readings, each with its channel log probability.

    A reading is the text it puts out; a space is a boundary.
    """
    masked = model.alphabet(token) if any(c in token for c in _ANY) else ""
    steps: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        ch, end = token[at], at + 1
        while end < len(token) and token[end] == ch:
            end += 1
        run = end - at
        at = end
        if ch == _SOFT:
            steps.append([(" ", _EVEN), ("", _EVEN)])
        elif ch in " ._-":
            steps.append([(" ", _KEEP), ("", _DROP)])
        elif ch in LOOK_ALIKES or ch in _ANY:
            letters = LOOK_ALIKES.get(ch) or masked
            cost = (_LOOK if ch in LOOK_ALIKES else _MASK) - math.log(len(letters)) * (ch in _ANY)
            # a reading of the whole run as one letter or as one for each sign, or as noise
            copies = {1, min(run, 2)} if ch in LOOK_ALIKES else {1}
            steps.append(
                [(" ", _NOISE if ch in _ANY + "!|+" else _SILENT)]
                + [(c * k, cost + (run > k) * _REPEAT) for c in letters for k in sorted(copies)]
            )
        elif run == 1:
            steps.append([(ch, 0.0)])
        else:
            steps.append([(ch, _REPEAT), (ch * 2, 0.0 if run == 2 else _REPEAT)])
    return steps


def decode(token: str, model: LanguageModel) -> str:
    """The likeliest reading of a folded token or spaced-out run."""
    log = model.log
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}

    def push(state, score, path, text):
        a, b = state
        for ch in text:
            c = 0 if ch == " " else ord(ch)
            if c or b:  # one boundary stands for many
                score += log(a, b, c)
                a, b = b, c
        return (a, b), score, (path, text) if text else path

    for readings in _lattice(token, model):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            for text, cost in readings:
                key, value, way = push(state, score + cost, path, text)
                old = after.get(key)
                if old is None or value > old[0]:
                    after[key] = (value, way)
        states = after
    best = max((push(s, v, w, " ")[1:] for s, (v, w) in states.items()), key=lambda x: x[0])
    parts, way = [], best[1]
    while way:
        way, text = way
        parts.append(text)
    return "".join(reversed(parts)).strip()


def disguised(token: str) -> bool:
    """Whether a token has letters and something that can hide others."""
    if is_plain(token):
        return _DRAWN.search(token) is not None
    return has_letter(token)


def spaced_out(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of short tokens that can be a word spelt out, whatever separates
    them. A token counts without the marks at its end."""
    start = None
    for at, token in enumerate([*tokens, "." * (_GROUP + 1)]):
        if len(token) <= _GROUP or len(token.rstrip(_ENDS)) <= _GROUP:
            start = at if start is None else start
        elif start is not None:
            run, first, start = tokens[start:at], start, None
            letters = sum(len(t) for t in run)
            if len(run) > 1 and letters >= _SPACED_LETTERS and has_letter("".join(run)):
                yield first, at


def joined(run: list[str]) -> str:
    """A spaced-out run. Single letters belong together more likely than not; beside a group
    that could be a word of its own, the boundary is as likely as none."""
    out = [run[0]]
    for a, b in zip(run, run[1:]):
        out += [" " if len(a) == len(b) == 1 else _SOFT, b]
    return "".join(out)


def restore(text: str | None, model: LanguageModel) -> str:
    """The words of a text, disguised ones as decoded, in order."""
    tokens, words, done = tokens_of(fold(text)), [], 0

    def plain(part: list[str]) -> list[str]:
        return [decode(t, model) if disguised(t) else t for t in part]

    for start, end in spaced_out(tokens):
        words += [*plain(tokens[done:start]), decode(joined(tokens[start:end]), model)]
        done = end
    return " ".join(words + plain(tokens[done:]))


def words_of(decoded: str) -> list[str]:
    """Words of a decoded token. Scripts without spaces give short runs of characters instead."""
    if decoded.isascii():
        return _PLAIN.findall(decoded)
    out = []
    for word in _PLAIN_ANY.findall(decoded):
        if len(word) > 1 and _UNSPACED.search(word):
            out += [word[i : i + k] for k in _GRAMS for i in range(len(word) - k + 1)]
        else:
            out.append(word)
    return out


def word_features(word: str) -> list[str]:
    return ["=" + word] + ["^" + word[:k] for k in PREFIXES if k <= len(word)]


@dataclass
class Reader:
    """Distinct restored words of texts. Readings of tokens are remembered up to a bound."""

    model: LanguageModel
    memo: dict[str, list[str]] = field(default_factory=dict)

    def words(self, token: str) -> list[str]:
        if not disguised(token):
            if token.isascii():
                return [token] if _LETTER.search(token) else []
            return words_of(token)
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            found = words_of(decode(token, self.model))
            if is_plain(token):  # doubled letters are mostly meant
                found += [w for w in words_of(token) if w not in found]
            self.memo[token] = found
        return found

    def spelt(self, run: str) -> list[str]:
        """Words of a spaced-out run; long runs hardly come twice and are not remembered."""
        found = self.memo.get(run)
        if found is None:
            found = decode(run, self.model).split()
            if len(run) <= RUN_MEMO:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[run] = found
        return found

    def tokens(self, text: str | None) -> set[str]:
        """Distinct tokens, decoded runs of spaced-out letters among them."""
        tokens = tokens_of(fold(text))
        found = set(tokens)
        for start, end in spaced_out(tokens):
            found.update(self.spelt(joined(tokens[start:end])))
        return found

    def features(self, text: str | None) -> set[str]:
        words = {w for t in self.tokens(text) for w in self.words(t)}
        return {f for w in words for f in word_features(w)}


@dataclass
class Scorer:
    """Evidence of a text: the weight of its heaviest word, supported by those of two more.

    One word can be enough, and several words of little weight do not add up to it."""

    reader: Reader
    weights: dict[str, float]
    clean: set[str] = field(default_factory=set)

    def weight(self, token: str) -> float:
        get = self.weights.get
        return max(
            (get(f, 0.0) for w in self.reader.words(token) for f in word_features(w)), default=0.0
        )

    def evidence(self, text: str | None) -> float:
        heavy = []
        for token in self.reader.tokens(text) - self.clean:
            w = self.weight(token)
            if w > 0:
                heavy.append(w)
            else:
                if len(self.clean) >= MEMO_ENTRIES:
                    self.clean.clear()
                self.clean.add(token)
        top = sorted(heavy)[-3:]
        return top[-1] + SUPPORT * sum(top[:-1]) if top else 0.0


@dataclass
class ToxicityModel:
    """What tasks need to score: bounded by the number of classes and by the sample."""

    letters: LanguageModel
    weights: dict[str, float]
    bias: float
    slope: float

    def scorer(self) -> Scorer:
        return Scorer(Reader(self.letters), self.weights)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + self.slope * evidence, -30, 30)))


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def corpus_trigrams(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(gram, n) over every text. Each task adds its texts up before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = GramCounts()
        for batch in batches:
            for text in batch["text"]:
                total.add(text)
        grams, n = total.counted()
        yield pd.DataFrame({"gram": grams, "n": n})

    parts = docs.select(F.col(text_column).alias("text")).mapInPandas(count, "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def corpus_model(docs: DataFrame, text_column: str = "text", rows: int = MODEL_ROWS) -> LanguageModel:
    """From the counts of all texts; the `rows` most frequent trigrams reach driver and tasks."""
    found = corpus_trigrams(docs, text_column).orderBy(F.desc("n"), "gram").limit(rows).toPandas()
    return LanguageModel(found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.int64))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, rows: int
) -> DataFrame:
    """(text, toxic) of at most `rows` labelled ids outside the held-out quarter.

    An id with several labels is toxic if one of them says so; null ids and labels are left out.
    """
    known = (
        labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("_label_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("_label_id")))
        .groupBy("_label_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(rows)
    )
    slim = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"))
    # the sample has at most `rows` rows of two numbers
    joined = slim.join(F.broadcast(known), F.col("_id") == F.col("_label_id"))
    return joined.dropDuplicates(["_id"]).select("text", "toxic")


def _feature_counts(sample: DataFrame, letters: LanguageModel, wanted: set[str] | None) -> DataFrame:
    """(feature, n): in how many texts it stands; only `wanted` ones if given."""
    shared = sample.sparkSession.sparkContext.broadcast(letters)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, total = Reader(shared.value), Counter()
        for batch in batches:
            for text in batch["text"]:
                found = reader.features(text)
                total.update(found if wanted is None else found & wanted)
        if total:
            yield pd.DataFrame({"feature": list(total), "n": list(total.values())})

    parts = sample.select("text").mapInPandas(count, "feature string, n long")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"))


def select_weights(
    positive: dict[str, int], negative: dict[str, int], toxic: int, clean: int, share: float
) -> dict[str, float]:
    """Log-odds of the features whose surplus in toxic texts can't be chance.

    `share` is the part of all text that stands in toxic texts. A feature in a toxic and b
    clean texts must exceed it by a Chernoff bound that allows for the number of features.
    """
    need = math.log(10.0 * max(1, len(positive)))
    weights = {}
    for f, a in positive.items():
        b = negative.get(f, 0)
        n, q = a + b, a / (a + b)
        if q <= share:
            continue
        kl = q * math.log(q / share) + (0.0 if b == 0 else (1 - q) * math.log((1 - q) / (1 - share)))
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if n * kl > need and odds > 0:
            weights[f] = odds
    return weights


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Bias and slope of a one-variable logistic fit by damped Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)

    def loss(w):
        z = design @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge * w @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + ridge * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), grad)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Language model of all of `docs`, weights and calibration of a bounded labelled sample."""
    letters = corpus_model(docs, text_column)
    sample = store(labelled_sample(docs, labels, id_column, text_column, sample_rows), "labelled")
    toxic_rows, clean_rows = sample.where("toxic = 1"), sample.where("toxic <> 1")
    sizes = {
        bool(r["t"]): (r["n"], r["size"])
        for r in sample.groupBy((F.col("toxic") == 1).alias("t"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text") + 1).alias("size"))
        .collect()
    }
    (toxic, toxic_size), (clean, clean_size) = (sizes.get(k, (0, 0)) for k in (True, False))
    if not toxic or not clean:  # nothing to tell apart: every text gets the sample's share
        p = (toxic + 1) / (toxic + clean + 2) if toxic + clean else 0.0
        return ToxicityModel(letters, {}, math.log(p / (1 - p)) if p else -30.0, 0.0)
    positive = _feature_counts(toxic_rows, letters, None).where("n >= 3").toPandas()
    positive = dict(zip(positive["feature"], positive["n"].astype(int)))
    negative = _feature_counts(clean_rows, letters, set(positive)).toPandas()
    negative = dict(zip(negative["feature"], negative["n"].astype(int)))
    share = min(0.9, (toxic_size or 0) / max(1, (toxic_size or 0) + (clean_size or 0)))
    weights = select_weights(positive, negative, toxic, clean, max(share, 1e-6))
    model = ToxicityModel(letters, weights, 0.0, 1.0)
    seen = _with_evidence(sample, "text", model).select("_evidence", "toxic").toPandas()
    model.bias, model.slope = fit_logistic(
        seen["_evidence"].to_numpy(float), (seen["toxic"] == 1).to_numpy(float)
    )
    return model


def _with_evidence(docs: DataFrame, text_column: str, model: ToxicityModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see ToxicityModel

    @F.pandas_udf(T.DoubleType())
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        for texts in batches:
            yield pd.Series([scorer.evidence(t) for t in texts], dtype="float64")

    return docs.withColumn("_evidence", evidence(F.col(text_column)))


def _score(model: ToxicityModel) -> Column:
    z = F.lit(model.bias) + F.lit(model.slope) * F.col("_evidence")
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def with_scores(
    docs: DataFrame, model: ToxicityModel, text_column: str = "text", name: str = "toxicity"
) -> DataFrame:
    """`docs` with the score of each whole text in a column of that name.

    Null and empty texts score as texts without evidence. Words of all scripts count, in scripts
    without spaces runs of 2 to 4 characters. Repeated rows score alike. Ids, languages, sources
    and labels are not read.
    """
    rows = _with_evidence(wrapped(docs, own_text=F.col(text_column)), "own_text", model)
    return unwrapped(rows, docs, **{name: _score(model)})


def score_documents(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, held_out, score, predicted), a row for each row of `docs`.

    Labels are learnt outside the held-out quarter only. Without usable labels every text gets
    the same score. A null id counts as not held out.
    """
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    scored = with_scores(slim, fit(docs, labels, id_column, text_column), "text", "score")
    return scored.select(
        F.col("id").alias(id_column),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`docs` without the texts whose score reaches the threshold; all columns stay. A text
    without any evidence stays, also where labels are so few that it scores like the rest."""
    model = fit(docs, labels, id_column, text_column)
    rows = _with_evidence(wrapped(docs, own_text=F.col(text_column)), "own_text", model)
    return unwrapped(rows.where((_score(model) < THRESHOLD) | (F.col("_evidence") <= 0)), docs)
