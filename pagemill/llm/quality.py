"""Quality by weak labels: heuristic labellers, EM for their accuracies, and a hashed linear scorer.

Labellers fire on a text or not.  How often each set of labellers fires
together is counted over all documents (at most 2**labellers rows), and
expectation-maximisation finds from these counts how often each labeller fires
on bad and on good texts.  The posterior of a document's firing set is its
label.  A logistic scorer over hashed word shapes learns these labels from a
bounded sample and decides on every document.  A long word is read to its end,
as consecutive shapes, so text without blanks is judged by all of it.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import semi_join, slices, takes_over, text_of

DIM = 1 << 10
_WINDOW = 128
_SHAPES = ((re.compile(r"[^\W\d_]*[^\W\d_A-Z][^\W\d_]*"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"\d+"), "0"))
LABELLERS = ("symbol_words", "symbol_share", "upper_words", "bang_words", "bars", "repeats", "same_again")


_LETTERS, _UPPER = ("a",), ("A",)
_PLAIN_SIGNS = frozenset("aA0.,;:'\"()-?!’")
# Signs that are neither letters, digits, white space nor common punctuation.
_SIGN = re.compile(r"[^\w\s.,;:'\"()\-?!]|_")


def _folded(word: str) -> tuple[str, ...]:
    # Words of letters, and those with one sign after them, are most of a text.
    if word.isalpha():
        return _UPPER if word.isascii() and word.isupper() else _LETTERS
    if word[-1] in ",.;:!?" and word[:-1].isalpha():
        return ("A" if word.isascii() and word.isupper() else "a") + word[-1],
    for pattern, sign in _SHAPES:
        word = pattern.sub(sign, word)
    return tuple(word[i:i + 8] for i in range(0, len(word), 8))


class _Shapes(dict):
    """The shapes of words seen before; very long words are folded each time."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = _folded(word)
        if len(word) <= 64:
            if len(self) >= 1 << 18:
                self.clear()
            self[word] = found
        return found


_shapes = _Shapes()


def _freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, and an empty cache after the last: a worker that goes on to other work keeps no words."""
    takes_over("quality", lambda: (_odd.cache_clear(), bucket.cache_clear()))
    yield from batches
    _shapes.clear()


def shapes_of(word: str) -> tuple[str, ...]:
    """A word with letters and digits folded, in pieces of 8 signs: ``Then,`` is ``a,``, ``THEN!!`` is ``A!!``."""
    return _shapes[word]


@functools.lru_cache(1 << 16)
def _odd(shape: str) -> bool:
    return not _PLAIN_SIGNS.issuperset(shape)


@functools.lru_cache(1 << 16)
def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature, 7) % DIM


class Reading:
    """A text cut into words and shapes once; what is counted of it is counted over distinct words and shapes."""

    def __init__(self, text: str) -> None:
        self.text, self.words = text, text.split()
        self.shapes = list(chain.from_iterable(map(_shapes.__getitem__, self.words)))
        self.shape_counts = Counter(self.shapes)

    @functools.cached_property
    def again(self) -> float:
        """Share of words that stood before in their window; windows have a fixed length, so long texts are judged like short ones."""
        words = self.words
        return 1 - sum(len(set(words[i:i + _WINDOW])) for i in range(0, len(words), _WINDOW)) / len(words)

    def fired(self) -> int:
        """The set of labellers that fire, as bits in the order of ``LABELLERS``."""
        if not self.words:
            return 0
        n, counts = len(self.words), Counter(self.words)
        odd = sum(k for s, k in self.shape_counts.items() if _odd(s)) / len(self.shapes)
        signs = len(_SIGN.findall(self.text)) / len(self.text)
        # Both can only fire on a text that has such signs at all.
        upper = sum(k for w, k in counts.items() if len(w) > 1 and _shapes[w][0][0] == "A") / n if any(s[0] == "A" for s in self.shape_counts) else 0.0
        bang = sum(k for w, k in counts.items() if w.endswith("!!")) / n if "!!" in self.text else 0.0
        same = sum(map(operator.eq, self.words, self.words[1:])) / n
        tests = (odd > 0.25, signs > 0.05, upper > 0.25 and n > 3, bang > 0.1, counts["|"] / n > 0.15, self.again > 0.5 and n > 8, same > 0.15 and n > 8)
        return sum(1 << k for k, t in enumerate(tests) if t)

    def features(self) -> np.ndarray:
        """Hashed shapes and pairs of shapes, each as the root of its share, and the share of words that come again."""
        found = np.zeros(DIM, np.float32)
        if not self.words:
            return found
        n = len(self.shapes)
        pairs = Counter(zip(self.shapes, self.shapes[1:]))
        places = [*map(bucket, self.shape_counts), *(bucket(f"{a} {b}") for a, b in pairs)]
        np.add.at(found, places, np.array([*self.shape_counts.values(), *pairs.values()]) / n)
        found[bucket(f"again {round(10 * self.again)}")] += 1
        return np.sqrt(found)


def fired(text: str) -> int:
    return Reading(text).fired()


def features(text: str) -> np.ndarray:
    return Reading(text).features()


def accuracies(patterns: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over firing sets and their counts: the share of bad texts, and each labeller's rate on bad and on good ones."""
    keys = np.array(sorted(patterns), np.int64)
    weight = np.array([patterns[k] for k in keys.tolist()], float)
    bits = (keys[:, None] >> np.arange(len(LABELLERS))) & 1
    share, bad, good = 0.1, np.full(len(LABELLERS), 0.4), np.full(len(LABELLERS), 0.01)
    for _ in range(rounds):
        p = _posterior(bits, share, bad, good)
        share = min(0.5, (p @ weight + 1) / (weight.sum() + 10))
        bad = ((p * weight) @ bits + 2) / ((p * weight).sum() + 5)
        good = np.minimum(0.1, (((1 - p) * weight) @ bits + 0.1) / (((1 - p) * weight).sum() + 10))
    return share, bad, good


def _posterior(bits: np.ndarray, share: float, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    log = np.log(share / (1 - share)) + bits @ np.log(bad / good) + (1 - bits) @ np.log((1 - bad) / (1 - good))
    return 1 / (1 + np.exp(-log))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft labels, by accelerated gradient steps."""
    if not len(x):
        return np.zeros(x.shape[1]), 0.0
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    rate = 4 / (np.square(x).sum(1).mean() + penalty)
    w, ahead, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(rounds):
        slope = x.T @ (1 / (1 + np.exp(-(x @ ahead))) - y) / len(y) + penalty * np.append(ahead[:-1], 0)
        new, next_t = ahead - rate * slope, (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / next_t * (new - w), new, next_t
    return w[:-1], float(w[-1])


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4096, threshold: float = 0.5, row_col: str | None = None) -> DataFrame:
    """For each row ``id_col``, ``fired`` (bits), ``weak_bad`` (posterior), ``score`` (1 is good) and ``kept`` (``score >= threshold``).

    The scorer is fitted on at most ``sample_rows`` different pairs of id and
    text, those with the smallest hashes; the labellers' accuracies come from
    all rows.  So neither the order nor the partitions of the input matter,
    nor null or repeated ids.  Null texts count as empty; empty texts fire
    nothing and their score is the scorer's intercept, so they stay where most
    texts are good.  Repeated rows get equal results.  ``row_col`` names a
    column that is handed through, a key of the rows where ids are none.
    """
    through = [] if row_col is None else [row_col]
    source = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *(F.col(c).alias("row") for c in through))
    kind = source.schema["id"].dataType.simpleString()

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _freed(slices(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([fired(t) for t in batch.column("text").to_pylist()], pa.int32())], ["fired"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _freed(slices(batches)):
            read = [Reading(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("pick"), pa.array([r.fired() for r in read], pa.int32()), pa.array([r.features().tobytes() for r in read], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["pick", "fired", "x"])

    patterns = {r["fired"]: r["count"] for r in source.select("text").mapInArrow(votes, "fired int").groupBy("fired").count().collect()}
    share, bad, good = accuracies(patterns)
    picked = source.select("text", F.xxhash64("id", "text").alias("pick"))
    chosen = picked.select("pick").distinct().orderBy("pick").limit(sample_rows)
    rows = semi_join(picked, chosen, "pick").mapInArrow(learnt, "pick long, fired int, x binary").dropDuplicates(["pick"]).collect()
    rows.sort(key=lambda r: r["pick"])
    bits = (np.array([r["fired"] for r in rows], np.int64)[:, None] >> np.arange(len(LABELLERS))) & 1 if rows else np.zeros((0, len(LABELLERS)))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, DIM)
    weights, base = logistic(x, 1 - _posterior(bits, share, bad, good))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _freed(slices(batches)):
            read = [Reading(t) for t in batch.column("text").to_pylist()]
            sets = np.array([r.fired() for r in read], np.int64)
            weak = _posterior((sets[:, None] >> np.arange(len(LABELLERS))) & 1, share, bad, good)
            scores = np.array([1 / (1 + np.exp(-(r.features() @ weights + base))) for r in read])
            columns = [batch.column("id"), pa.array(sets, pa.int32()), pa.array(weak), pa.array(scores), *(batch.column("row") for _ in through)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fired", "weak_bad", "score", *("row" for _ in through)])

    scored = source.mapInArrow(score, f"id {kind}, fired int, weak_bad double, score double" + "".join(f", row {source.schema['row'].dataType.simpleString()}" for _ in through))
    return scored.select(F.col("id").alias(id_col), "fired", "weak_bad", "score", (F.col("score") >= threshold).alias("kept"), *(F.col("row").alias(c) for c in through))
