"""Toxicity by a chain of linear classifiers over hashed words.

Categories are predicted one after the other.  Each model reads the words of a
text and the probabilities of the categories before it; those come, while it is
fitted, from models that did not see the row (out-of-fold), so that a later
model learns from probabilities as it will meet them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import semi_join, slices, text_of
from pagemill.llm.quality import logistic
from pagemill.session import written

_WORD = re.compile(r"[^\W\d_]+")
FOLDS = 5


def words(text: str) -> set[str]:
    """The distinct words of a whole text, in lower case."""
    return set(_WORD.findall(text.lower()))


@dataclass
class Linear:
    """A linear model over chosen words and the earlier categories' probabilities."""

    weights: dict[str, float]
    earlier: list[float]
    base: float

    def probability(self, found: set[str], earlier: list[float]) -> float:
        z = self.base + sum(self.weights[w] for w in found & self.weights.keys())
        z += sum(w * p for w, p in zip(self.earlier, earlier))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def chosen_words(rows: DataFrame, categories: int, least_rows: int, least_gain: float) -> list[dict[str, set[int]]]:
    """For each category the words whose share among the labelled differs clearly (G-test), and for which fits.

    Fit ``f`` leaves out fold ``f``; fit ``FOLDS`` leaves out none.  Words are
    counted and chosen by Spark, and only the chosen ones are collected.
    """
    sizes = [F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in range(FOLDS)]
    hits = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("labels")[k])), F.lit(0)).alias(f"y{k}_{f}") for k in range(categories) for f in range(FOLDS)]
    total = rows.agg(*sizes, *hits).first()
    counts = rows.select("fold", "labels", F.explode("words").alias("word")).groupBy("word").agg(*sizes, *hits)

    def in_fits(k: int):
        fits = []
        for left_out in range(FOLDS + 1):
            used = [f for f in range(FOLDS) if f != left_out]
            n, positives = sum(total[f"n_{f}"] for f in used), max(1, sum(total[f"y{k}_{f}"] for f in used))
            seen, hit = sum(F.col(f"n_{f}") for f in used), sum(F.col(f"y{k}_{f}") for f in used)
            expected = F.greatest(seen * positives / F.lit(max(1, n)), F.lit(1e-9))
            gain = 2 * hit * F.log(F.greatest(hit, F.lit(1e-9)) / expected)
            clear = (hit >= least_rows) & (hit > 2 * expected) & (gain > least_gain)
            fits.append(F.when(clear, F.lit(left_out)))
        return F.array_compact(F.array(*fits)).alias(f"in{k}")

    picked = counts.select("word", *(in_fits(k) for k in range(categories))).filter(" OR ".join(f"size(in{k}) > 0" for k in range(categories)))
    found: list[dict[str, set[int]]] = [{} for _ in range(categories)]
    for row in picked.collect():
        for k in range(categories):
            if row[f"in{k}"]:
                found[k][row["word"]] = set(row[f"in{k}"])
    return found


def _fit(docs: list[set[str]], labels: np.ndarray, vocabulary: list[str], earlier: np.ndarray) -> Linear:
    place = {w: k for k, w in enumerate(vocabulary)}
    x = np.zeros((len(docs), len(place) + earlier.shape[1]))
    for row, doc in enumerate(docs):
        x[row, [place[w] for w in doc & place.keys()]] = 1
    x[:, len(place):] = earlier
    weights, base = logistic(x, labels, penalty=1e-3)
    return Linear(dict(zip(vocabulary, weights.tolist())), weights[len(place):].tolist(), base)


def fit_chain(docs: list[set[str]], folds: np.ndarray, targets: np.ndarray, chosen: list[dict[str, set[int]]]) -> list[Linear]:
    """A model for each column of ``targets``, in order, each fitted with out-of-fold probabilities of those before."""
    earlier, models = np.zeros((len(docs), 0)), []
    for k in range(targets.shape[1]):
        of = lambda fit: sorted(w for w, fits in chosen[k].items() if fit in fits)
        models.append(_fit(docs, targets[:, k], of(FOLDS), earlier))
        out = np.zeros(len(docs))
        for f in range(FOLDS):
            train, test = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            if len(train) and len(test):
                model = _fit([docs[i] for i in train], targets[train, k], of(f), earlier[train])
                out[test] = [model.probability(docs[i], earlier[i].tolist()) for i in test]
        earlier = np.column_stack([earlier, out])
    return models


def learnt_chain(source: DataFrame, labels: DataFrame, categories: int, sample_rows: int, least_rows: int, least_gain: float) -> list[Linear]:
    """Fit on labelled rows of ``source`` (``id``, ``text``); ``labels`` has ``id`` and the array ``labels``."""
    marks = labels.filter("id IS NOT NULL").groupBy("id").agg(*(F.max(F.col("labels")[k]).alias(f"y{k}") for k in range(categories)))
    marks = marks.select("id", F.array(*(f"y{k}" for k in range(categories))).alias("labels")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    marked = source.join(written(marks, "toxicity-labels"), "id").select("labels", "text", F.xxhash64("id", "text").alias("pick"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("pick"), batch.column("labels"), pa.array(found, pa.list_(pa.string()))], ["pick", "labels", "words"])

    picks = marked.select("pick").distinct().orderBy("pick").limit(sample_rows)
    rows = semi_join(marked, picks, "pick").mapInArrow(read, "pick long, labels array<int>, words array<string>").dropDuplicates(["pick"])
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("pick"), F.lit(FOLDS)).cast("int")), "toxicity-rows")
    chosen = chosen_words(rows, categories, least_rows, least_gain)
    vocabulary = sorted(set().union(*chosen))
    # Of each row only chosen words come to the driver: at most ``sample_rows`` short lists.
    held = F.array_intersect("words", F.lit(vocabulary)) if vocabulary else F.array().cast("array<string>")
    fitted = sorted(rows.select("pick", "fold", "labels", held.alias("words")).collect(), key=lambda r: r["pick"])
    if not fitted:
        return []
    return fit_chain([set(r["words"]) for r in fitted], np.array([r["fold"] for r in fitted]), np.array([r["labels"] for r in fitted], float), chosen)


def toxicity(
    df: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8192,
    threshold: float = 0.5, least_rows: int = 3, least_gain: float = 12.0,
) -> DataFrame:
    """For each row ``id_col``, ``p_<category>`` in the order of the chain, and ``flagged`` (the first is at ``threshold`` or more).

    ``labels`` has ``id_col`` and the categories as 0/1 columns (null: 0); an
    id labelled more than once counts by its largest labels, a null id not at
    all.  The models are fitted on at most ``sample_rows`` labelled ids, those
    with the smallest hashes, and on as many different texts of theirs; every
    text is read whole and judged.  Null and empty texts have no words: the
    models' intercepts judge them.  Without labelled rows every probability
    is 0.
    """
    source = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    marks = labels.select(F.col(id_col).alias("id"), F.array(*(F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in categories)).alias("labels"))
    models = learnt_chain(source, marks, len(categories), sample_rows, least_rows, least_gain)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set().union(*(m.weights for m in models)) if models else set()
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                found, earlier = known & set(_WORD.findall(text.lower())), []
                for model in models:
                    earlier.append(model.probability(found, earlier))
                out.append(earlier or [0.0] * len(categories))
            columns = [pa.array([o[k] for o in out], pa.float64()) for k in range(len(categories))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *(f"p_{c}" for c in categories)])

    judged = source.mapInArrow(judge, f"id {kind}, " + ", ".join(f"p_{c} double" for c in categories))
    return judged.select(F.col("id").alias(id_col), *(f"p_{c}" for c in categories), (F.col(f"p_{categories[0]}") >= threshold).alias("flagged"))
