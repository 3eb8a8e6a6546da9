"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings. Labelled texts that mention an identity (a
religion, gender, origin, orientation or ability) are paired with a copy in which each such term is swapped for
another of its group, and training penalises the difference of the two scores: the mention of a group by itself
cannot make a text toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, carried, in_fold, read_table, table_of, with_small_batches

#: The bound of the labelled sample: so many rows of either label, lowest hash of the id first.
TRAIN_A_LABEL = 3072
#: Features kept, those that tell the labels apart best.
FEATURES = 2048
#: Lengths of the beginnings of words that count besides the whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words whose features a scoring task keeps.
KNOWN_WORDS = 100_000
THRESHOLD = 0.7
SWAP_PENALTY = 4.0
RIDGE = 1e-3
STEPS = 150

# Identity terms by group; a term is swapped for the next of its group.
IDENTITY_TERMS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["man", "woman"],
    ["men", "women"],
    ["male", "female"],
    ["boy", "girl"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["gay", "lesbian", "bisexual", "straight", "transgender", "queer"],
    ["deaf", "blind", "disabled", "autistic"],
    ["immigrant", "refugee", "foreigner"],
    ["immigrants", "refugees", "foreigners"],
]
_SWAP = {a: group[(k + 1) % len(group)] for group in IDENTITY_TERMS for k, a in enumerate(group)}
_WORD = re.compile(r"[^\W\d_]+")
_SCORES = "doc_id long, held_out boolean, score double, predicted int"


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [zlib.crc32(word.encode("utf-8", "surrogatepass"))] + [zlib.crc32(f"{word[:n]}*".encode("utf-8", "surrogatepass")) for n in BEGINNINGS if len(word) > n]


def counted(words: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and in how many distinct words each occurs."""
    return np.unique(np.array([f for w in words for f in features_of(w)], np.int64), return_counts=True)


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        out = []
        for text in batch.column("text").to_pylist():
            words = distinct_words(text)
            swapped = {_SWAP.get(w, w) for w in words}
            f, n = counted(words)
            g, m = counted(swapped) if swapped != words else (f[:0], n[:0])
            out.append((f, n, g, m))
        lists = [pa.array([x[k] for x in out], pa.list_(pa.int64() if k % 2 == 0 else pa.int32())) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *lists], names=["id", "y", "f", "n", "g", "m"])


class Model:
    """Weights by feature; strength(n) is what n words with a feature count."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.weights = dict(zip(features.tolist(), weights.tolist(), strict=True))
        self.bias = bias
        self._known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        counts: dict[int, int] = {}
        known, weights = self._known, self.weights
        for w in distinct_words(text):
            if (found := known.get(w)) is None:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                found = known[w] = tuple(f for f in features_of(w) if f in weights)
            for f in found:
                counts[f] = counts.get(f, 0) + 1
        z = self.bias + sum(weights[f] * float(strength(n)) for f, n in sorted(counts.items()))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def strength(n):
    return np.log2(1 + n)


def chosen_features(counted: DataFrame) -> np.ndarray:
    """The FEATURES features that tell the labels apart best, in ascending order, from rows with y and f; ties go to the lower feature.

    An aggregate over the sampled rows: the driver gets FEATURES numbers, however long the texts are.
    """
    sums = counted.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    n_1, n_0 = sums[0], sums[1] - sums[0]
    by = counted.select("y", F.explode("f").alias("feature")).groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    share_1, share_0 = (F.col("a") + 0.5) / (n_1 + 1), (F.col("b") + 0.5) / (n_0 + 1)
    told = by.where("a + b >= 3").select("feature", ((share_1 - share_0) ** 2 / (share_1 + share_0)).alias("told"))
    return np.array(sorted(r.feature for r in told.orderBy(F.desc("told"), "feature").limit(FEATURES).collect()), np.int64)


def _chosen_rows(sent):
    """Rows cut to the chosen features: their places and counts, and for a swapped text the new counts where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = sent.value

        def places(f, n) -> np.ndarray:
            f, n = np.array(f, np.int64), np.array(n, np.int64)
            at = np.searchsorted(features, f).clip(max=len(features) - 1)
            kept = features[at] == f
            full = np.zeros(len(features), np.int64)
            full[at[kept]] = n[kept]
            return full

        for batch in batches:
            out: list[list[bytes]] = [[], [], [], []]
            for f, n, g, m in zip(*(batch.column(c).to_pylist() for c in "fngm"), strict=True):
                own = places(f, n)
                swapped = places(g, m) if g else own
                for k, (at, values) in enumerate(((np.flatnonzero(own), own), (np.flatnonzero(swapped != own), swapped))):
                    out[2 * k].append(at.astype("<u2").tobytes())
                    out[2 * k + 1].append(values[at].clip(max=65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *[pa.array(x, pa.binary()) for x in out]], names=["id", "y", "at", "n", "swap_at", "swap_n"])

    return run


def train(features: np.ndarray, rows: pa.Table) -> Model:
    """rows, of _chosen_rows: y, places at with counts n, and swap_at with swap_n where the swapped text's counts differ.

    Holds one matrix of rows by features and one of the swapped rows' differences, both of 4-byte floats: with the
    bounds 2 * TRAIN_A_LABEL and FEATURES at most 50 MB each. Folds are weights of 0, not copies.
    """
    y = rows.column("y").to_numpy().astype(np.float64)
    if not len(features) or not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -4, 4)))
    x = np.zeros((len(y), len(features)), np.float32)
    pairs, change = [], []
    for i in range(len(y)):
        at, n, swap_at, swap_n = (np.frombuffer(rows.column(c)[i].as_py(), "<u2") for c in ("at", "n", "swap_at", "swap_n"))
        x[i, at] = strength(n.astype(np.float32))
        if len(swap_at):
            other = np.zeros(len(features), np.float32)
            other[swap_at] = strength(swap_n.astype(np.float32)) - x[i, swap_at]
            pairs.append(i)
            change.append(other)
    pairs, change = np.array(pairs, np.int64), np.stack(change) if change else x[:0]
    fold = np.arange(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):  # margins of rows that the weights were not fitted on
        w, bias = _descended(x, y, change, fold != k, fold[pairs] != k)
        margins[fold == k] = (x @ w + bias)[fold == k]
    scale, shift = _calibration(margins, y)
    w, bias = _descended(x, y, change, np.ones(len(y), bool), np.ones(len(pairs), bool))
    return Model(features, scale * w.astype(np.float64), scale * bias + shift)


def _descended(x: np.ndarray, y: np.ndarray, change: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias from the marked rows and pairs, by accelerated gradient descent; either label has half of the weight."""
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    n_1 = y[rows].sum()
    weight = (np.where(y == 1, 0.5 / max(n_1, 1), 0.5 / max(rows.sum() - n_1, 1)) * rows).astype(np.float32)
    kept, n_pairs = pairs.astype(np.float32), int(pairs.sum())
    steepest = 0.25 * float(weight @ (np.einsum("ij,ij->i", x, x) + 1)) + RIDGE + (SWAP_PENALTY * float(kept @ np.einsum("ij,ij->i", change, change)) / n_pairs if n_pairs else 0)
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ ahead + ahead_bias).clip(-30, 30)))
        err = weight * (p - y).astype(np.float32)
        slope = x.T @ err + RIDGE * ahead
        if n_pairs:
            slope += SWAP_PENALTY / n_pairs * (change.T @ (kept * (change @ ahead)))
        w_new, bias_new = (ahead - slope / steepest).astype(np.float32), ahead_bias - float(err.sum()) / steepest
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        rate = np.float32((t - 1) / t_new)
        ahead, ahead_bias = w_new + rate * (w_new - w), bias_new + float(rate) * (bias_new - bias)
        w, bias, t = w_new, bias_new, t_new
    return w, bias


def _calibration(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the margins by a logistic fit in one dimension, by Newton steps; the scale is 1 at least."""
    ones = np.stack([margins, np.ones(len(y))], axis=1)
    weight = np.where(y == 1, max(1.0, ((len(y) - y.sum()) / y.sum()) ** 0.5), 1.0)  # between the labels' own shares and equal ones
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(ones @ at).clip(-30, 30)))
        slope = ones.T @ (weight * (p - y)) + 0.01 * (at - [1.0, 0.0])
        curve = (ones * (weight * p * (1 - p))[:, None]).T @ ones + 0.01 * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return (float(at[0]), float(at[1])) if np.isfinite(at).all() and at[0] >= 1 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, learn, a_label: int = TRAIN_A_LABEL) -> Model:
    """Fit on a_label ids of either label at most, lowest hash first; learn says which ids may be learned from.

    The sampled texts become a written table of features; the driver gets the chosen features' numbers and, for each
    sampled row, its chosen features alone (4 bytes each). Of rows that repeat an id the text with the lowest hash is
    learned from, so repeated rows don't add to the sample.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("mark_id"), F.col("toxic").cast("int").alias("mark")).where(F.col("mark").isin(0, 1) & F.col("mark_id").isNotNull() & learn("mark_id"))
    picked = [(r.mark_id, k) for k in (0, 1) for r in marks.where(F.col("mark") == k).select("mark_id", F.xxhash64("mark_id").alias("h")).distinct().orderBy("h", "mark_id").limit(a_label).collect()]
    marked = F.broadcast(spark.createDataFrame(picked, "mark_id long, mark int"))  # 2 * a_label rows
    texts = docs.select(F.col("doc_id").cast("long").alias("mark_id"), F.col("text").alias("body")).join(marked, "mark_id")
    one = texts.groupBy("mark_id", "mark").agg(F.min_by("body", F.xxhash64("body")).alias("text"))
    rows = one.select(F.col("mark_id").alias("id"), F.col("mark").alias("y"), "text")
    counted = table_of(with_small_batches(rows).mapInArrow(_counted_rows, "id long, y int, f array<long>, n array<int>, g array<long>, m array<int>"), "toxicity-features")
    features = chosen_features(counted)
    sent = spark.sparkContext.broadcast(features)
    found = counted.mapInArrow(_chosen_rows(sent), "id long, y int, at binary, n binary, swap_at binary, swap_n binary").toArrow() if len(features) else counted.select("id", "y").toArrow()
    return train(features, found.sort_by([("id", "ascending"), ("y", "ascending")]))  # the same model however the rows were dealt


def score_toxicity(docs: DataFrame, model: Model, held_out=None, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text of docs, and the columns of docs named in carry.

    Defined cases: a null or empty text, or one without known words, gets the model's score for no words; without
    labels of both kinds the score is the same for all; repeated rows get a row each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            scores = np.array([sent.value.score(t) for t in batch.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), *[batch.column(f"carry_{c}") for c in carry]], names=["doc_id", "held_out", "score", "predicted", *[f"carry_{c}" for c in carry]])

    out = F.lit(None).cast("boolean") if held_out is None else held_out
    return carried(docs, out, carry, run, _SCORES)


def learnable(col: str):
    return ~in_fold(col, 3, 1)


def op9_counterfactual(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"), learnable)
    return score_toxicity(docs, model, in_fold("doc_id", 3, 1))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op9_counterfactual": op9_counterfactual}
