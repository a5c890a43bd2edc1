"""Quality classifier: naive-Bayes support vectors over n-gram indicators, fitted by dual coordinate descent."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import fold, materialize, read, text_of

BITS = 18
THRESHOLD = 0.3
#: The classifier is fitted on at most so many labelled rows, those whose id's MD5 is smallest.
MOST_ROWS = 8000
COST = 1.0
ROUNDS = 12
WORDS_KEPT = 200_000
SPLIT = re.compile(r"[\x20\x09-\x0D]+")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|[0-9]+|(.)\1*", re.S)


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are, each run once."""
    return RUNS.sub(lambda m: "a" if (c := m.group()[0]).islower() else "A" if c.isupper() else "0" if "0" <= c <= "9" else c, word)


class Featurizer:
    """Indicators of a text: words, and 1- to 3-grams of word shapes in which a word repeated at once is "="."""

    def __init__(self, bits: int = BITS):
        self.size = 1 << bits
        self.words: dict[str, int] = {}
        self.codes = np.empty((1024, 2), np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words, new = {}, set(words)
        if new:
            n = len(self.words)
            if n + len(new) > len(self.codes):
                self.codes = np.concatenate([self.codes, np.empty((max(len(self.codes), len(new)), 2), np.int64)])
            for i, w in enumerate(new, n):
                self.words[w] = i
                self.codes[i] = zlib.crc32(w.lower().encode("utf-8", "replace")), zlib.crc32(shape(w).encode("utf-8", "replace"))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct feature numbers; an empty text has none."""
        words = [w for w in SPLIT.split(text) if w]
        if not words:
            return np.empty(0, np.int64)
        at = self.look_up(words)
        word, kind = self.codes[at].T
        kind = kind.copy()
        kind[1:][at[1:] == at[:-1]] = 61
        mix = lambda x: (x * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> 20
        pair = mix(kind[:-1] * 31 + mix(kind[1:] + 7))
        triple = mix(pair[:-1] * 17 + mix(kind[2:] + 11))
        return np.unique(np.concatenate([mix(word + 1), mix(kind + 2), pair, triple]) % self.size)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """log of (share of label 1's indicators) / (label 0's), smoothed; 0 for features that no row has."""
    p, q = np.zeros(size), np.zeros(size)
    for x, y in zip(rows, labels, strict=True):
        (p if y > 0 else q)[x] += 1
    seen = (p + q) > 0
    p, q = (p + smooth) / (p + smooth).sum(), (q + smooth) / (q + smooth).sum()
    return np.where(seen, np.log(p / q), 0.0)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of the linear hinge-loss model, one dual variable at a time in a random order."""
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x, v, y = rows[i], values[i], labels[i]
            g = y * (w[x] @ v + w[size]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if (d := new - alpha[i]) != 0:
                alpha[i] = new
                w[x] += d * y * v
                w[size] += d * y
                most = max(most, abs(d))
        if most < 1e-4:
            break
    return w


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method on smoothed targets."""
    n1, n0 = (label > 0).sum(), (label <= 0).sum()
    t = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


class Model:
    """weights: hinge weight times log ratio by feature, scaled per text by 1 / sqrt(number of features)."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / np.sqrt(max(len(x), 1)) + self.bias)

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -35, 35))))


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int = 1 << BITS, cost: float = COST) -> Model:
    """labels are 1 or -1. Without both labels the score is their smoothed share, whatever the text.

    The sigmoid is fitted on the margins of halves that the weights did not see.
    """
    if len(set(labels.tolist())) < 2:
        n1 = int((labels > 0).sum())
        return Model(np.zeros(size, np.float32), 0.0, 0.0, float(np.log((n1 + 1) / (len(labels) - n1 + 1))))

    def weights(which: np.ndarray) -> tuple[np.ndarray, float]:
        part, y = [rows[i] for i in which], labels[which]
        r = log_ratios(part, y, size)
        values = [r[x] / np.sqrt(max(len(x), 1)) for x in part]
        share = (y > 0).mean()
        c = np.where(y > 0, cost * 0.5 / max(share, 1e-3), cost * 0.5 / max(1 - share, 1e-3))
        w = dual_descent(part, values, y, size, c)
        return w[:size] * r, float(w[size])

    order = np.arange(len(rows))
    margins = np.zeros(len(rows))
    for k in (0, 1):
        train = order[order % 2 != k]
        if len(set(labels[train].tolist())) < 2:
            train = order
        w, b = weights(train)
        for i in order[order % 2 == k]:
            margins[i] = w[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + b
    slope, offset = sigmoid_fit(margins, labels)
    w, b = weights(order)
    return Model(w.astype(np.float32), b, slope, offset)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """A model from the labelled rows of ``docs``; at most ``most_rows`` (a fixed bound, not a share of the input).

    Executors turn texts into feature numbers; the driver gets those of the bounded sample alone.
    Rows without a label take no part; of labels that repeat for an id, the largest counts.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    wanted = docs.select(id_col, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_key")).join(marks, id_col).orderBy("_key", id_col).limit(most_rows)
    wanted = materialize(wanted, "quality-sample")
    chosen = docs.select(id_col, text_of(text_col).alias("_text")).join(F.broadcast(wanted), id_col).select("_key", "_label", "_text")  # most_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), pa.array([of(t).astype(np.int32).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["k", "y", "x"])

    got = sorted((r["k"], r["y"], bytes(r["x"])) for r in chosen.mapInArrow(run, "k string, y bigint, x binary").collect())
    return fit([np.frombuffer(x, np.int32).astype(np.int64) for _, _, x in got], np.array([1 if y > 0 else -1 for _, y, _ in got]))


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with ``out_col`` (replaced if there), the probability of label 1 for the whole text.

    Null texts count as empty; an empty text gets what bias and sigmoid give. Rows stay as they are.
    The model (2^18 weights, 1 MB) is broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    base = df.drop(out_col).withColumn("_text", text_of(text_col))
    schema = T.StructType([*df.drop(out_col).schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = Featurizer(), sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                out = [m.score(of(t)) for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names=schema.names)

    return base.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.where(fold() != 0), read(spark, sf_dir, "labels"))
    found = score(docs, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
