"""Quality scores from a Bradley-Terry model of preference pairs.

Each labelled good document is preferred to some labelled bad ones; the model is the weights w that make
sigmoid(w . (features(good) - features(bad))) likely, fitted by Newton's method on the logistic loss of feature
differences, so a score is the strength of a document in the Bradley-Terry sense.  Features are counts over the
whole text (letters, marks, words, repeats), each also as indicators of its quantile bins, so an effect need not
be monotone.  The threshold is a quantile of the scores of the documents fitted on, at the share of bad ones.
Where there are more labels than the fit reads, those it reads count, for the threshold and the slope, as often as
there are labelled documents of their label for each, so both hold for all of them.

Scale: the fit reads at most `most_labels` labelled documents (those of least hash; the bound of what reaches
the driver) and draws at most `most_pairs` preference pairs from them; scoring is one pass over the documents without
a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MOST_LABELS = 8_000
MOST_PAIRS = 12_000
BINS = 10
THRESHOLD = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:?'\"()-"]] = True


def _repeats(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the number of distinct values, and how often the most frequent one is there."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if not len(h):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    runs = np.diff(np.r_[first, len(h)])
    top = np.zeros(n)
    np.maximum.at(top, row[first], runs)
    return np.bincount(row[first], minlength=n).astype(float), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features per text; an empty text has zeros."""
    part, at, n = data[offsets[0] : offsets[-1]], offsets - offsets[0], len(offsets) - 1

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    size = np.maximum(np.diff(at), 1).astype(float)
    letters, upper, marks = share(_LETTER[part]), share(_UPPER[part]), share(_MARK[part])
    h, row = common.hashed_words(data, offsets)
    starts, ends = common.word_bounds(part, at) if len(part) else (np.zeros(0, np.int64),) * 2
    words = np.bincount(row, minlength=n).astype(float)
    w = np.maximum(words, 1)
    per = lambda values: np.bincount(row, values, n) / w
    length = (ends - starts).astype(float)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    near = np.zeros(len(h), bool)
    near[2:] = (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    distinct, top = _repeats(h, row, n)
    two = np.flatnonzero(row[1:] == row[:-1])
    pairs, top_pair = _repeats(common.mix(h[1:] * np.uint64(3) + h[:-1])[two], row[1:][two], n) if len(h) > 1 else (np.zeros(n), np.zeros(n))
    lines = share(part == 10) + 1
    return np.stack([
        np.log1p(words), letters / size, upper / np.maximum(letters, 1), marks / size, (marks - share(_PLAIN[part])) / size, share(_DIGIT[part]) / size,
        per(length), per(length <= 3), per(length > 14), per(same), per(near), distinct / w ** 0.8, np.log(w) - np.log(np.maximum(distinct, 1)), top / w, pairs / np.maximum(words - 1, 1), top_pair / w,
        per(_MARK[part[ends - 1]] if len(h) else np.zeros(0)), per(_UPPER[part[starts]] if len(h) else np.zeros(0)), share(part == ord("!")) / w, share(part == ord("|")) / w, share(part == ord(".")) / w, np.log1p(w / lines), np.log(lines), per(length == 1),
    ], 1)


class Model:
    """Weights over standardised features and their bins, and the line from scores to (0, 1)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1, ridge: float = 1.0, totals: tuple[int, int] | None = None, most_pairs: int = MOST_PAIRS):
        """totals: how many documents of labels 0 and 1 x is a sample of; without it x is all of them.  most_pairs: up
        to so many all pairs of a good and a bad document are fitted on; of more, so many (or one for each document) in
        which every document is, and those of one label about equally often."""
        self.weights = None
        if not (y == 1).any() or not (y == 0).any():
            return
        self.edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self.design(x)
        rng = np.random.default_rng(seed)
        good, bad = (rng.permutation(np.flatnonzero(y == v)) for v in (1, 0))
        if len(good) * len(bad) <= most_pairs:
            one, other = np.repeat(good, len(bad)), np.tile(bad, len(good))
        else:
            n = max(most_pairs, len(good), len(bad))
            one, other = np.resize(good, n), rng.permutation(np.resize(bad, n))
        d = z[one] - z[other]
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        s = z @ w
        counts = np.array([(y == 0).sum(), (y == 1).sum()], float)
        totals = counts if totals is None else np.array(totals, float)
        times = (totals / counts)[(y == 1).astype(int)]
        order = np.argsort(s, kind="stable")
        ordered, upto = s[order], np.cumsum(times[order])
        k = min(int(np.searchsorted(upto, totals[0] * (1 - 1e-9))) + 1, len(s) - 1)
        self.cut = float(ordered[k - 1] + ordered[k]) / 2  # the quantile at the share of bad ones
        # The slope: logistic regression of the label on the distance to the cut, by bisection of its gradient.
        t, low, high = s - self.cut, 0.01, 20.0
        for _ in range(50):
            a = (low + high) / 2
            p = 1 / (1 + np.exp(-np.clip(a * t + math.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))
            low, high = (a, high) if (times * (y - p) * t).sum() > 0 else (low, a)
        self.slope = low

    def design(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([(x[:, j, None] > self.edges[None, :, j]) for j in range(x.shape[1])], 1).reshape(len(x), -1)
        return np.hstack([np.clip((x - self.mean) / self.scale, -6, 6), bins.astype(float)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), THRESHOLD)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.design(x) @ self.weights - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, most_labels: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(features, labels) of the labelled documents, half of most_labels at most of each label, those of the least
    hash, and how many labelled documents there are of each.

    A document whose labels contradict each other has none; labels of no document, other than 0 and 1, or without an
    id don't count.  Rows that share a doc_id are one labelled document, with the text of the least hash.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    named = named.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text"), F.xxhash64("text").alias("hash"))
    known = common.settled(texts.join(named, F.col("doc") == F.col("id")).groupBy("id", "label").agg(F.min("hash").alias("least")))
    sums = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(most_labels // 2) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most most_labels rows

    def measured(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(0))
            x = [features(data, offsets[lo : hi + 1]) for lo, hi in common.slices(offsets)]
            yield pa.record_batch([*batch.columns[1:], pa.array(list(np.concatenate(x)) if x else [], pa.list_(pa.float64()))], names=["id", "label", "x"])

    got = texts.join(chosen, (F.col("doc") == F.col("id")) & (F.col("hash") == F.col("least"))).select("text", "id", "label")
    rows = got.mapInArrow(measured, "id long, label int, x array<double>").dropDuplicates(["id"]).sort("id").toPandas()  # at most most_labels rows
    x, y = (np.array(rows["x"].tolist(), float), rows["label"].to_numpy()) if len(rows) else (np.zeros((0, 1)), np.zeros(0))
    return x, y, (sums.get(0, 0), sums.get(1, 0))


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, most_pairs: int = MOST_PAIRS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality), as labelled() reads them."""
    x, y, totals = labelled(docs, labels, most_labels)
    return Model(x, y, totals=totals, most_pairs=most_pairs)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with a column score_col, 0 to 1 and at least THRESHOLD for what the model keeps; it replaces one so named.

    Null and empty texts get the score of a text without words; without labels of both kinds all get THRESHOLD.
    """
    fields = [f for f in docs.schema.fields if f.name != score_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{score_col}` double"
    at = [f.name for f in fields].index(text_col)

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column(at))
            scores = [model.score(features(data, offsets[lo : hi + 1])) for lo, hi in common.slices(offsets)]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, score_col])

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to learn from: never those of held-out documents."""
    return common.table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, known_labels(spark, sf_dir)))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
