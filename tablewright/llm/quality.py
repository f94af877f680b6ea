"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log-count ratio of the classes, and a linear model with hinge loss is fitted to
them by dual coordinate descent. N-grams are runs of 2 to 4 bytes, words, pairs of words, and the pattern of words that
equal one of the three words before them, as its rounded share. All are hashed to a fixed number of features.

The ratios count every labelled text. The support vectors come from a sample of bounded size, as many of each class; the
scores are calibrated on parts of it that the model did not see, weighted back to the classes' true shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import broadcast_if_small, lean, small_batches
from tablewright.llm.texts import mix, slices, split_words
from tablewright.session import cut_lineage

BITS = 17
SIZE = 1 << BITS
SAMPLE = 2000  # labelled texts of each class that the linear model is fitted to, at most
SAMPLE_FEATURES = 24_000_000  # features of these texts together, at most: 4 bytes each on the driver
EPOCHS, COST = 12, 1.0


def doc_features(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text of a slice, ascending."""
    words = split_words(data, bounds)
    hashes = words.hashes()
    shift, factor = np.uint32(32 - BITS), np.uint32(0x9E3779B1)
    grams = []
    with np.errstate(over="ignore"):
        code = data.astype(np.uint32)
        run = code
        for n in (2, 3, 4):
            run = run[:-1] + (code[n - 1:] << np.uint32(8 * (n - 1))) if len(code) >= n else code[:0]
            grams.append(((run + np.uint32(n)) * factor >> shift).astype(np.int32))
        wide = np.uint64(64 - BITS)
        single = (mix(hashes) >> wide).astype(np.int32)
        pair = (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> wide).astype(np.int32) if len(hashes) else single
    same = np.zeros((4, len(hashes)), dtype=bool)
    for lag in (1, 2, 3):
        same[lag, lag:] = hashes[lag:] == hashes[:-lag] if len(hashes) > lag else False
    first = np.searchsorted(words.doc, np.arange(words.docs + 1))
    seen = np.zeros(SIZE, dtype=bool)
    for d in range(words.docs):
        a, b = bounds[d], bounds[d + 1]
        for n, g in zip((2, 3, 4), grams):
            seen[g[a:max(b - n + 1, a)]] = True
        p, q = first[d], first[d + 1]
        seen[single[p:q]] = True
        seen[pair[p:max(q - 1, p)]] = True
        for lag in (1, 2, 3):
            if q - p > lag:
                share = same[lag, p + lag:q].mean()
                seen[lag * 16 + int(np.log2(1 + 1000 * share))] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


@dataclass
class QualityModel:
    """``weights`` by feature, already scaled by the ratios; ``scale`` turns a margin into a probability."""

    weights: np.ndarray
    norm: np.ndarray  # squared ratio by feature, for the length of a text's vector
    bias: float
    scale: tuple[float, float]

    def score(self, features: np.ndarray) -> float:
        length = np.sqrt(self.norm[features].sum())
        margin = self.bias + (self.weights[features].sum() / length if length else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -500, 500))))


def dual_descent(vector: Callable[[int], tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = COST,
                 epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights of the linear model with hinge loss; the last is the bias. Visits one dual variable at a time, in seeded order.

    ``vector(i)`` gives the positions and values of row ``i``.
    """
    w, alpha = np.zeros(size + 1), np.zeros(len(y))
    diag = np.array([float(v @ v) + 1 for _, v in map(vector, range(len(y)))])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = vector(i)
            gradient = y[i] * (w[f] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / diag[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def _calibrate(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        s = weight * p * (1 - p)
        grad = np.array([(weight * (p - y) * m).sum() + 1e-2 * a, (weight * (p - y)).sum() + 1e-2 * b])
        hess = np.array([[(s * m * m).sum() + 1e-2, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold a feature, of one task; feature ``SIZE`` counts the texts."""
    total = np.zeros((2, SIZE + 1), dtype=np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy()
        for first, last, data, bounds in slices(batch.column(0)):
            for y, found in zip(label[first:last], doc_features(data, bounds)):
                total[y, found] += 1
                total[y, SIZE] += 1
    at = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], names=["f", "n0", "n1"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, bounds in slices(batch.column(0)):
            found = [f.astype(np.int32) for f in doc_features(data, bounds)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1).slice(first, last - first),
                                              batch.column(2).slice(first, last - first)], names=["features", "y", "place"])


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                sample: int = SAMPLE, cost: float = COST, epochs: int = EPOCHS, smoothing: float = 1.0,
                sample_features: int = SAMPLE_FEATURES) -> QualityModel:
    """A model of ``label`` (0 or 1) from the texts of ``docs`` whose key has a label.

    Rows of ``labels`` with a NULL or other label or key are left out; of several labels of a key the larger counts. Labels are
    joined by key and nothing but the text is an input. ``sample`` bounds the texts of each class that the linear model is
    fitted to, the first by a hash of the key, and ``sample_features`` their features together. With labels of one class only, or none, every score is that class or 0.5.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    marked = marked.withColumn("place", F.md5(F.col("key").cast("string")))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    labelled = texts.join(broadcast_if_small(marked), "key").select("text", "y")
    sums = small_batches(labelled).mapInArrow(lean(_counts), "f int, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    held = sums.toPandas()  # one row a feature: SIZE + 1 at most
    counts = np.zeros((2, SIZE + 1))
    counts[:, held["f"].to_numpy(dtype=np.int64)] = held[["n0", "n1"]].to_numpy(dtype=float).T
    have, counts = counts[:, SIZE], counts[:, :SIZE]
    if not have.all():
        flat = 0.5 if not have.any() else float(have[1] > 0)
        return QualityModel(np.zeros(SIZE), np.zeros(SIZE), 0.0, (0.0, 60.0 * (2 * flat - 1)))
    share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    ratio[counts.sum(axis=0) == 0] = 0.0
    chosen = None  # 2 * sample rows at most, so the join may broadcast them
    for y in (0, 1):
        own = marked.filter(F.col("y") == y).orderBy("place").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = cut_lineage(texts.join(F.broadcast(chosen), "key").select("text", "y", "place").mapInArrow(lean(_listed), "features array<int>, y int, place string"))
    sizes = sorted((r["place"], r["n"]) for r in rows.select("place", F.size("features").alias("n")).collect())
    within = int(np.searchsorted(np.cumsum([n for _, n in sizes]), sample_features, side="right"))
    if within < len(sizes):  # both classes end at the same place of the hash order
        rows = rows.filter(F.col("place") < sizes[within][0])
    held = rows.toArrow().sort_by("place").combine_chunks()
    y = held["y"].to_numpy()
    lists = held["features"].chunk(0) if held.num_rows else pa.array([], pa.list_(pa.int32()))
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()

    def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
        f = flat[ends[i]:ends[i + 1]]
        v = ratio[f]
        length = np.sqrt(v @ v)
        return f, v / length if length else v

    sign, fold = 2.0 * y - 1, np.arange(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):
        train = np.flatnonzero(fold != k)
        w = dual_descent(lambda i, train=train: vector(train[i]), sign[train], SIZE, cost, epochs)
        for i in np.flatnonzero(fold == k):
            f, v = vector(i)
            margins[i] = w[f] @ v + w[-1]
    weight = np.where(y == 1, have[1] / max((y == 1).sum(), 1), have[0] / max((y == 0).sum(), 1))
    scale = _calibrate(margins, y.astype(float), weight / weight.mean())
    w = dual_descent(vector, sign, SIZE, cost, epochs)
    return QualityModel(w[:-1] * ratio, ratio**2, float(w[-1]), scale)


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with a column ``score``, the probability of label 1 by the whole text.

    NULL and empty texts are scored by the model's bias; equal texts have equal scores. A column named ``score`` is replaced. No
    shuffle.
    """
    kept = [c for c in df.columns if c != score]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in slices(batch.column(text)):
                values = [model.score(f) for f in doc_features(data, bounds)]
                yield batch.slice(first, last - first).append_column(score, pa.array(values, pa.float64()))

    return small_batches(df.select(*kept)).mapInArrow(lean(run), schema)
