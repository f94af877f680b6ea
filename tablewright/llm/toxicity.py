"""Toxicity classifier: a convolutional text classifier with max pooling, trained in numpy.

A word's vector is the sum of hashed vectors of the word and of its beginnings, so forms of one stem share most of it. Filters of
several widths run over the vectors of neighbouring words; each keeps its largest value of a text, and a linear layer over
those gives a margin. Vectors that training never saw are zero, so unknown words say nothing.

The network learns from every labelled text. Texts are dealt by a hash of their key to shards and held in coded form; in an
epoch each shard's task descends along its own texts, and what the tasks changed is averaged, a vector over those shards that
moved it. A quarter of the texts is kept apart to calibrate a threshold for each language, found by the commonest function words
of a text; scores are shifted so that every language's threshold is ``THRESHOLD``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import broadcast_if_small, lean, small_batches
from tablewright.llm.texts import Words, hash_spans, mix, running_sum, slices, split_terms
from tablewright.session import cut_lineage

BITS, WIDTH = 18, 8  # 2**BITS vectors of WIDTH numbers
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word's beginnings that have vectors of their own
WIDTHS, FILTERS = (1, 2, 3), 12  # words that a filter sees; filters of each width
GAP = max(WIDTHS) - 1  # places that the last window of a text sees beyond it
SHARD_BYTES = 64 << 20  # labelled text that one task learns from in an epoch, about
BLOCK_BYTES = 256 << 10  # text that is coded together
STATE_ROWS = 4096  # rows of the network's state that are averaged together
MARGIN_STEP = 1 / 1024  # margins of texts kept apart are counted by steps of this size
EPOCHS, BATCH, RATE, DROP = 12, 32, 0.05, 0.1
WINDOWS = 1 << 13  # windows whose filters are computed at a time
THRESHOLD = 0.3  # score from which a text counts as toxic

# fixed values: the commonest function words of each language
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as on by this",
    "de": "der die und das den von mit sich des auf ist nicht ein zu auch",
    "fr": "le la les des du et en un une que pour dans qui est pas",
    "es": "el los las del y que en un una por con para se su al",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _word_numbers(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([0, *map(len, raw)])
    return hash_spans(np.frombuffer(b"".join(raw), dtype=np.uint8), ends[:-1], ends[1:])


_KNOWN = {n: np.sort(_word_numbers(w.split())) for n, w in FUNCTION_WORDS.items()}


def languages(distinct: np.ndarray, number: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Each text's number in ``LANGUAGES``: that of most function words, the first of equals, the last if there are none."""
    counts = np.zeros((len(LANGUAGES), docs))
    for i, known in enumerate(_KNOWN.values()):
        near = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        counts[i] = np.bincount(doc[(known[near] == distinct)[number]], minlength=docs)
    counts[-1] = 0.5
    return counts.argmax(axis=0)


@dataclass
class Coded:
    """Texts as numbers: each word's number among the distinct words, and the vectors that each distinct word sums."""

    distinct: np.ndarray  # hashes, ascending
    number: np.ndarray
    doc: np.ndarray
    docs: int
    features: np.ndarray
    language: np.ndarray

    def only(self, keep: np.ndarray) -> "Coded":
        """Some of the texts, with their own words alone."""
        at = keep[self.doc]
        used, number = np.unique(self.number[at], return_inverse=True)
        doc = (np.cumsum(keep) - 1)[self.doc[at]]
        return Coded(self.distinct[used], number.astype(np.int32), doc.astype(np.int32), int(keep.sum()), self.features[used], self.language[keep])


def coded(words: Words) -> Coded:
    total = running_sum(words.data)
    hashes = hash_spans(words.data, words.starts, words.ends, total)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = words.starts[first], words.ends[first]
    own = [distinct]
    for n in BEGINNINGS:
        own.append(hash_spans(words.data, starts, np.minimum(starts + n, ends), total) + np.uint64(n))
    features = np.stack([(mix(h) >> np.uint64(64 - BITS)).astype(np.int32) + 1 for h in own], axis=1)
    for i, n in enumerate(BEGINNINGS):  # a word no longer than a beginning is that beginning already
        features[ends - starts <= n, i + 1] = 0
    return Coded(distinct, number.astype(np.int32), words.doc.astype(np.int32), words.docs, features, languages(distinct, number, words.doc, words.docs))


def coded_texts(texts: list[str]) -> Coded:
    """Any number of texts, a slice at a time."""
    parts = [coded(split_terms(data, bounds)) for _, _, data, bounds in slices(pa.array(texts, pa.string()))]
    distinct, first = np.unique(np.concatenate([p.distinct for p in parts]), return_index=True)
    begin = np.cumsum([0, *[p.docs for p in parts]])
    number = np.concatenate([np.searchsorted(distinct, p.distinct).astype(np.int32)[p.number] for p in parts])
    doc = np.concatenate([p.doc + np.int32(n) for p, n in zip(parts, begin)])
    return Coded(distinct, number, doc, int(begin[-1]), np.concatenate([p.features for p in parts])[first], np.concatenate([p.language for p in parts]))


def padded(number: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with ``GAP`` + 1 empty places (-1) after each text, and where each text begins."""
    count = np.bincount(doc, minlength=docs)
    begin = np.append(0, np.cumsum(count + GAP + 1))
    row = np.full(int(begin[-1]) + GAP, -1, dtype=np.int32)
    row[np.arange(len(number)) + doc * (GAP + 1)] = number
    return row, begin


@dataclass
class ToxicityModel:
    vectors: np.ndarray  # row 0 is zero
    filters: list[np.ndarray]  # for each width: width x WIDTH x FILTERS
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: np.ndarray  # margin of each language from which a text is toxic

    def words(self, features: np.ndarray) -> np.ndarray:
        """Each word's vector, and a zero one behind them for empty places (-1)."""
        total = np.zeros((len(features) + 1, WIDTH), dtype=self.vectors.dtype)
        for column in features.T:  # ``take`` along one column is several times faster than an index of them all
            total[:-1] += self.vectors.take(column, axis=0)
        return total

    def pooled(self, row: np.ndarray, begin: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The largest value of each filter over each text, ``WINDOWS`` windows at a time."""
        words = self.words(features)
        docs = len(begin) - 1
        beyond = np.zeros(int(begin[-1]), dtype=bool)  # windows that begin so late that they would see the next text
        beyond[(begin[1:, None] - 1 - np.arange(GAP)).ravel()] = True
        top = np.full((docs, len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        for a in range(0, int(begin[-1]), WINDOWS):
            b = min(a + WINDOWS, int(begin[-1]))
            x = words.take(row[a:b + GAP], axis=0, mode="wrap")
            values = np.concatenate([sum(x[j:j + b - a] @ f[j] for j in range(w)) for w, f in zip(WIDTHS, self.filters)], axis=1)
            values[beyond[a:b]] = -np.inf
            d0, d1 = int(np.searchsorted(begin, a, side="right")) - 1, int(np.searchsorted(begin, b, side="left"))
            part = np.maximum.reduceat(values, np.maximum(begin[d0:d1] - a, 0), axis=0)
            top[d0:d1] = np.maximum(top[d0:d1], part)
        return top

    def margins(self, texts: Coded) -> np.ndarray:
        row, begin = padded(texts.number, texts.doc, texts.docs)
        hidden = np.maximum(self.pooled(row, begin, texts.features) + self.bias, 0)
        return hidden @ self.out + self.base

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        texts = coded(split_terms(data, bounds))
        return to_score(self.margins(texts) - self.thresholds[texts.language])


def to_score(above: np.ndarray) -> np.ndarray:
    """A margin's distance from its threshold as a number from 0 to 1; ``THRESHOLD`` at the threshold itself."""
    return 1 / (1 + np.exp(-np.clip(above.astype(float) + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))


def _held(texts: Coded, y: np.ndarray) -> np.ndarray:
    """How many distinct words of the texts of each label hold each vector."""
    size = (1 << BITS) + 1
    pair = np.unique(texts.doc.astype(np.int64) << 32 | texts.number)
    held = np.zeros((2, size))
    words = pair & 0xFFFFFFFF
    for label in (0, 1):
        per_word = np.bincount(words[y[pair >> 32] == label], minlength=len(texts.features))
        for column in texts.features.T:
            held[label] += np.bincount(column, per_word, minlength=size)
    return held


def _start(texts: Coded, y: np.ndarray, rng: np.random.Generator) -> ToxicityModel:
    return _start_from(_held(texts, y), y.mean(), rng)


def _start_from(held: np.ndarray, toxic: float, rng: np.random.Generator) -> ToxicityModel:
    """The first coordinate of a vector starts from how much more toxic texts hold it than expected, the others small."""
    expected = held.sum(axis=0) * toxic
    excess = (held[1] - expected) / np.sqrt(expected + 1)
    vectors = rng.normal(0, 0.02, (held.shape[1], WIDTH)).astype(np.float32)
    vectors[held.sum(axis=0) < 2] = 0  # what one text alone holds starts silent
    vectors[:, 0] = np.sign(excess) * np.log1p(np.abs(excess)) * 0.2
    vectors[0] = 0
    filters = []
    for w in WIDTHS:
        f = rng.normal(0, 0.3 / w, (w, WIDTH, FILTERS)).astype(np.float32)
        f[:, 0] = np.abs(f[:, 0]) + 0.3
        filters.append(f)
    return ToxicityModel(vectors, filters, np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32),
                         np.full(len(WIDTHS) * FILTERS, 0.1, dtype=np.float32), -0.5, np.zeros(len(LANGUAGES)))


class _Rate:
    """Steps that shrink where gradients were large before (by the sum of their squares)."""

    def __init__(self, shape: tuple, rate: float) -> None:
        self.square, self.rate = np.full(shape, 1e-6, dtype=np.float32), rate

    def step(self, gradient: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        self.square[at] += gradient * gradient
        return self.rate * gradient / np.sqrt(self.square[at])


@dataclass
class _Rates:
    vectors: _Rate
    filters: list[_Rate]
    bias: _Rate
    out: _Rate
    base: _Rate

    @staticmethod
    def of(model: ToxicityModel) -> "_Rates":
        return _Rates(_Rate(model.vectors.shape, RATE), [_Rate(f.shape, RATE) for f in model.filters], _Rate(model.bias.shape, RATE),
                      _Rate(model.out.shape, RATE), _Rate((1,), RATE))


def fit_network(texts: Coded, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ToxicityModel:
    """Stochastic gradient descent on the logistic loss; only the window that gave a filter's maximum is moved."""
    rng = np.random.default_rng(seed)
    model = _start(texts, y, rng)
    rates = _Rates.of(model)
    for _ in range(epochs):
        _epoch(model, rates, texts, y, float(y.mean()), rng)
    return model


def _epoch(model: ToxicityModel, rates: _Rates, texts: Coded, y: np.ndarray, toxic: float, rng: np.random.Generator) -> None:
    """Each text once, in an order that ``rng`` draws; ``toxic`` is the share of such texts in all that is learned from."""
    first = np.searchsorted(texts.doc, np.arange(texts.docs + 1))
    share = np.where(y == 1, 0.5 / max(toxic, 1e-9), 0.5 / max(1 - toxic, 1e-9))
    order = rng.permutation(texts.docs)
    for k in range(0, len(order), BATCH):
        batch = order[k:k + BATCH]
        counts = first[batch + 1] - first[batch]
        at = np.repeat(first[batch] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(int(counts.sum()))
        used, local = np.unique(texts.number[at], return_inverse=True)
        local[rng.random(len(local)) < DROP] = len(used)  # forgotten words: no text hangs on one alone
        row, begin = padded(local, np.repeat(np.arange(len(batch)), counts), len(batch))
        row[row == len(used)] = -1
        _descend(model, row, begin, texts.features.take(used, axis=0), y[batch], share[batch], rates.filters, rates.vectors, rates.bias, rates.out, rates.base)


def _descend(model: ToxicityModel, row: np.ndarray, begin: np.ndarray, features: np.ndarray, y: np.ndarray, share: np.ndarray,
             rates: list[_Rate], rate_v: _Rate, rate_b: _Rate, rate_o: _Rate, rate_c: _Rate) -> None:
    words = model.words(features)
    x = words.take(row, axis=0, mode="wrap")
    n, docs = int(begin[-1]), len(begin) - 1
    # one product for all widths: beside each place stand the words after it, under narrower filters zeros
    wide = np.concatenate([x[j:j + n] for j in range(GAP + 1)], axis=1)
    every = np.zeros((GAP + 1, WIDTH, len(WIDTHS) * FILTERS), dtype=words.dtype)
    for i, (w, f) in enumerate(zip(WIDTHS, model.filters)):
        every[:w, :, i * FILTERS:(i + 1) * FILTERS] = f
    values = wide @ every.reshape(-1, every.shape[2])
    top = np.stack([values[a:b - GAP].argmax(axis=0) + a for a, b in zip(begin[:-1], begin[1:])])
    tops = values[top, np.arange(top.shape[1])]
    places = [top[:, i * FILTERS:(i + 1) * FILTERS] for i in range(len(WIDTHS))]
    hidden = tops + model.bias
    active = hidden > 0
    hidden = np.where(active, hidden, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.base, -30, 30)))
    slope = ((p - y) * share / docs).astype(np.float32)
    back = slope[:, None] * model.out * active
    moved = np.zeros((len(words), WIDTH), dtype=np.float32)
    for i, (w, f, place) in enumerate(zip(WIDTHS, model.filters, places)):
        g = back[:, i * FILTERS:(i + 1) * FILTERS]
        for j in range(w):
            seen = x.take(place + j, axis=0)  # docs x FILTERS x WIDTH
            np.add.at(moved, row[place + j], g[:, :, None] * f[j].T[None])
            f[j] -= rates[i].step(np.einsum("df,dfk->kf", g, seen) + 1e-5 * f[j], j)
    model.out -= rate_o.step(slope @ hidden + 1e-5 * model.out)
    model.bias -= rate_b.step(back.sum(axis=0))
    model.base -= float(rate_c.step(np.array([slope.sum()]))[0])
    hit = np.flatnonzero(moved[:-1].any(axis=1))
    rows = features[hit].ravel()
    where, to = np.unique(rows, return_inverse=True)
    total = np.zeros((len(where), WIDTH), dtype=np.float32)
    np.add.at(total, to, np.repeat(moved[hit], features.shape[1], axis=0))
    total[where == 0] = 0
    model.vectors[where] -= rate_v.step(total, where)


def calibrate(margin: np.ndarray, language: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each language the threshold of least weighted errors, in the middle of its gap; other languages count a tenth."""
    order = np.argsort(margin)
    m = margin[order]
    cuts = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    thresholds = np.zeros(len(LANGUAGES))
    for i in range(len(LANGUAGES)):
        w = np.where(language == i, 1.0, 0.1)[order] * weight[order]
        missed = np.append(0, np.cumsum(w * (y[order] == 1)))  # toxic texts below the cut
        wrong = np.append(np.cumsum((w * (y[order] == 0))[::-1])[::-1], 0)  # clean texts above it
        errors = missed + wrong
        errors[1:-1][m[1:] == m[:-1]] = np.inf  # no cut parts equal margins
        best = np.flatnonzero(errors <= errors.min() + 1e-9)
        thresholds[i] = cuts[best[len(best) // 2]]
    return thresholds


def _to_state(model: ToxicityModel, rates: _Rates) -> np.ndarray:
    """A row for each vector, its numbers and the squares behind its rate; the other parameters, then their squares, fill the rows after those."""
    rest = [*(f.ravel() for f in model.filters), model.bias, model.out, [model.base], *(r.square.ravel() for r in rates.filters),
            rates.bias.square, rates.out.square, rates.base.square]
    rest = np.concatenate(rest).astype(np.float32)
    rest = np.append(rest, np.zeros(-len(rest) % (2 * WIDTH), dtype=np.float32)).reshape(-1, 2 * WIDTH)
    return np.concatenate([np.concatenate([model.vectors, rates.vectors.square], axis=1), rest])


def _from_state(state: np.ndarray) -> tuple[ToxicityModel, _Rates]:
    size = (1 << BITS) + 1
    rest, at = state[size:].ravel(), 0

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        n = int(np.prod(shape))
        at += n
        return rest[at - n:at].reshape(shape).copy()

    wide = len(WIDTHS) * FILTERS
    shapes = [*((w, WIDTH, FILTERS) for w in WIDTHS), (wide,), (wide,), (1,)]
    own, squares = [take(*s) for s in shapes], [take(*s) for s in shapes]
    model = ToxicityModel(state[:size, :WIDTH].copy(), own[:-3], own[-3], own[-2], float(own[-1][0]), np.zeros(len(LANGUAGES)))
    rates = _Rates.of(model)
    rates.vectors.square = state[:size, WIDTH:].copy()
    for rate, square in zip([*rates.filters, rates.bias, rates.out, rates.base], squares):
        rate.square = square
    return model, rates


def _coded_blocks(labelled: DataFrame, shards: int) -> DataFrame:
    """Texts by shard in coded form, some of ``BLOCK_BYTES`` in a row. Each fourth text of either label is ``apart``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2, dtype=np.int64)
        for batch in batches:
            labels = batch.column("y").to_numpy()
            for first, last, data, bounds in slices(batch.column("text"), BLOCK_BYTES):
                y, texts = labels[first:last], coded(split_terms(data, bounds))
                apart = np.zeros(len(y), dtype=bool)
                for label in (0, 1):
                    at = np.flatnonzero(y == label)
                    apart[at[(seen[label] + np.arange(len(at))) % 4 == 3]] = True
                    seen[label] += len(at)
                for side in (False, True):
                    keep = apart == side
                    if not keep.any():
                        continue
                    part = texts.only(keep)
                    part.distinct = part.distinct[:0]  # the words themselves are not needed again
                    whole = pickle.dumps((part, y[keep]), protocol=5)
                    yield pa.RecordBatch.from_arrays([pa.array([side]), pa.array([len(whole)], pa.int64()), pa.array([pa.compress(whole, codec="zstd", asbytes=True)], pa.binary())],
                                                     names=["apart", "size", "texts"])

    # shards and their order follow from keys and texts alone
    dealt = labelled.select("y", "text", F.md5(F.col("key").cast("string")).alias("place"), F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))
    dealt = dealt.repartition(shards, "place").sortWithinPartitions("place", "n", "h").select("y", "text")
    return cut_lineage(small_batches(dealt).mapInArrow(lean(run), "apart boolean, size bigint, texts binary"))


def _unpacked(batches: Iterator[pa.RecordBatch], apart: bool) -> Iterator[tuple[Coded, np.ndarray]]:
    for batch in batches:
        for side, size, whole in zip(*(batch.column(c) for c in ("apart", "size", "texts"))):
            if side.as_py() == apart:
                yield pickle.loads(pa.decompress(whole.as_buffer(), size.as_py(), codec="zstd"))


def _short(rows: np.ndarray) -> bytes:
    """What a shard changed of some vectors, in 20 bytes each in place of 64: moves as 127ths of the vector's largest one, which
    goes along, and additions to the squares behind its rate as sixths of a power of two (6 % at most; below 2**-26 none)."""
    moved, square = rows[:, :WIDTH], rows[:, WIDTH:]
    scale = np.abs(moved).max(axis=1, keepdims=True).astype(np.float32) / np.float32(127)
    move = np.rint(moved / np.where(scale > 0, scale, 1)).astype(np.int8)
    power = np.rint(6 * np.log2(np.maximum(square, 1e-30))) + _POWER_0
    return scale.tobytes() + move.tobytes() + np.clip(power, 0, 255).astype(np.uint8).tobytes()


def _from_short(raw: bytes) -> np.ndarray:
    n = len(raw) // (4 + 2 * WIDTH)
    scale = np.frombuffer(raw, dtype=np.float32, count=n).reshape(-1, 1)
    move = np.frombuffer(raw, dtype=np.int8, count=n * WIDTH, offset=4 * n).reshape(-1, WIDTH)
    power = np.frombuffer(raw, dtype=np.uint8, count=n * WIDTH, offset=(4 + WIDTH) * n).reshape(-1, WIDTH)
    return np.concatenate([scale * move, np.where(power > 0, 2.0 ** ((power.astype(float) - _POWER_0) / 6), 0)], axis=1)


_POWER_0 = 160  # the code of an addition of 1; at most 2**15.8


def _rows_of(values: np.ndarray, held: np.ndarray, short: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows of a table ``values`` that ``held`` names, ascending, by groups of ``STATE_ROWS``; whole groups of the first ``short`` rows in short form."""
    shard = TaskContext.get().partitionId()
    for block in np.unique(held // STATE_ROWS):
        at = held[held // STATE_ROWS == block]
        there = np.zeros(STATE_ROWS, dtype=bool)
        there[at - block * STATE_ROWS] = True
        brief = bool((block + 1) * STATE_ROWS <= short)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([brief]), pa.array([np.packbits(there).tobytes()], pa.binary()),
                                          pa.array([_short(values[at]) if brief else values[at].astype(np.float32).tobytes()], pa.binary())],
                                         names=["block", "shard", "brief", "at", "held"])


_ROWS = "block int, shard int, brief boolean, at binary, held binary"


def _summed(parts: DataFrame, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the shards' rows, and how many shards hold each: added up by Spark for a group of rows at a time."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        total, n = np.zeros((STATE_ROWS, width)), np.zeros(STATE_ROWS, dtype=np.int32)
        for brief, at, held in pdf.sort_values("shard")[["brief", "at", "held"]].itertuples(index=False):  # one order, so one result
            rows = np.flatnonzero(np.unpackbits(np.frombuffer(at, dtype=np.uint8)))
            total[rows] += _from_short(held) if brief else np.frombuffer(held, dtype=np.float32).reshape(-1, width)
            n[rows] += 1
        return pd.DataFrame({"block": [block], "n": [n.tobytes()], "total": [total.astype(np.float32).tobytes()]})

    whole, n = np.zeros((-(-size // STATE_ROWS) * STATE_ROWS, width), dtype=np.float32), np.zeros(-(-size // STATE_ROWS) * STATE_ROWS, dtype=np.int32)
    for r in parts.groupBy("block").applyInPandas(add, "block int, n binary, total binary").collect():
        at = slice(r["block"] * STATE_ROWS, (r["block"] + 1) * STATE_ROWS)
        whole[at], n[at] = np.frombuffer(r["total"], dtype=np.float32).reshape(-1, width), np.frombuffer(r["n"], dtype=np.int32)
    return whole[:size], n[:size]


def _counted(blocks: DataFrame) -> np.ndarray:
    """``_held`` of all texts that are learned from; the place of vector 0, which no word has, counts the texts of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, (1 << BITS) + 1))
        for texts, y in _unpacked(batches, False):
            part = _held(texts, y)
            part[:, 0] = np.bincount(y, minlength=2)
            held += part
        yield from _rows_of(held.T, np.flatnonzero(held.any(axis=0)))

    return _summed(blocks.mapInArrow(lean(run), _ROWS), (1 << BITS) + 1, 2)[0].T.astype(float)


def _learn(blocks: DataFrame, epochs: int, seed: int = 11) -> ToxicityModel:
    """``epochs`` rounds over all texts that are learned from. The driver holds the network alone, 17 MB with the squares behind its rates."""
    held = _counted(blocks)
    texts_of = held[:, 0].copy()
    held[:, 0] = 0
    toxic = float(texts_of[1] / max(texts_of.sum(), 1))
    model = _start_from(held, toxic, np.random.default_rng(seed))
    state = _to_state(model, _Rates.of(model))
    for turn in range(epochs):
        sent = blocks.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = sent.value
            own, rates = _from_state(before)
            rng = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
            for texts, y in _unpacked(batches, False):
                _epoch(own, rates, texts, y, toxic, rng)
            moved = _to_state(own, rates) - before
            yield from _rows_of(moved, np.flatnonzero(moved.any(axis=1)), 1 << BITS)  # the last vector and all but the vectors stay in full

        total, n = _summed(blocks.mapInArrow(lean(run), _ROWS), *state.shape)
        state = state + total / np.maximum(n, 1)[:, None]
        sent.destroy()
    return _from_state(state)[0]


def _margins_apart(blocks: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(margin, language, y, n)``: how many of the texts kept apart have each margin, in steps of ``MARGIN_STEP``."""
    held = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, y in _unpacked(batches, True):
            step = np.rint(np.clip(held.value.margins(texts), -30, 30) / MARGIN_STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int64()), pa.array(texts.language, pa.int32()), pa.array(y, pa.int32())], names=["step", "language", "y"])

    counted = blocks.mapInArrow(lean(run), "step bigint, language int, y int").groupBy("step", "language", "y").agg(F.count("*").alias("n"))
    return counted.select((F.col("step") * MARGIN_STEP).alias("margin"), "language", "y", "n")


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                 epochs: int = EPOCHS, shard_bytes: int = SHARD_BYTES) -> ToxicityModel:
    """A model of ``label`` (0 or 1) from all texts of ``docs`` whose key has a label.

    Rows of ``labels`` with a NULL or other label or key are left out; of several labels of a key the larger counts; NULL texts are
    empty. Nothing but the text is an input. With labels of one class only, or none, every score is near that
    class, or ``THRESHOLD``.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    labelled = texts.join(broadcast_if_small(marked), "key")
    found = {r["y"]: r["bytes"] for r in labelled.groupBy("y").agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes")).collect()}
    if len(found) < 2:
        empty = np.zeros(((1 << BITS) + 1, WIDTH), dtype=np.float32)
        flat = 0.0 if not found else (30.0 if 1 in found else -30.0)
        return ToxicityModel(empty, [np.zeros((w, WIDTH, FILTERS), dtype=np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32),
                             np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32), flat, np.zeros(len(LANGUAGES)))
    blocks = _coded_blocks(labelled, max(1, -(-sum(found.values()) // shard_bytes)))
    model = _learn(blocks, epochs)
    # at most 600,000 rows, whatever the corpus: margins are clipped to 30 on either side
    rows = sorted(tuple(r) for r in _margins_apart(blocks, model).collect())
    margin, language, y, n = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0),) * 4
    if len(set(y.tolist())) == 2:
        model.thresholds = calibrate(margin, language, y, n)
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with a column ``score`` from 0 to 1, of the whole text; toxic from ``THRESHOLD`` on.

    NULL and empty texts have the score of a text without words; equal texts have equal scores, repeated rows are kept. A column
    named ``score`` is replaced. No shuffle; a long text's windows are computed ``WINDOWS`` at a time.
    """
    kept = [c for c in df.columns if c != score]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])
    held = df.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in slices(batch.column(text), BLOCK_BYTES):  # so small that a step's arrays stay in cache
                yield batch.slice(first, last - first).append_column(score, pa.array(held.value.score(data, bounds), pa.float64()))

    return small_batches(df.select(*kept)).mapInArrow(lean(run), schema)
