"""Words of whole texts as numpy arrays, a bounded slice of a batch at a time.

A word is a run of bytes other than ``\\x20\\x09-\\x0D``. In UTF-8 those bytes never occur inside a longer character, so
words can be found on the raw bytes of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # a slice holds whole texts of about this many bytes together, or one longer text

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TERM = np.zeros(256, dtype=bool)  # ASCII letters and digits, and every byte of a longer character
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of one odd number modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.held = np.uint64(base), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            with np.errstate(over="ignore"):
                grown = np.full(max(n, SLICE_BYTES), self.base, dtype=np.uint64)
                grown[0] = 1
                self.held = np.multiply.accumulate(grown)
        return self.held[:n]


_POWERS, _INVERSES = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_sum(data: np.ndarray) -> np.ndarray:
    """The sums behind ``hash_spans``, for callers that hash several ranges of the same bytes."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_KEYS[data] * _POWERS.upto(len(data)), out=total[1:])
    return total


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial over keyed bytes, from one running sum for all ranges."""
    total = running_sum(data) if total is None else total
    with np.errstate(over="ignore"):
        spans = (total[ends] - total[starts]) * _INVERSES.upto(len(data) + 1)[starts]
        return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of ``docs`` consecutive texts whose bytes are ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)


def split_words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    return _runs(_LOWER[data] if lower else data, bounds, ~_SPACE[data])


def split_terms(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Runs of ASCII letters, digits and other characters beyond ASCII, with A-Z in lower case."""
    return _runs(_LOWER[data], bounds, _TERM[data])


def _runs(data: np.ndarray, bounds: np.ndarray, solid: np.ndarray) -> Words:
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(bounds, starts, side="right") - 1)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, bounds)`` of consecutive runs of texts; NULL counts as empty."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1, first + 1)
        yield first, last, raw[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; position i covers words i to i + n - 1."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            total = total * np.uint64(_BASE) + words[k:len(words) - n + 1 + k]
    return mix(total)


def bounded(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of text, so that what is made from a part stays small."""
    for first, last, _, _ in slices(batch.column(text), limit):
        yield batch.slice(first, last - first)
