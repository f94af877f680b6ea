"""Quality rules by repetition coverage: how much of a text lies in n-grams and lines that it repeats.

Word n-grams of several lengths are hashed by rolling over the word hashes of a slice of texts; an n-gram counts as
repeated if its hash occurs twice or more in the same text. Only places where the shorter n-gram is repeated can start a
longer repeated one, so after the shortest length only those are sorted again. Coverage is measured in code points; as with
lines, the first occurrence is no repetition, so a heading that stands twice in a short text counts once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import lean, small_batches
from tablewright.llm.texts import Words, hash_spans, mix, slices, split_words, window_hashes

SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 3
# Largest tolerated share of a text's word characters inside repeated n-grams, by n.
GRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_SHARE = 0.40  # of the lines
LINE_CHARS = 0.25  # of the characters
SYMBOL_SHARE = 0.10  # symbols for each word

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks the keys that occur twice or more, and of them the ones that equal an earlier key."""
    by = np.argsort(keys, kind="stable")
    same = keys[by][1:] == keys[by][:-1]
    later = np.zeros(len(keys), dtype=bool)
    later[by[1:][same]] = True
    again = later.copy()
    again[by[:-1][same]] = True
    return again, later


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside any of the windows of ``n`` words at ``starts``."""
    step = np.zeros(size + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(words: Words, lengths: Mapping[int, float] | tuple[int, ...] = tuple(GRAM_LIMITS)) -> dict[str, np.ndarray]:
    """The counts of each text of a slice: words, characters, symbols, lines, and what repeats."""
    data, bounds, docs = words.data, words.bounds, words.docs
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    symbols = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_IS_SYMBOL[data], out=symbols[1:])
    weight = chars[words.ends] - chars[words.starts]
    hashes = mix(words.hashes() ^ mix(words.doc.astype(np.uint64)))  # the same word in two texts differs
    size = len(hashes)

    def per_doc(mask: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(words.doc[mask], weights=None if of is None else of[mask], minlength=docs).astype(np.int64)

    out = {"n_words": words.counts(), "word_chars": per_doc(np.ones(size, dtype=bool), weight),
           "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]]}
    starts = np.arange(size)
    for n in sorted({BASE_WINDOW, *lengths}):
        starts = starts[starts + n <= size]
        starts = starts[words.doc[starts] == words.doc[starts + n - 1]] if len(starts) else starts
        again, later = _repeats(window_hashes(hashes, n)[starts] if len(starts) else np.zeros(0, dtype=np.uint64))
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_doc(_covered(starts[again], n, size))
        if n in lengths:  # words of an n-gram seen before
            out[f"chars_{n}"] = per_doc(_covered(starts[later], n, size), weight)
        starts = starts[again]
    # lines: a cut at every \n and at every text's end; only lines that hold a word count
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:][data == 0x0A] = True
    cut[bounds] = True
    begins = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, dtype=np.int64)
    ends = np.append(begins[1:], len(data)) if len(begins) else begins
    ends = ends - (data[ends - 1] == 0x0A) if len(begins) else ends
    filled = np.searchsorted(words.starts, begins) < np.searchsorted(words.starts, ends)
    begins, ends = begins[filled], ends[filled]
    owner = np.searchsorted(bounds, begins, side="right") - 1
    _, later = _repeats(mix(hash_spans(data, begins, ends) ^ mix(owner.astype(np.uint64))))
    length = chars[ends] - chars[begins]
    out["n_lines"] = np.bincount(owner, minlength=docs)
    out["n_dup_lines"] = np.bincount(owner[later], minlength=docs)
    out["line_chars"] = np.bincount(owner, weights=length, minlength=docs).astype(np.int64)
    out["dup_line_chars"] = np.bincount(owner[later], weights=length[later], minlength=docs).astype(np.int64)
    return out


def repetition_measures(df: DataFrame, text: str = "text", lengths: tuple[int, ...] = tuple(GRAM_LIMITS)) -> DataFrame:
    """``df`` with the counts of :func:`measure` as columns of type long.

    NULL and empty texts give zeros; texts are taken whole; repeated rows and ties need no order. Columns of ``df`` with
    the name of a measure are replaced. One pass without a shuffle; memory follows the longest text.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_repeat_words", "n_lines", "n_dup_lines", "line_chars", "dup_line_chars",
             *[f"chars_{n}" for n in sorted(lengths)]]
    kept = [c for c in df.columns if c not in names]
    if text not in kept:
        raise ValueError(f"{text} has the name of a measure")
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in slices(batch.column(text)):
                found = measure(split_words(data, bounds), lengths)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(found[n], pa.int64()) for n in names]],
                                                 names=[*part.schema.names, *names])

    return small_batches(df.select(*kept)).mapInArrow(lean(run), schema)


def repetition_rules(df: DataFrame, text: str = "text", min_words: int = 50, limits: Mapping[int, float] = GRAM_LIMITS,
                     line_share: float = LINE_SHARE, line_chars: float = LINE_CHARS, symbol_share: float = SYMBOL_SHARE) -> DataFrame:
    """:func:`repetition_measures` with ``base_failed`` and ``kept``.

    The base rule fails texts of under ``min_words`` words or with more than half of their words in repeated 3-word windows.
    The others are kept unless the share of characters inside repeated n-grams, of repeated lines or of symbols is too large.
    """
    measured = repetition_measures(df.drop("base_failed", "kept"), text, tuple(limits))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    poor = (F.col("n_dup_lines") > line_share * F.col("n_lines")) | (F.col("dup_line_chars") > line_chars * F.col("line_chars"))
    poor = poor | (F.col("n_symbols") > symbol_share * F.col("n_words"))
    for n, share in sorted(limits.items()):
        poor = poor | (F.col(f"chars_{n}") > share * F.col("word_chars"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~poor)
