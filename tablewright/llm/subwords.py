"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The model file is read for its pieces and flags only; segmentation is done here. A text is escaped (a leading space, spaces
as U+2581) and cut before every U+2581 that follows another character. No piece of a model trained with word splitting
reaches over such a cut, which is checked when the model is read, so every fragment is merged on its own and repeated
fragments are merged once. All fragments of a batch lie in one flat symbol array. A round finds, per fragment, the pair
whose piece has the best score and merges its leftmost occurrence; further occurrences are merged in the same round where
no merge of that piece can open a better pair. Finished fragments leave the arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm.shared import lean, release_memory, small_batches
from tablewright.llm.texts import bounded

SPACE = "▁"
_CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
_FAR = np.int64(1) << 40
CACHE_CHARS = 1_000_000  # fragments a worker remembers, in characters; a character costs some forty bytes
PART_BYTES = 1 << 20  # text encoded together
DECODE_IDS = 1 << 18  # ids decoded together
ROUND_CHARS = 200_000  # characters merged together, so that the arrays of a round stay in the processor's cache


class PairTable:
    """A fixed map from pair keys to numbers, looked up for whole arrays: keys that meet in a slot move on to a further level."""

    BITS = 18

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        number, level = np.arange(len(keys), dtype=np.int32), 0
        while len(keys):
            factor = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % (1 << 64))
            slot = self._slot(keys, factor)
            held, at = np.full(1 << self.BITS, -1, dtype=np.int64), np.full(1 << self.BITS, -1, dtype=np.int32)
            held[slot], at[slot] = keys, number
            self.levels.append((factor, held, at))
            later = held[slot] != keys
            keys, number, level = keys[later], number[later], level + 1

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * factor) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is not in the map."""
        out = np.full(len(keys), -1, dtype=np.int32)
        for factor, held, at in self.levels:
            slot = self._slot(keys, factor)
            hit = held[slot] == keys
            out[hit] = at[slot[hit]]
        return out


class PieceModel:
    """Pieces, scores and the pair table of a BPE model file; without ``pairs`` it can only decode."""

    def __init__(self, path: str, pairs: bool = True) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        trainer, rules = model.trainer_spec, model.normalizer_spec
        if trainer.model_type != proto.TrainerSpec.BPE or not trainer.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is are supported")
        kinds = proto.ModelProto.SentencePiece
        self.prefix = rules.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.end = self.pieces.index(trainer.eos_piece or "</s>")
        self.byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(p.type == kinds.USER_DEFINED for p in model.pieces) or any(_CUT.search(p) for p in normal):
            raise ValueError("pieces that span words are not supported")
        self.bytes = [b"" if p.type == kinds.CONTROL else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.bytes[self.unknown] = " ⁇ ".encode()
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        if pairs:
            self._read_pairs(model, normal)

    def _read_pairs(self, model, normal: dict[str, int]) -> None:
        order = sorted({-p.score for p in model.pieces})
        rank_of = {s: r for r, s in enumerate(order)}
        self.rank = np.array([rank_of[-p.score] for p in model.pieces], dtype=np.int64)
        self.chars = {p: i for p, i in normal.items() if len(p) == 1}
        # characters without a piece still take part as symbols of their own, from this number on
        self.base = len(self.pieces)
        pairs: dict[tuple[int, int], int] = {}
        alone: set[str] = set()
        for text, made in normal.items():
            for cut in range(1, len(text)):
                left, right = text[:cut], text[cut:]
                for side in (left, right):
                    if side not in normal and len(side) == 1:
                        alone.add(side)
        self.alone = {c: self.base + k for k, c in enumerate(sorted(alone))}
        self.other = self.base + len(self.alone)
        names = normal | self.alone
        for text, made in normal.items():
            for cut in range(1, len(text)):
                left, right = names.get(text[:cut]), names.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = made
        self.width = self.other + 1
        keys = np.array([a * self.width + b for a, b in pairs], dtype=np.int64)
        by = np.argsort(keys)
        self.table, self.made = PairTable(keys[by]), np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[by]
        # a piece is safe to merge everywhere at once if no pair that holds it makes a piece of better score
        self.safe = np.ones(self.width, dtype=bool)
        for (left, right), made in pairs.items():
            for side in (left, right):
                if side < self.base and self.rank[made] <= self.rank[side]:
                    self.safe[side] = False
        self._code = np.full(0x110000, self.other, dtype=np.int32)
        for c, i in (self.chars | self.alone).items():
            self._code[ord(c)] = i

    def escape(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def _pairs(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Number of the pair that starts at each symbol, or -1; a fragment's last symbol starts none."""
        found = self.table.find(symbols[:-1] * self.width + symbols[1:])
        return np.where(last, -1, np.append(found, -1))

    def merge(self, fragments: list[str]) -> list[bytes]:
        """The ids of each fragment, as the bytes of 32-bit numbers."""
        if not fragments:
            return []
        text = "".join(fragments)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(fragments)), [len(f) for f in fragments])
        symbols, where = self._code[code].astype(np.int64), np.arange(len(code))
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        last = np.append(owner[1:] != owner[:-1], True)
        pair = self._pairs(symbols, last)
        while len(symbols):
            rank = np.where(pair >= 0, self.rank[self.made[pair]], _FAR)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(heads, len(owner)))
            best = np.minimum.reduceat(rank, heads)
            going = np.repeat(best < _FAR, sizes)
            if not going.all():
                kept.append((where[~going], symbols[~going]))
                symbols, where, owner, pair, rank, last = (x[going] for x in (symbols, where, owner, pair, rank, last))
                if not len(symbols):
                    break
                sizes, best = sizes[best < _FAR], best[best < _FAR]
                heads = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            fresh = np.append(True, owner[hits[1:]] != owner[hits[:-1]])
            # within a run of overlapping occurrences every second one counts, starting from its left end
            starts = np.append(True, np.diff(hits) != 1) | fresh
            run = np.cumsum(starts) - 1
            even = (np.arange(len(hits)) - np.flatnonzero(starts)[run]) % 2 == 0
            chosen = hits[fresh | (even & self.safe[self.made[pair[hits]]])]
            symbols[chosen] = self.made[pair[chosen]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[chosen + 1] = False
            last[chosen] = last[chosen + 1]
            touched = np.zeros(len(symbols), dtype=bool)
            touched[chosen] = True
            symbols, where, owner, pair, last, touched = (x[stay] for x in (symbols, where, owner, pair, last, touched))
            touched[:-1] |= touched[1:]  # the symbol before a merge has a new right neighbour
            again = np.flatnonzero(touched)
            found = self.table.find(symbols[again] * self.width + symbols[np.minimum(again + 1, len(symbols) - 1)])
            pair[again] = np.where(last[again], -1, found)
        if kept:
            where = np.concatenate([w for w, _ in kept])
            symbols = np.concatenate([s for _, s in kept])
            by = np.argsort(where)
            where, symbols = where[by], symbols[by]
        sizes = np.array([len(f) for f in fragments])
        cuts = np.searchsorted(where, np.append(0, np.cumsum(sizes)))
        raw, odd = symbols.astype(np.int32).tobytes(), np.flatnonzero(symbols >= self.base)
        out = [raw[4 * a:4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for f in np.unique(np.searchsorted(cuts, odd, side="right") - 1).tolist():
            spelled: list[int] = []
            for position in range(cuts[f], cuts[f + 1]):
                if symbols[position] < self.base:
                    spelled.append(int(symbols[position]))
                else:
                    spelled += [self.byte_ids[b] for b in chr(code[where[position]]).encode("utf-8", "surrogatepass")]
            out[f] = np.array(spelled, dtype=np.int32).tobytes()
        return out


class Encoder:
    """Encodes texts; remembers fragments up to ``CACHE_CHARS`` characters."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.known, self.held = model, {}, 0

    def _cut(self, text: str) -> list[str]:
        words = text.split(" ")
        if self.model.prefix and SPACE not in text and "" not in words:
            return words  # the common case: each word, with the space before it, is one fragment
        return [SPACE + f for f in _CUT.split(self.model.escape(text))] if text else []

    def encode(self, texts: list[str], end: bool = True) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit numbers."""
        if self.held > CACHE_CHARS:
            self.known, self.held = {}, 0
        cut = [self._cut(t) for t in texts]
        new = list({f for fragments in cut for f in set(fragments).difference(self.known)})
        first = size = 0
        for k, f in enumerate(new):
            size += len(f) + 1
            if size > ROUND_CHARS or k == len(new) - 1:
                # a key that starts with SPACE is SPACE and an escaped fragment; any other is a plain word
                block = new[first:k + 1]
                whole = [f[1:] if f.startswith(SPACE) else SPACE + f for f in block]
                self.known.update(zip(block, self.model.merge(whole)))
                self.held, first, size = self.held + size, k + 1, 0
        tail = np.int32(self.model.end).tobytes() if end else b""
        get = self.known.__getitem__
        return [b"".join(map(get, fragments)) + tail for fragments in cut]


def decode_ids(model: PieceModel, ids: list[int]) -> str:
    """The text of ids: pieces joined, bytes read as UTF-8, the added first space removed."""
    if not ids:
        return ""
    raw = b"".join(map(model.bytes.__getitem__, ids))
    if model.prefix and raw[:1] == b" " and next(i for i in ids if model.bytes[i]) != model.byte_ids[0x20]:
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load_encoder(path: str) -> Encoder:
    encoder = Encoder(PieceModel(path))
    release_memory()  # the tables are read through dicts several times their size
    return encoder


@lru_cache(maxsize=2)
def load_decoder(path: str) -> PieceModel:
    return PieceModel(path, pairs=False)


def encode_pieces(df: DataFrame, path: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """``df`` with a column ``ids`` (array of int) holding the ids of ``text``.

    NULL and empty texts give the end id alone, or nothing without ``end``. Repeated rows are kept; a column already named
    ``ids`` is replaced. ``path`` is the model file's place on every worker. No shuffle.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path)
        for batch in batches:
            for part in bounded(batch, text, PART_BYTES):
                values = encoder.encode([t or "" for t in part.column(text).to_pylist()], end)
                flat = pa.array(np.frombuffer(b"".join(values), dtype=np.int32))
                offsets = np.cumsum([0, *map(len, values)]) // 4
                yield part.append_column(ids, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat))

    return small_batches(df.select(*[c for c in df.columns if c != ids])).mapInArrow(lean(run), schema)


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with a column ``text`` decoded from ``ids``; NULL ids give an empty text. A column named ``text`` is replaced."""
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_decoder(path)
        for batch in batches:
            lists = batch.column(ids)
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            first = 0
            while first < batch.num_rows:  # some texts at a time; only one is a list of Python numbers
                last = max(int(np.searchsorted(ends, ends[first] + DECODE_IDS, side="right")) - 1, first + 1)
                values = [decode_ids(model, flat[a:b].tolist()) for a, b in zip(ends[first:last], ends[first + 1:last + 1])]
                yield batch.slice(first, last - first).append_column(text, pa.array(values, pa.string()))
                first = last

    return small_batches(df.select(*[c for c in df.columns if c != text])).mapInArrow(lean(run), schema)
