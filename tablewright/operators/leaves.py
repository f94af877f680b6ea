"""Points of few dimensions in leaves with a bounding box, and groups of leaves that lie together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tablewright.operators.pairwise import Cells, matrix
from tablewright.session import cut_lineage


def cell_groups(side: Cells, wanted: int) -> dict[int, int]:
    """Cells dealt to ``wanted`` groups of cells that lie together, each with about as many points."""
    used = sorted(side.stats)
    if side.pivots is None or wanted <= 1:
        return dict.fromkeys(used, 0)
    rows, open_parts = np.array([side.stats[c][0] for c in used]), [np.arange(len(used))]
    while len(open_parts) < min(wanted, len(used)):
        largest = max((i for i in range(len(open_parts)) if len(open_parts[i]) > 1), key=lambda i: rows[open_parts[i]].sum())
        part = open_parts.pop(largest)
        at = side.pivots[np.array(used)[part]]
        part = part[np.argsort(at[:, int(np.ptp(at, axis=0).argmax())], kind="stable")]
        run = np.cumsum(rows[part])
        cut = min(max(int(np.searchsorted(run, run[-1] / 2)), 1), len(part) - 1)
        open_parts += [part[:cut], part[cut:]]
    return {used[i]: g for g, part in enumerate(open_parts) for i in part}


def halves(x: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows ``at`` cut in halves along their widest coordinate until none has more than ``size``."""
    done, parts = [], [at]
    while parts:
        part = parts.pop()
        if len(part) <= size:
            done.append(part)
            continue
        own = x[part]
        part = part[np.argsort(own[:, int(np.ptp(own, axis=0).argmax())], kind="stable")]
        parts += [part[len(part) // 2:], part[:len(part) // 2]]
    return done


def pack_leaves(side: Cells, size: int, group_of: dict[int, int], column: str, kind: type) -> DataFrame:
    """``(leaf, grp, lo, hi, x, w, ids)``: the points of each leaf as bytes, with the numbers of ``column`` as ``w``."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x, out = matrix(pdf["vec"]), []
        ids, weight, cell = pdf["id"].to_numpy(), pdf[column].to_numpy(), int(pdf["cell"].iloc[0])
        for n, at in enumerate(halves(x, np.argsort(ids), size)):
            own = np.ascontiguousarray(x[at], dtype=float)
            out.append((cell << 32 | n, group_of[cell], own.min(axis=0), own.max(axis=0), own.tobytes(),
                        weight[at].astype(kind).tobytes(), ids[at].astype("int64").tobytes()))
        return pd.DataFrame(out, columns=["leaf", "grp", "lo", "hi", "x", "w", "ids"])

    return cut_lineage(side.placed.groupBy("cell").applyInPandas(
        pack, "leaf bigint, grp int, lo array<double>, hi array<double>, x binary, w binary, ids binary"))


def box_gaps(own_lo: np.ndarray, own_hi: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least distance that points of a box can have from points of each other box."""
    gap = np.maximum(np.maximum(lo - own_hi, own_lo - hi), 0.0)
    return np.sqrt((gap * gap).sum(axis=-1))


def box_spans(own_lo: np.ndarray, own_hi: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest distance they can have."""
    span = np.maximum(hi - own_lo, own_hi - lo)
    return np.sqrt((span * span).sum(axis=-1))
