"""Minimum spanning trees over many points of few dimensions.

Points stand in leaves with a bounding box, leaves in groups. A group's task finds the tree of its own points and keeps those edges that are
surely part of the whole tree: the lightest one out of a part of the group, where nothing outside the group can be nearer to the part. Most
points are joined so, at once. What remains are parts along the borders of groups, of which each round finds the lightest edge out, looking only
into leaves that can hold a nearer point of another part (Borůvka). The driver holds the boxes of the leaves, whose number is bounded, and a
few numbers for each part, whose number is measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.leaves import box_gaps, box_spans, cell_groups, pack_leaves
from tablewright.operators.pairwise import Cells
from tablewright.session import cut_lineage

LEAF_ROWS = 64  # points of a leaf of a small table
MOST_LEAVES = 16_000  # leaves whose boxes may travel with a task; a larger table has larger leaves
GROUP_ROWS = 4096  # points whose tree a task finds at a time
MOST_GROUPS = 1000
NEAR_LEAVES = 48  # leaves around one that are looked at for a first bound
FEW_SPOTS = 64  # leaves of a part that look at all others for a first bound, where those around hold no other part
MOST_PARTS = 2_000_000  # parts of which the driver may hold a few numbers
PAIR_CELLS = 1 << 21  # distances held at a time
_AT_ONCE = 1 << 15
_LOCAL = "kind int, a bigint, b bigint, w double, ca bigint, cb bigint, leaf bigint, labels binary"
_FOUND = "comp bigint, w double, a bigint, b bigint, other bigint"


def whole_tree(x: np.ndarray, core: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning tree of all rows by Prim's rule; no matrix of distances is held."""
    n, columns = len(x), np.ascontiguousarray(x.T)
    best, source, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    left, right, w, at = np.zeros(max(n - 1, 0), int), np.zeros(max(n - 1, 0), int), np.zeros(max(n - 1, 0)), 0
    out[0] = True
    for e in range(n - 1):
        far = np.zeros(n)
        for c in columns:
            diff = c - c[at]
            far += diff * diff
        np.sqrt(far, out=far)
        if core is not None:
            np.maximum(far, core, out=far)
            np.maximum(far, core[at], out=far)
        far[out] = np.inf
        nearer = far < best
        best[nearer], source[nearer] = far[nearer], at
        at = int(best.argmin())
        if out[at]:  # only infinite core distances are left
            at = int(np.flatnonzero(~out)[0])
        left[e], right[e], w[e] = source[at], at, best[at]
        best[at], out[at] = np.inf, True
    return left, right, w


def sure_edges(left: np.ndarray, right: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which edges of a group's tree are part of the whole one, and the part each point ends in, as the place of its least member.

    ``margin`` is, for each point, how far off the nearest point outside the group is at least.
    """
    part, taken = np.arange(len(margin)), np.zeros(len(w), bool)
    order = np.argsort(w, kind="stable")
    rank = np.empty(len(w), int)
    rank[order] = np.arange(len(w))
    while True:
        a, b = part[left], part[right]
        live = np.flatnonzero((a != b) & np.isfinite(w))
        first = np.full(len(margin), len(w))
        np.minimum.at(first, a[live], rank[live])
        np.minimum.at(first, b[live], rank[live])
        reach = np.full(len(margin), np.inf)
        np.minimum.at(reach, part, margin)
        asks = np.flatnonzero(first < len(w))
        edges = order[first[asks]]
        edges = np.unique(edges[w[edges] <= reach[asks]])
        if not len(edges):
            return taken, part
        taken[edges] = True
        part = _merged(part, part[left[edges]], part[right[edges]])


def _merged(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parts named by a least place, after those of ``a`` and ``b`` have become one."""
    name = np.arange(max(int(part.max()), int(a.max()), int(b.max())) + 1)
    while True:
        x, y = name[a], name[b]
        if (x == y).all():
            return name[part]
        np.minimum.at(name, np.maximum(x, y), np.minimum(x, y))
        while (name[name] != name).any():
            name = name[name]


def _margins(x: np.ndarray, of_leaf: np.ndarray, inside: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How far each point is at least from the points of leaves that are not ``inside``."""
    margin = np.full(len(x), np.inf)
    for leaf in np.unique(of_leaf):
        gap = box_gaps(lo[leaf], hi[leaf], lo, hi)
        gap[inside] = np.inf
        near = np.argsort(gap, kind="stable")[:NEAR_LEAVES + 1]
        rest = gap[near[-1]] if len(near) > NEAR_LEAVES else np.inf
        near = near[:NEAR_LEAVES][np.isfinite(gap[near[:NEAR_LEAVES]])]
        own = np.flatnonzero(of_leaf == leaf)
        if len(near):
            margin[own] = np.minimum(box_gaps(x[own][:, None], x[own][:, None], lo[near], hi[near]).min(axis=1), rest)
    return margin


class _Parts:
    """The parts that groups left, by number, and which of them are one by now."""

    def __init__(self, spots: pd.DataFrame, edges: pd.DataFrame, leaves: np.ndarray, group: np.ndarray):
        self.group = group
        self.names = np.unique(spots["ca"].to_numpy())
        self.now = np.arange(len(self.names))
        order = np.argsort(spots["leaf"].to_numpy(), kind="stable")
        spots = spots.iloc[order]
        self.leaf = np.searchsorted(leaves, spots["leaf"].to_numpy())
        self.part = np.searchsorted(self.names, spots["ca"].to_numpy())
        self.least = spots["w"].to_numpy(float)
        self.a, self.b, self.w = edges["a"].to_numpy(), edges["b"].to_numpy(), edges["w"].to_numpy(float)
        self.ca, self.cb = (np.searchsorted(self.names, edges[c].to_numpy()) for c in ("ca", "cb"))
        self.open = np.ones(len(self.names), bool)
        self.starts = np.searchsorted(self.leaf, np.arange(len(leaves) + 1))

    def sole(self, leaves: int) -> np.ndarray:
        """The part of a leaf's points, -1 where there are several."""
        lo, hi, held = np.full(leaves, len(self.names)), np.full(leaves, -1), self.now[self.part]
        np.minimum.at(lo, self.leaf, held)
        np.maximum.at(hi, self.leaf, held)
        return np.where(lo == hi, lo, -1)

    def inner(self) -> pd.DataFrame:
        """The edges that groups keep between parts, once for each end."""
        a, b = self.now[self.ca], self.now[self.cb]
        live = a != b
        one = pd.DataFrame({"comp": a[live], "w": self.w[live], "a": self.a[live], "b": self.b[live], "other": b[live]})
        return pd.concat([one, one.assign(comp=one["other"], other=one["comp"])], ignore_index=True)


def leaf_tree(points: DataFrame, side: Cells, core: str | None, radius: float | None) -> DataFrame | None:
    """Minimum spanning tree ``(a, b, w)`` of ``(id, vec)``, with ``radius`` the forest of the edges up to it; euclidean distances.

    None where the groups leave more parts than the driver may hold.
    """
    spark, limit = points.sparkSession, np.inf if radius is None else radius
    if core is None:
        side = Cells(side.rows, side.pivots, side.placed.withColumn("_core", F.lit(0.0)), side.stats)
    size = max(LEAF_ROWS, -(-side.rows // MOST_LEAVES) * 2)
    leaves = pack_leaves(side, size, cell_groups(side, min(max(1, side.rows // GROUP_ROWS), MOST_GROUPS)), core or "_core", float)
    boxes = leaves.select("leaf", "grp", "lo", "hi").orderBy("leaf").toPandas()  # few thousand rows whatever the table
    names, lo, hi = boxes["leaf"].to_numpy(), np.stack(boxes["lo"].to_numpy()), np.stack(boxes["hi"].to_numpy())
    held = spark.sparkContext.broadcast((names, lo, hi))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        names, lo, hi = held.value
        parts, chunk, rows = [], [], 0
        for row in pdf.sort_values("leaf").itertuples(index=False):
            n = len(row.ids) // 8
            if chunk and rows + n > 2 * GROUP_ROWS:
                parts.append(_local_tree(chunk, names, lo, hi, core is not None, limit))
                chunk, rows = [], 0
            chunk.append(row)
            rows += n
        parts.append(_local_tree(chunk, names, lo, hi, core is not None, limit))
        return pd.concat(parts, ignore_index=True)

    done = cut_lineage(leaves.repartition(int(boxes["grp"].nunique()), "grp").groupBy("grp").applyInPandas(local, _LOCAL))
    tree = done.filter("kind = 0").select("a", "b", "w")
    if done.filter("kind IN (1, 3)").count() > MOST_PARTS:
        return None
    found = done.filter("kind IN (1, 3)").drop("labels").toPandas()
    state = _Parts(found[found["kind"] == 3], found[found["kind"] == 1], names, boxes["grp"].to_numpy())
    leaves = cut_lineage(leaves.drop("lo", "hi").join(done.filter("kind = 2").select("leaf", "labels"), "leaf"))
    around = _around(leaves.select("leaf"), held)
    tops = np.zeros(len(names))
    for row in done.filter("kind = 2").select("leaf", "w").collect():
        tops[np.searchsorted(names, row["leaf"])] = row["w"]
    more = []
    while len(np.unique(state.now)) > 1:
        chosen = _lightest(leaves, held, state, around, tops, core is not None, limit)
        if not len(chosen):
            break
        going = np.zeros(len(state.names), bool)
        going[chosen["comp"]] = True
        ends = chosen.drop_duplicates(["a", "b"])
        kept = _forest(ends)
        more.append(ends.iloc[kept][["a", "b", "w"]])
        before = state.now
        state.now = _merged(state.now, ends["comp"].to_numpy(), ends["other"].to_numpy())
        state.open = np.zeros(len(state.names), bool)
        state.open[state.now[going[before]]] = True
    if not more:
        return cut_lineage(tree)
    return cut_lineage(tree.unionByName(spark.createDataFrame(pd.concat(more, ignore_index=True), "a bigint, b bigint, w double")))


def _forest(ends: pd.DataFrame) -> np.ndarray:
    """Positions of chosen edges that close no circle; only equal weights can make one."""
    from tablewright.operators.spanning import lightest_forest  # spanning builds on this module

    order = np.lexsort((ends["b"], ends["a"], ends["w"]))
    return order[lightest_forest(ends["comp"].to_numpy()[order], ends["other"].to_numpy()[order], np.arange(len(order)))]


def _local_tree(chunk: list, names: np.ndarray, lo: np.ndarray, hi: np.ndarray, cored: bool, limit: float) -> pd.DataFrame:
    """The sure edges of the leaves of one chunk (0), the others of its tree (1), the parts of each leaf's points (2), and each part in each leaf (3)."""
    d, inside = lo.shape[1], np.searchsorted(names, [row.leaf for row in chunk])
    x = np.concatenate([np.frombuffer(row.x).reshape(-1, d) for row in chunk])
    ids = np.concatenate([np.frombuffer(row.ids, dtype=np.int64) for row in chunk])
    core = np.concatenate([np.frombuffer(row.w) for row in chunk])
    rows = np.array([len(row.ids) // 8 for row in chunk])
    of_leaf = np.repeat(inside, rows)
    left, right, w = whole_tree(x, core if cored else None)
    taken, part = sure_edges(left, right, np.where(w <= limit, w, np.inf), np.maximum(_margins(x, of_leaf, inside, lo, hi), core))
    least = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(least, part, ids)
    label = least[part]
    a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
    other = ~taken & (w <= limit) & np.isfinite(w)
    sure = pd.DataFrame({"kind": 0, "a": a[taken], "b": b[taken], "w": w[taken], "ca": 0, "cb": 0, "leaf": 0, "labels": b""})
    rest = pd.DataFrame({"kind": 1, "a": a[other], "b": b[other], "w": w[other], "ca": label[left[other]], "cb": label[right[other]], "leaf": 0, "labels": b""})
    cuts = np.cumsum(rows)[:-1]
    whole = pd.DataFrame({"kind": 2, "a": 0, "b": 0, "w": [float(c.max()) for c in np.split(core, cuts)], "ca": 0, "cb": 0, "leaf": names[inside],
                          "labels": [v.tobytes() for v in np.split(label, cuts)]})
    spots = pd.DataFrame({"leaf": names[of_leaf], "ca": label, "w": core}).groupby(["leaf", "ca"], as_index=False)["w"].min()
    return pd.concat([sure, rest, whole, spots.assign(kind=3, a=0, b=0, cb=0, labels=b"")[sure.columns]], ignore_index=True)


def _around(leaves: DataFrame, held: Broadcast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each leaf the numbers of those around it, and how far apart points of both are at least and at most."""
    count = min(NEAR_LEAVES, len(held.value[0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, lo, hi = held.value
        for pdf in batches:
            out = []
            for leaf in pdf["leaf"]:
                i = int(np.searchsorted(names, leaf))
                gap = box_gaps(lo[i], hi[i], lo, hi)
                near = np.argpartition(gap, count - 1)[:count]
                span = box_spans(lo[i], hi[i], lo[near], hi[near])
                out.append((leaf, near.astype("int64").tobytes(), gap[near].tobytes(), span.tobytes()))
            yield pd.DataFrame(out, columns=["leaf", "near", "gap", "span"])

    rows = leaves.repartition(16).mapInPandas(run, "leaf bigint, near binary, gap binary, span binary").toPandas().sort_values("leaf")
    return tuple(np.stack([np.frombuffer(v, dtype=k) for v in rows[c]]) for c, k in (("near", np.int64), ("gap", float), ("span", float)))


def _bounds(held: Broadcast, state: _Parts, around: tuple, tops: np.ndarray, sole: np.ndarray, inner: pd.DataFrame, limit: float) -> np.ndarray:
    """For each part a weight that its lightest edge out does not exceed; -1 for parts that are done."""
    bound, of_spot, (near, _, span) = np.full(len(state.names), limit), state.now[state.part], around
    np.minimum.at(bound, inner["comp"].to_numpy(), inner["w"].to_numpy())
    for i in range(0, len(of_spot), _AT_ONCE):
        at = slice(i, i + _AT_ONCE)
        to, comp = near[state.leaf[at]], of_spot[at]
        most = np.maximum(span[state.leaf[at]], np.maximum(state.least[at][:, None], tops[to]))
        most[sole[to] == comp[:, None]] = np.inf
        np.minimum.at(bound, comp, most.min(axis=1))
    _, lo, hi = held.value
    for comp in np.intersect1d(np.flatnonzero(np.isinf(bound) & state.open), of_spot):
        # none of the leaves around it holds another part: some of its leaves look at all others
        spots = np.flatnonzero(of_spot == comp)
        for i in spots[::-(-len(spots) // FEW_SPOTS)]:
            at = state.leaf[i]
            most = np.maximum(box_spans(lo[at], hi[at], lo, hi), np.maximum(state.least[i], tops))
            bound[comp] = min(bound[comp], most[sole != comp].min(initial=np.inf))
    bound *= 1 + 1e-9
    bound[~state.open] = -1.0
    return bound


def _met(spark: SparkSession, held: Broadcast, state: _Parts, around: tuple, lows: np.ndarray, sole: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spots (a part in a leaf) and the leaves where a point of another part can be within the part's bound, in the order of the spots."""
    of_spot, (near, gap, _) = state.now[state.part], around
    asks = np.flatnonzero(state.least <= bound[of_spot])
    # those around a leaf are all that matter where the farthest of them is beyond the bound
    whole = (near.shape[1] == len(lows)) | (gap.max(axis=1)[state.leaf[asks]] > bound[of_spot[asks]])
    spots, leaves = [], []
    for i in range(0, int(whole.sum()), _AT_ONCE):
        at = asks[whole][i:i + _AT_ONCE]
        to, comp = near[state.leaf[at]], of_spot[at]
        rows, cols = np.nonzero((np.maximum(gap[state.leaf[at]], lows[to]) <= bound[comp][:, None]) & (sole[to] != comp[:, None]))
        spots.append(at[rows])
        leaves.append(to[rows, cols])
    rest = asks[~whole]
    if len(rest):
        sent = spark.sparkContext.broadcast((sole, lows))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (_, lo, hi), (sole, lows) = held.value, sent.value
            for pdf in batches:
                for spot, leaf, comp, most in pdf.itertuples(index=False):
                    met = np.flatnonzero((np.maximum(box_gaps(lo[leaf], hi[leaf], lo, hi), lows) <= most) & (sole != comp))
                    yield pd.DataFrame({"spot": spot, "leaf": met})

        asked = pd.DataFrame({"spot": rest, "leaf": state.leaf[rest], "comp": of_spot[rest], "most": bound[of_spot[rest]]})
        found = spark.createDataFrame(asked).repartition(min(len(rest), 64)).mapInPandas(run, "spot bigint, leaf bigint").toPandas()
        spots.append(found["spot"].to_numpy())
        leaves.append(found["leaf"].to_numpy())
    spots, leaves = (np.concatenate(v).astype("int64") if v else np.zeros(0, "int64") for v in (spots, leaves))
    order = np.argsort(spots, kind="stable")
    return spots[order], leaves[order]


def _lightest(leaves: DataFrame, held: Broadcast, state: _Parts, around: tuple, tops: np.ndarray, cored: bool, limit: float) -> pd.DataFrame:
    """The lightest edge ``(comp, w, a, b, other)`` out of each open part; of equal ones that of the least ends."""
    spark, sole, inner = leaves.sparkSession, state.sole(len(tops)), state.inner()
    bound = _bounds(held, state, around, tops, sole, inner, limit)
    lows = np.full(len(tops), np.inf)
    np.minimum.at(lows, state.leaf, state.least)
    spots, met = _met(spark, held, state, around, lows, sole, bound)
    sent = spark.sparkContext.broadcast((state.starts, state.now[state.part], np.searchsorted(spots, np.arange(len(state.part) + 1)), met, bound, state.names, state.now))

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        (names, lo, _), (starts, of_spot, first_met, met, bound, parts, now) = held.value, sent.value
        d, best = lo.shape[1], {}
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("comp", "w", "a", "b", "other")})
        b = b.sort_values("leaf")
        place, ends = np.searchsorted(names, b["leaf"].to_numpy()), np.cumsum([0, *(len(v) // 8 for v in b["near_ids"])])
        y = np.concatenate([np.frombuffer(v).reshape(-1, d) for v in b["near_x"]])
        jd = np.concatenate([np.frombuffer(v, dtype=np.int64) for v in b["near_ids"]])
        jc = np.concatenate([np.frombuffer(v) for v in b["near_w"]])
        jp = now[np.searchsorted(parts, np.concatenate([np.frombuffer(v, dtype=np.int64) for v in b["near_labels"]]))]
        for name, blob, own_core, own_ids, labels in a[["leaf", "x", "w", "ids", "labels"]].itertuples(index=False):
            x, ic, ids = np.frombuffer(blob).reshape(-1, d), np.frombuffer(own_core), np.frombuffer(own_ids, dtype=np.int64)
            mine, leaf = now[np.searchsorted(parts, np.frombuffer(labels, dtype=np.int64))], int(np.searchsorted(names, name))
            asked: dict[int, list[np.ndarray]] = {}
            for spot in range(starts[leaf], starts[leaf + 1]):
                if first_met[spot] < first_met[spot + 1]:
                    asked.setdefault(int(of_spot[spot]), []).append(met[first_met[spot]:first_met[spot + 1]])
            for comp, to in asked.items():
                most = min(bound[comp], best[comp][0]) if comp in best else bound[comp]
                at = np.searchsorted(place, np.unique(np.concatenate(to)))
                some = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in at])
                some = some[(jp[some] != comp) & (jc[some] <= most)]
                own = np.flatnonzero((mine == comp) & (ic <= most))
                step = max(1, PAIR_CELLS // max(len(some), 1))
                for k in range(0, len(own) if len(some) else 0, step):
                    part = own[k:k + step]
                    far = np.zeros((len(part), len(some)))
                    for c in range(d):
                        diff = x[part, c][:, None] - y[some, c]
                        far += diff * diff
                    np.sqrt(far, out=far)
                    if cored:
                        far = np.maximum(far, np.maximum(ic[part][:, None], jc[some]))
                    least = far.min()
                    if least > most:
                        continue
                    i, j = np.nonzero(far == least)
                    s, t = ids[part[i]], jd[some[j]]
                    first, last = np.minimum(s, t), np.maximum(s, t)
                    e = int(np.lexsort((last, first))[0])
                    edge = (float(least), int(first[e]), int(last[e]), int(jp[some[j[e]]]))
                    if comp not in best or edge < best[comp]:
                        best[comp], most = edge, float(least)
        return pd.DataFrame([(c, *e) for c, e in best.items()], columns=["comp", "w", "a", "b", "other"])

    found = inner
    if len(met):
        at = state.leaf[spots]
        lefts = spark.createDataFrame(pd.DataFrame({"leaf": held.value[0][np.unique(at)]}))
        pairs = pd.DataFrame({"grp": state.group[at], "leaf": held.value[0][met]}).drop_duplicates()
        groups = pairs["grp"].nunique()
        # few bytes stand for much work here, so tasks are dealt by groups and not by size
        near_side = leaves.select("leaf", F.col("x").alias("near_x"), F.col("w").alias("near_w"), F.col("ids").alias("near_ids"), F.col("labels").alias("near_labels"))
        rights = near_side.join(spark.createDataFrame(pairs), "leaf").repartition(groups, "grp")
        lefts = leaves.select(*[F.col(c).alias(c) for c in leaves.columns]).join(lefts, "leaf", "left_semi").repartition(groups, "grp")
        outer = lefts.groupBy("grp").cogroup(rights.groupBy("grp")).applyInPandas(find, _FOUND).toPandas()
        found = pd.concat([inner, outer], ignore_index=True)
    found = found[found["w"] <= limit].astype({"comp": "int64", "a": "int64", "b": "int64", "other": "int64"})
    return found.sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")
