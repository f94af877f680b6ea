"""Mean shift, affinity propagation and spectral clustering on neighbourhood tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import total
from tablewright.functions.distances import Space, cross_distances, pair_distances
from tablewright.operators.affinity import all_pairs_exemplars
from tablewright.operators.density import _spread_to_copies, distinct_points
from tablewright.operators.graph import number_clusters
from tablewright.operators.kmeans import fit_kmeans
from tablewright.operators.leaves import cell_groups, halves as _halves
from tablewright.operators.neighbors import nearest_neighbors
from tablewright.operators.pairwise import as_points, divide, matrix, near_blocks
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.spectral import leading_vectors, normalised_edges
from tablewright.session import cut_lineage, fits_broadcast

FEW_SEEDS = 2000  # seeds that may travel with the task instead of being joined
PART_ROWS = 500_000  # points of one index, where a table is too large for one that travels
SEED_ROWS = 20_000  # seeds a task climbs, about
STRIP_SEEDS = 4096  # seeds looked up at a time
FEW_MODES = 2000  # densest modes settled at a time
FEW_PASSES = 20  # over the modes before they are settled in rounds
COLUMN_ROWS = 64  # points of a column of a small table
LEAF_ROWS = 64  # points of a leaf of a small table
MOST_LEAVES = 16_000  # leaves whose boxes may travel with a task; a larger table has larger leaves
GROUP_ROWS = 8192  # points whose distances a task looks for, about
MOST_GROUPS = 1000
_BINS = 64
_PASSES = 5  # 64**5 steps: the distance is found to nine digits of the range


def kth_distances(points: DataFrame, k: int, space: Space | None = None) -> DataFrame:
    """``(id, weight, distance)`` to the k-th nearest point, the point itself included.

    ``k`` may be a large share of the table, so no neighbour list is kept. Points stand in leaves with a bounding box. The boxes
    alone bound the distance of all points of a leaf from both sides: leaves nearer than that are counted whole, farther ones not at all,
    and only those between are met point by point. Other spaces than the euclidean one count distances into bins.
    """
    if space is not None and space.name != "euclidean":
        return _kth_by_bins(points, k, space)
    weighted = points if "weight" in points.columns else points.withColumn("weight", F.lit(1).cast("bigint"))
    side = divide(weighted.select("id", "weight", "vec"), "id", Space("euclidean"))
    size = max(LEAF_ROWS, -(-side.rows // MOST_LEAVES) * 2)
    group_of = cell_groups(side, min(max(1, side.rows // GROUP_ROWS), MOST_GROUPS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x, out = matrix(pdf["vec"]), []
        ids, weight, cell = pdf["id"].to_numpy(), pdf["weight"].to_numpy(), int(pdf["cell"].iloc[0])
        for n, at in enumerate(_halves(x, np.argsort(ids), size)):
            own = np.ascontiguousarray(x[at], dtype=float)
            out.append((cell << 32 | n, group_of[cell], own.min(axis=0), own.max(axis=0), int(weight[at].sum()), own.tobytes(),
                        weight[at].astype("int64").tobytes(), ids[at].astype("int64").tobytes()))
        return pd.DataFrame(out, columns=["leaf", "grp", "lo", "hi", "mass", "x", "w", "ids"])

    leaves = cut_lineage(side.placed.groupBy("cell").applyInPandas(
        pack, "leaf bigint, grp int, lo array<double>, hi array<double>, mass bigint, x binary, w binary, ids binary"))
    boxes = leaves.select("leaf", "grp", "lo", "hi", "mass").orderBy("leaf").collect()  # few thousand rows whatever the table
    groups = sorted({r["grp"] for r in boxes})
    spark = points.sparkSession
    held = spark.sparkContext.broadcast((np.array([r["leaf"] for r in boxes]), np.array([r["grp"] for r in boxes]), np.array([r["lo"] for r in boxes]),
                                         np.array([r["hi"] for r in boxes]), np.array([r["mass"] for r in boxes])))

    def torn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, grp, lo, hi, mass = held.value
        for pdf in batches:
            for g in pdf["grp"]:
                met = np.zeros(len(leaf), dtype=bool)
                for i in np.flatnonzero(grp == g):
                    met |= _bracket(lo[i], hi[i], lo, hi, mass, k)[3]
                yield pd.DataFrame({"grp": g, "leaf": leaf[met]})

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        leaf, _, lo, hi, mass = held.value
        d = lo.shape[1]
        order = np.argsort(b["leaf"].to_numpy())
        blobs = b.iloc[order]
        place = np.searchsorted(leaf, blobs["leaf"].to_numpy())
        x = np.concatenate([np.frombuffer(v).reshape(-1, d) for v in blobs["near_x"]])
        w = np.concatenate([np.frombuffer(v, dtype=np.int64) for v in blobs["near_w"]])
        rows = np.array([len(v) // 8 for v in blobs["near_w"]])
        ids, weights, found = [], [], []
        for name, own, own_w, own_ids in a[["leaf", "x", "w", "ids"]].itertuples(index=False):
            i = int(np.searchsorted(leaf, name))
            least, most, before, met = _bracket(lo[i], hi[i], lo, hi, mass, k)
            some = np.repeat(met[place], rows)
            columns, near_w = np.ascontiguousarray(x[some].T), w[some]
            for point in np.frombuffer(own).reshape(-1, d):
                far = np.zeros(columns.shape[1])
                for c in range(d):
                    diff = columns[c] - point[c]
                    far += diff * diff
                inside = np.flatnonzero((far >= least * least) & (far <= most * most)) if least > 0 else np.flatnonzero(far <= most * most)
                already = before + (int(near_w[far < least * least].sum()) if least > 0 else 0)
                near = np.argsort(far[inside])
                at = int(np.searchsorted(np.cumsum(near_w[inside[near]]), k - already))
                found.append(np.sqrt(far[inside[near[min(at, len(near) - 1)]]]))
            ids.append(np.frombuffer(own_ids, dtype=np.int64))
            weights.append(np.frombuffer(own_w, dtype=np.int64))
        return pd.DataFrame({"id": np.concatenate(ids), "weight": np.concatenate(weights), "distance": found})

    asked = spark.createDataFrame([(g,) for g in groups], "grp int").repartition(len(groups))
    pairs = asked.mapInPandas(torn, "grp int, leaf bigint")
    # few bytes stand for much work here, so tasks are dealt by groups and not by size
    lefts = leaves.select("grp", "leaf", "x", "w", "ids").repartition(len(groups), "grp")
    rights = pairs.join(leaves.select("leaf", F.col("x").alias("near_x"), F.col("w").alias("near_w")), "leaf").repartition(len(groups), "grp")
    out = lefts.groupBy("grp").cogroup(rights.groupBy("grp")).applyInPandas(find, "id bigint, weight bigint, distance double")
    return cut_lineage(out)


def _bracket(own_lo: np.ndarray, own_hi: np.ndarray, lo: np.ndarray, hi: np.ndarray, mass: np.ndarray, k: int) -> tuple[float, float, int, np.ndarray]:
    """Bounds of the k-th distance of every point of a box, the points that are nearer for all of them, and which boxes lie between."""
    gap = np.maximum(np.maximum(lo - own_hi, own_lo - hi), 0.0)
    span = np.maximum(hi - own_lo, own_hi - lo)
    nearest, farthest = np.sqrt((gap * gap).sum(axis=1)), np.sqrt((span * span).sum(axis=1))

    def reached(d: np.ndarray) -> float:
        order = np.argsort(d, kind="stable")
        return float(d[order[min(int(np.searchsorted(np.cumsum(mass[order]), k)), len(d) - 1)]])

    least, most = reached(nearest), reached(farthest)
    least, most = max(least - 1e-9 * (1.0 + least), 0.0), most + 1e-9 * (1.0 + most)
    inside = farthest < least
    return least, most, int(mass[inside].sum()), ~inside & (nearest <= most)


def _kth_by_bins(points: DataFrame, k: int, space: Space) -> DataFrame:
    """The distance to nine digits of the range: every pass counts distances per point into 64 bins and descends into the bin holding rank k."""
    weighted = points if "weight" in points.columns else points.withColumn("weight", F.lit(1).cast("bigint"))
    spans = weighted.agg(*[
        F.struct(F.min(F.col("vec")[j]).alias("lo"), F.max(F.col("vec")[j]).alias("hi")).alias(f"x{j}")
        for j in range(len(weighted.select("vec").first()["vec"]))]).first()
    reach = float(np.sqrt(sum((s["hi"] - s["lo"]) ** 2 for s in spans))) or 1.0
    state = weighted.select("id", "weight", "vec", F.lit(0.0).alias("lo"), F.lit(reach).alias("hi"), F.lit(k).cast("bigint").alias("rank"))

    def count(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        lo, hi = a["lo"].to_numpy()[:, None], a["hi"].to_numpy()[:, None]
        spot = np.clip(np.floor((d - lo) / (hi - lo) * _BINS), -1, _BINS).astype(int)
        spot = np.where((spot == _BINS) & (d <= hi), _BINS - 1, spot)
        inside = (spot >= 0) & (spot < _BINS)
        flat = (np.arange(len(a))[:, None] * _BINS + spot)[inside]
        sums = np.bincount(flat, np.broadcast_to(b["weight"].to_numpy(), d.shape)[inside], minlength=len(a) * _BINS)
        hit = np.nonzero(sums)[0]
        return pd.DataFrame({"id": a["id"].to_numpy()[hit // _BINS], "bin": hit % _BINS, "n": sums[hit].astype("int64")})

    for _ in range(_PASSES):
        counts = near_blocks(state, weighted, "id", count, "id bigint, bin int, n bigint", space).groupBy("id", "bin").agg(F.sum("n").alias("n"))
        running = Window.partitionBy("id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        found = counts.withColumn("cum", F.sum("n").over(running)).join(state.select("id", "rank"), "id").filter("cum >= rank")
        first = found.groupBy("id").agg(F.min(F.struct("bin", "cum", "n")).alias("f"))
        width = (F.col("hi") - F.col("lo")) / _BINS
        # a point whose rank falls out of its bracket by rounding keeps the bracket
        state = cut_lineage(state.join(first, "id", "left").select(
            "id", "weight", "vec", F.coalesce(F.col("lo") + F.col("f.bin") * width, F.col("lo")).alias("lo"),
            F.coalesce(F.col("lo") + (F.col("f.bin") + 1) * width, F.col("hi")).alias("hi"),
            F.coalesce(F.col("rank") - (F.col("f.cum") - F.col("f.n")), F.col("rank")).alias("rank")))
    return state.select("id", "weight", ((F.col("lo") + F.col("hi")) / 2).alias("distance"))


def estimate_bandwidth(points: DataFrame, quantile: float = 0.3) -> float:
    """Mean distance to the neighbour at the given share of all rows."""
    total = points.agg(F.sum("weight")).first()[0]
    kth = kth_distances(points, max(int(total * quantile), 1))
    return kth.agg(F.sum(F.col("distance") * F.col("weight")) / F.sum("weight")).first()[0]


def fit_mean_shift(df: DataFrame, features: Sequence[str], id_col: str, bandwidth: float | None = None, cluster_all: bool = True,
                   bin_seeding: bool = False, max_iter: int = 300) -> DataFrame:
    """``(id, cluster)``. Every point, or every occupied grid cell, climbs to its mode under a flat kernel."""
    points = cut_lineage(distinct_points(df, features, id_col))
    width = bandwidth or estimate_bandwidth(points)
    if width <= 0:
        raise ValueError("bandwidth must be positive")
    space, d = Space("euclidean"), len(features)
    seeds = points.select("id", "vec")
    if bin_seeding:
        cell = F.transform("vec", lambda x: F.round(x / width))
        seeds = points.groupBy(cell.alias("_c")).agg(F.min("id").alias("id")).select(
            "id", F.transform("_c", lambda x: x * width).alias("vec"))

    schema = "id bigint, n bigint, " + ", ".join(f"s{j} double" for j in range(d))
    moving, settled = cut_lineage(seeds), None
    climbers = moving.limit(FEW_SEEDS + 1).collect()
    if len(climbers) <= FEW_SEEDS:
        settled = _climb_few(climbers, points.persist(), width, schema, max_iter)
    elif fits_broadcast(points.count(), d):
        settled = _climb_all(moving, points, width, d, max_iter)
    for turn in range(max_iter if settled is None else 0):
        sums = _ball_sums(moving, points, width, schema, d).groupBy("id").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(d)])
        target = F.array(*[F.col(f"s{j}") / F.col("n") for j in range(d)])
        stepped = moving.join(sums, "id").filter("n > 0").withColumn("_to", target)
        moved = F.sqrt(F.aggregate(F.zip_with("vec", "_to", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))
        stepped = cut_lineage(stepped.select("id", F.col("_to").alias("vec"), "n", (moved <= 1e-3 * width).alias("still")))
        done = stepped.filter("still" if turn + 1 < max_iter else "true").select("id", "vec", "n")
        settled = done if settled is None else settled.unionByName(done)
        moving = stepped.filter("NOT still").select("id", "vec")
        if moving.isEmpty():
            break
    # of equal modes one survives; denser modes absorb those within the bandwidth
    modes = cut_lineage(settled.groupBy("vec").agg(F.max("n").alias("n"), F.min("id").alias("id")))
    centers = _strongest(modes, width, space)

    def nearest(a: pd.DataFrame, b: pd.DataFrame, dist: np.ndarray) -> pd.DataFrame:
        at = dist.argmin(axis=1)
        return pd.DataFrame({"id": a["id"].to_numpy(), "d": dist[np.arange(len(a)), at], "mode": b["rank"].to_numpy()[at]})

    order = number_clusters(centers.withColumn("_o", F.struct((-F.col("n")).alias("neg"), F.col("id").alias("i"))), "_o", "rank")
    closest = near_blocks(points, order, "id", nearest, "id bigint, d double, mode bigint", space, nearest=1)
    best = closest.groupBy("id").agg(F.min(F.struct("d", "mode")).alias("m"))
    cluster = F.col("m.mode") if cluster_all else F.when(F.col("m.d") <= width, F.col("m.mode")).otherwise(-1)
    return _spread_to_copies(df, features, id_col, points.join(best.select("id", cluster.alias("cluster")), "id"), "cluster")


class BallSums:
    """The number and the sum of the weighted points within a distance of any place, without meeting each of them.

    Points stand in columns along the coordinate of most values, in order, with running sums. A column is thin in the other coordinates, or of
    no extent where these have few values; so a ball covers a run of it, and only at both ends of the run points are looked at one by one.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        self.along = int(np.argmax([len(np.unique(x[:, j])) for j in range(x.shape[1])]))
        self.across = [j for j in range(x.shape[1]) if j != self.along]
        size, self.columns, parts = max(COLUMN_ROWS, int(len(x) ** 0.5)), [], [np.arange(len(x))]
        while parts:
            part = parts.pop()
            extent = np.ptp(x[np.ix_(part, self.across)], axis=0) if self.across else np.zeros(1)
            if extent.max() > 0 and len(part) > size:
                axis = self.across[int(extent.argmax())]
                part = part[np.argsort(x[part, axis], kind="stable")]
                values = x[part, axis]
                cut = int(np.searchsorted(values, values[len(part) // 2])) or int(np.searchsorted(values, values[0], side="right"))
                parts += [part[:cut], part[cut:]]
                continue
            part = part[np.argsort(x[part, self.along], kind="stable")]
            own = x[part]
            rows = np.column_stack([weight[part], own * weight[part][:, None]]).astype(float)
            thin = own[:, self.across]
            self.columns.append((own, rows, np.vstack([np.zeros(rows.shape[1]), np.cumsum(rows, axis=0)]), thin.min(axis=0), thin.max(axis=0)))

    def sums(self, places: np.ndarray, width: float) -> np.ndarray:
        """A row for each place: the weight of the points within ``width``, and the sum of each coordinate."""
        out = np.zeros((len(places), places.shape[1] + 1))
        for i in range(0, len(places), STRIP_SEEDS):
            self._add(places[i:i + STRIP_SEEDS], width, out[i:i + STRIP_SEEDS])
        return out

    def _add(self, places: np.ndarray, width: float, out: np.ndarray) -> None:
        at, thin, square = places[:, self.along], places[:, self.across], width * width
        for own, rows, running, lo, hi in self.columns:
            gap = (np.maximum(np.maximum(lo - thin, thin - hi), 0.0) ** 2).sum(axis=1)
            met = np.flatnonzero(gap <= square * (1 + 1e-9))
            if not len(met):
                continue
            span = (np.maximum(hi - thin[met], thin[met] - lo) ** 2).sum(axis=1)
            y, values = at[met], own[:, self.along]
            most = np.sqrt(np.maximum(square * (1 + 1e-9) - gap[met], 0.0))
            sure = square * (1 - 1e-9) - span
            least = np.sqrt(np.maximum(sure, 0.0))
            first, end = np.searchsorted(values, y - most), np.searchsorted(values, y + most, side="right")
            inner, last = np.searchsorted(values, y - least), np.searchsorted(values, y + least, side="right")
            inner, last = np.where(sure > 0, inner, first), np.where(sure > 0, last, first)
            out[met] += running[last] - running[inner]
            for a, b in ((first, inner), (last, end)):
                size = b - a
                if not size.any():
                    continue
                who = np.repeat(np.arange(len(met)), size)
                which = np.arange(len(who)) + np.repeat(a - (np.cumsum(size) - size), size)
                inside = pair_distances(places, own, met[who], which) <= width
                np.add.at(out, met[who[inside]], rows[which[inside]])


def _climb_all(seeds: DataFrame, points: DataFrame, width: float, d: int, max_iter: int) -> DataFrame:
    """Seeds of any number climb to the end in their tasks; the points' running sums, of a measured size, travel to them.

    Seeds that meet are one from there on, named by the least id.
    """
    held = points.select("weight", *[F.col("vec")[j].alias(f"x{j}") for j in range(d)]).toPandas()
    sent = points.sparkSession.sparkContext.broadcast((held[[f"x{j}" for j in range(d)]].to_numpy(float), held["weight"].to_numpy()))

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        if not parts:
            return
        ball, whole = BallSums(*sent.value), pd.concat(parts, ignore_index=True)
        ids, at = whole["id"].to_numpy(), matrix(whole["vec"]).astype(float)
        for turn in range(max_iter):
            sums = ball.sums(at, width)
            some = sums[:, 0] > 0  # a seed without points has no mode
            ids, at, n = ids[some], at[some], sums[some, 0]
            to = sums[some, 1:] / n[:, None]
            still = np.linalg.norm(to - at, axis=1) <= 1e-3 * width if turn + 1 < max_iter else np.ones(len(to), dtype=bool)
            if still.any():
                yield pd.DataFrame({"id": ids[still], "vec": list(to[still]), "n": n[still].astype("int64")})
            if still.all():
                return
            at, named = np.unique(to[~still], axis=0, return_inverse=True)
            least = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(least, named.ravel(), ids[~still])
            ids = least

    tasks = max(-(-seeds.count() // SEED_ROWS), 1)
    return cut_lineage(seeds.repartitionByRange(tasks, "vec").mapInPandas(climb, "id bigint, vec array<double>, n bigint"))


def _ball_sums(seeds: DataFrame, points: DataFrame, width: float, schema: str, d: int) -> DataFrame:
    """``(id, n, s0..)`` of each seed and part of the points: a part's running sums are made where some of the seeds meet it."""
    parts, groups = (max(-(-t.count() // PART_ROWS), 1) for t in (points, seeds))
    left = seeds.select("id", "vec").withColumns({"_g": F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), "_p": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    right = points.select("weight", "vec").withColumns({"_p": F.pmod(F.xxhash64("vec"), F.lit(parts)).cast("int"),
                                                        "_g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": [], **{f"s{j}": [] for j in range(d)}})
        sums = BallSums(matrix(b["vec"]).astype(float), b["weight"].to_numpy()).sums(matrix(a["vec"]).astype(float), width)
        return pd.DataFrame({"id": a["id"].to_numpy(), "n": sums[:, 0].astype("int64"), **{f"s{j}": sums[:, j + 1] for j in range(d)}})

    tasks = parts * groups
    left, right = left.repartition(tasks, "_p", "_g"), right.repartition(tasks, "_p", "_g")
    return left.groupBy("_p", "_g").cogroup(right.groupBy("_p", "_g")).applyInPandas(run, schema)


def _climb_few(climbers: list, points: DataFrame, width: float, schema: str, max_iter: int) -> DataFrame:
    """A bounded number of seeds travels to the points instead of the points being shuffled."""
    at = {r["id"]: np.array(r["vec"], dtype=float) for r in climbers}
    size, open_ids = {}, sorted(at)
    for _ in range(max_iter):
        ids, here = np.array(open_ids), np.stack([at[i] for i in open_ids])

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                vectors = np.stack(pdf["vec"].to_numpy())
                near = (cross_distances(here, vectors, "euclidean") <= width) * pdf["weight"].to_numpy()[None, :]
                total = near @ vectors
                yield pd.DataFrame({"id": ids, "n": near.sum(axis=1).astype("int64"), **{f"s{j}": total[:, j] for j in range(total.shape[1])}})

        d = here.shape[1]
        rows = points.mapInPandas(sums, schema).groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(d)])
        still_open = []
        for r in rows.collect():
            if not r["n"]:
                continue  # a seed without points has no mode
            to = np.array([r[f"s{j}"] / r["n"] for j in range(d)])
            moved = float(np.linalg.norm(to - at[r["id"]]))
            at[r["id"]], size[r["id"]] = to, r["n"]
            if moved > 1e-3 * width:
                still_open.append(r["id"])
        open_ids = sorted(still_open)
        if not open_ids:
            break
    found = [(int(i), [float(v) for v in at[i]], int(n)) for i, n in size.items()]
    return points.sparkSession.createDataFrame(found, "id bigint, vec array<double>, n bigint")


def _strongest(modes: DataFrame, width: float, space: Space) -> DataFrame:
    """Modes with no denser surviving mode within ``width``, denser ones first.

    The densest few thousand are settled by themselves, and what they absorb goes; modes that are left after some passes are many and far
    apart, and are settled in rounds.
    """
    open_modes, kept, order = modes, None, [F.desc("n"), F.col("id")]
    for _ in range(FEW_PASSES):
        top, chosen = open_modes.orderBy(*order).limit(FEW_MODES).collect(), []
        at = np.array([r["vec"] for r in top], dtype=float)
        while len(at):
            chosen.append(top[0])
            far = np.flatnonzero(cross_distances(at[:1], at, "euclidean")[0] > width)
            at, top = at[far], [top[i] for i in far]
        if not chosen:
            return cut_lineage(kept)
        winners = modes.sparkSession.createDataFrame([tuple(r) for r in chosen], modes.schema)
        kept = winners if kept is None else kept.unionByName(winners)
        centres = np.array([r["vec"] for r in chosen], dtype=float)

        def beyond(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf[(cross_distances(matrix(pdf["vec"]), centres, "euclidean") > width).all(axis=1)]

        open_modes = cut_lineage(open_modes.mapInPandas(beyond, modes.schema))

    def rival(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        na, nb = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None, :]
        ia, ib = a["id"].to_numpy()[:, None], b["id"].to_numpy()[None, :]
        beats = (d <= width) & ((nb > na) | ((nb == na) & (ib < ia)))
        return pd.DataFrame({"id": a["id"].to_numpy(), "beaten": beats.any(axis=1)})

    while not open_modes.isEmpty():
        beaten = near_blocks(open_modes, open_modes, "id", rival, "id bigint, beaten boolean", space, radius=width)
        flags = beaten.groupBy("id").agg(F.max("beaten").alias("beaten"))
        judged = cut_lineage(open_modes.join(flags, "id", "left"))
        winners = judged.filter("NOT coalesce(beaten, false)").drop("beaten")
        kept = kept.unionByName(winners)
        rest = judged.filter("beaten").drop("beaten")
        near_winner = near_blocks(rest, winners, "id", lambda a, b, d: pd.DataFrame({"id": a["id"].to_numpy()[(d <= width).any(axis=1)]}),
                                  "id bigint", space, radius=width).distinct()
        open_modes = cut_lineage(rest.join(near_winner, "id", "left_anti"))
    return cut_lineage(kept)


def similarity_edges(df: DataFrame, features: Sequence[str], id_col: str, n_neighbors: int) -> DataFrame:
    """``(i, k, s)``: negative squared distance of each point to its nearest ones, so few rows per ``i``."""
    near = nearest_neighbors(df, df, features, id_col, n_neighbors, "sqeuclidean", skip_self=True)
    return near.select(F.col(id_col).cast("bigint").alias("i"), F.col("neighbor").cast("bigint").alias("k"), (-F.col("distance")).alias("s"))


def fit_affinity_propagation(df: DataFrame, features: Sequence[str], id_col: str, damping: float = 0.5, max_iter: int = 200,
                             convergence_iter: int = 15, preference: float | None = None, n_neighbors: int | None = None) -> DataFrame:
    """``(id, cluster, exemplar)`` by message passing (Frey & Dueck 2007) between all pairs, or along a sparse table of ``n_neighbors``.

    Where no row is an exemplar after ``max_iter`` rounds, clusters are -1.
    """
    if not 0.5 <= damping < 1:
        raise ValueError("damping lies in [0.5, 1)")
    if n_neighbors is None:
        exemplars = all_pairs_exemplars(df, features, id_col, damping, max_iter, convergence_iter, preference)
        return _by_exemplar(df, features, id_col, exemplars, exemplars.select(F.col("k").alias("i"), F.col("k").alias("exemplar")))
    pairs = cut_lineage(similarity_edges(df, features, id_col, n_neighbors))
    pref = preference if preference is not None else exact_quantiles(pairs, ["s"], [0.5]).first()["s_q0"]
    own = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(id_col).cast("bigint").alias("k"), F.lit(float(pref)).alias("s"))
    state = cut_lineage(pairs.unionByName(own).select("i", "k", "s", F.lit(0.0).alias("r"), F.lit(0.0).alias("a")))
    per_i = Window.partitionBy("i")
    best_first = Window.partitionBy("i").orderBy(F.desc("_t"), "k")
    steady, last = 0, None
    for turn in range(max_iter):
        # responsibility: similarity less the best competing offer of the same point
        offers = state.withColumn("_t", F.col("a") + F.col("s")).withColumn("_n", F.row_number().over(best_first))
        tops = offers.withColumns({"_m1": F.max("_t").over(per_i), "_m2": F.max(F.when(F.col("_n") > 1, F.col("_t"))).over(per_i)})
        rival = F.when(F.col("_n") == 1, F.col("_m2")).otherwise(F.col("_m1"))
        fresh = F.col("s") - F.coalesce(rival, F.lit(-1e300))
        sent = tops.select("i", "k", "s", "a", (F.lit(damping) * F.col("r") + F.lit(1 - damping) * fresh).alias("r"))
        # availability: support gathered by a candidate, summed per candidate before the shuffle
        support = sent.groupBy("k").agg(
            F.sum(F.when(F.col("i") != F.col("k"), F.greatest("r", F.lit(0.0))).otherwise(0.0)).alias("_sum"),
            F.max(F.when(F.col("i") == F.col("k"), F.col("r"))).alias("_self"))
        joined = sent.join(support, "k")
        gathered = F.when(F.col("i") == F.col("k"), F.col("_sum")).otherwise(
            F.least(F.lit(0.0), F.col("_self") + F.col("_sum") - F.greatest("r", F.lit(0.0))))
        state = joined.select("i", "k", "s", "r", (F.lit(damping) * F.col("a") + F.lit(1 - damping) * gathered).alias("a"))
        if turn % 3 == 2 or turn == max_iter - 1:
            state = cut_lineage(state)
            # a fingerprint of the exemplar set tells whether it changed
            mark = tuple(state.filter("i = k AND r + a > 0").agg(F.count("*"), F.bit_xor(F.xxhash64("k"))).first())
            steady = steady + 3 if mark == last else 0
            last = mark
            if steady >= convergence_iter and mark[0]:
                break
    exemplars = state.filter("i = k AND r + a > 0").select("k")
    choice = state.join(exemplars, "k").groupBy("i").agg(F.max(F.struct(
        (F.col("i") == F.col("k")).alias("self"), F.col("s"), (-F.col("k")).alias("neg"))).alias("b"))
    return _by_exemplar(df, features, id_col, exemplars, cut_lineage(choice.select("i", (-F.col("b.neg")).alias("exemplar"))))


def _by_exemplar(df: DataFrame, features: Sequence[str], id_col: str, exemplars: DataFrame, placed: DataFrame) -> DataFrame:
    """Clusters by exemplar; rows that are not in ``placed`` go to the nearest one."""
    if exemplars.isEmpty():
        return df.select(id_col, F.lit(-1).cast("bigint").alias("cluster"), F.lit(None).cast("bigint").alias("exemplar"))
    chosen = df.join(exemplars.select(F.col("k").alias(id_col)), id_col, "left_semi")
    lost = df.join(placed.select(F.col("i").alias(id_col)), id_col, "left_anti")
    nearest = nearest_neighbors(lost, chosen, features, id_col, 1, "sqeuclidean")
    assigned = placed.select(F.col("i").alias(id_col), "exemplar").unionByName(
        nearest.select(F.col(id_col).cast("bigint").alias(id_col), F.col("neighbor").cast("bigint").alias("exemplar")))
    return number_clusters(assigned.withColumn("_c", F.col("exemplar")), "_c").select(id_col, "cluster", "exemplar")


def fit_spectral(df: DataFrame, features: Sequence[str], id_col: str, n_clusters: int = 3, affinity: str = "rbf", n_neighbors: int = 10,
                 gamma: float = 1.0, degree: float = 3.0, coef0: float = 1.0, max_iter: int = 20) -> DataFrame:
    """``(id, cluster)`` by k-means over the leading eigenvectors of a sparse normalised affinity, rows scaled to length 1 (Ng et al. 2002).

    Rows without any affinity are -1. Iteration stops at ``max_iter`` filters or at residuals below 1e-4.
    """
    metric = "cosine" if affinity == "cosine" else "sqeuclidean"
    near = nearest_neighbors(df, df, features, id_col, n_neighbors, metric, skip_self=True)
    edges = near.select(F.col(id_col).cast("bigint").alias("src"), F.col("neighbor").cast("bigint").alias("dst"), "distance")
    weight: Column
    if affinity == "rbf":
        weight = F.exp(-F.lit(gamma) * F.col("distance"))
    elif affinity == "nearest_neighbors":
        weight = F.lit(1.0)
    elif affinity == "cosine":
        weight = F.greatest(1 - F.col("distance"), F.lit(0.0))
    elif affinity in ("poly", "sigmoid"):
        # the inner product follows from the lengths: x·y = (|x|² + |y|² - |x - y|²) / 2
        lengths = as_points(df, features, [id_col]).select(
            F.col(id_col).cast("bigint").alias("_v"), F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x).alias("_q"))
        edges = edges.join(lengths.select(F.col("_v").alias("src"), F.col("_q").alias("qs")), "src").join(
            lengths.select(F.col("_v").alias("dst"), F.col("_q").alias("qd")), "dst")
        inner = F.lit(gamma) * (F.col("qs") + F.col("qd") - F.col("distance")) / 2 + F.lit(coef0)
        weight = F.greatest(F.pow(inner, F.lit(degree)) if affinity == "poly" else F.tanh(inner), F.lit(0.0))
    else:
        raise ValueError("affinity is rbf, nearest_neighbors, poly, sigmoid or cosine")
    # each pair once: both directions of a neighbour relation add up
    undirected = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("weight"))
    table = undirected.groupBy("src", "dst").agg((F.sum("weight") / 2).alias("weight")).filter("weight > 0")
    vectors, _ = leading_vectors(normalised_edges(table), n_clusters, max_iter, tol=1e-4)
    axes = vectors.columns[1:]
    length = F.sqrt(total([F.col(e) * F.col(e) for e in axes]))
    rows = cut_lineage(vectors.select("id", *[F.when(length > 0, F.col(e) / length).otherwise(0.0).alias(e) for e in axes]))
    found = fit_kmeans(rows, axes, n_clusters).transform(rows).select("id", "cluster") if axes else rows.withColumn("cluster", F.lit(0))
    alone = df.select(F.col(id_col).cast("bigint").alias("id")).join(found, "id", "left")
    return alone.select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))
