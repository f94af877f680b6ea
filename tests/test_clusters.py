"""Clustering against brute force on small frames, including the paths meant for large tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.distances import Space
from tablewright.operators import cluster_metrics, density, graph, hdbscan, hierarchy, kmeans, linkage, mixture, modes, neighbors, pairwise, spanning


def points_of(df):
    rows = df.orderBy("id").collect()
    return np.array([[r["x"], r["y"]] for r in rows])


def labels_of(df, column="cluster"):
    return [r[column] for r in df.orderBy("id").collect()]


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def components(n, pairs):
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


@pytest.mark.parametrize("small", [0, 10**6])
def test_connected_components(spark, small):
    edges = [(i, i + 1) for i in range(0, 30)] + [(40, 41), (41, 42), (50, 60), (60, 55), (7, 29)]
    vertices = spark.range(62)
    got = graph.connected_components(vertices, spark.createDataFrame(edges, "a bigint, b bigint"), small=small)
    assert [r["component"] for r in got.orderBy("id").collect()] == components(62, edges)


def test_many_blocks_equal_one(spark, blobs, monkeypatch):
    """Small blocks and pivots give the same neighbours as a plain sort."""
    monkeypatch.setattr(pairwise, "BLOCK", 16)
    monkeypatch.setattr(pairwise, "_SMALL", 8)
    x = points_of(blobs)
    d = distances(x)
    got = neighbors.nearest_neighbors(blobs, blobs, ["x", "y"], "id", 4).orderBy("id", "rank").collect()
    for i in range(len(x)):
        want = sorted(range(len(x)), key=lambda j: (d[i, j], j))[:4]
        assert [r["neighbor"] for r in got if r["id"] == i] == want


@pytest.mark.parametrize("metric", ["manhattan", "chebyshev", "cosine", "canberra", "braycurtis", "hamming", "correlation", "sqeuclidean"])
def test_metrics(metric):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 5)), rng.normal(size=(3, 5))
    space = Space(metric)
    got = space.outward(space.between(space.rows(a), space.rows(b)))
    formulas = {
        "manhattan": lambda u, v: np.abs(u - v).sum(), "chebyshev": lambda u, v: np.abs(u - v).max(),
        "cosine": lambda u, v: 1 - u @ v / np.linalg.norm(u) / np.linalg.norm(v),
        "canberra": lambda u, v: (np.abs(u - v) / (np.abs(u) + np.abs(v))).sum(),
        "braycurtis": lambda u, v: np.abs(u - v).sum() / np.abs(u + v).sum(), "hamming": lambda u, v: (u != v).mean(),
        "correlation": lambda u, v: 1 - np.corrcoef(u, v)[0, 1], "sqeuclidean": lambda u, v: ((u - v) ** 2).sum()}
    want = [[formulas[metric](u, v) for v in b] for u in a]
    assert np.allclose(got, want)


@pytest.mark.parametrize("block", [4096, 20])
def test_dbscan(spark, blobs, monkeypatch, block):
    monkeypatch.setattr(pairwise, "BLOCK", block)
    monkeypatch.setattr(pairwise, "_SMALL", block)
    x, eps, k = points_of(blobs), 0.4, 5
    near = distances(x) <= eps
    core = near.sum(1) >= k
    comp = components(len(x), [(i, j) for i in range(len(x)) for j in range(i) if near[i, j] and core[i] and core[j]])
    want = []
    for i in range(len(x)):
        cores = [j for j in range(len(x)) if near[i, j] and core[j]]
        want.append(comp[i] if core[i] else comp[min(cores)] if cores else -1)
    number = {c: n for n, c in enumerate(sorted(set(want) - {-1}))}
    got = density.fit_dbscan(blobs, ["x", "y"], "id", eps, k)
    assert labels_of(got) == [number.get(c, -1) for c in want]
    optics = density.fit_optics(blobs, ["x", "y"], "id", eps, k)
    assert labels_of(optics) == labels_of(got)


@pytest.mark.parametrize("small", [0, 10**6])
def test_spanning_tree_weight(spark, blobs, monkeypatch, small):
    monkeypatch.setattr(pairwise, "BLOCK", 32)
    pts = density.distinct_points(blobs, ["x", "y"], "id")
    tree = spanning.spanning_tree(pts, Space("euclidean"), small=small)
    x = np.array([r["vec"] for r in pts.orderBy("id").collect()])
    d = distances(x)
    inside, weight = [0], 0.0
    out = set(range(1, len(x)))
    while out:
        w, j = min((d[i, j], j) for i in inside for j in out)
        weight += w
        inside.append(j)
        out.remove(j)
    assert tree.count() == len(x) - 1
    assert tree.agg(F.sum("w")).first()[0] == pytest.approx(weight)


def test_single_linkage_and_ward(spark, blobs):
    three = blobs.filter("id < 120")
    truth = [i // 40 for i in range(120)]
    assert same_partition(labels_of(hierarchy.fit_single_linkage(three, ["x", "y"], "id", distance_threshold=2.0)), truth)
    for linkage in ("ward", "complete", "average"):
        assert same_partition(labels_of(hierarchy.fit_agglomerative(three, ["x", "y"], "id", 3, linkage)), truth)


def brute_linkage(x, linkage, n_clusters):
    """One merge at a time: always the two clusters at the least distance, each new distance from all pairs of rows."""
    groups, d = [[i] for i in range(len(x))], distances(x)
    sums, sizes = d.copy(), np.ones(len(x))
    far = d.copy() if linkage != "average" else d / 1.0
    centre = x.astype(float).copy()
    np.fill_diagonal(far, np.inf)
    for _ in range(len(x) - n_clusters):
        i, j = np.unravel_index(np.argmin(far), far.shape)
        if linkage == "complete":
            row = np.maximum(far[i], far[j])
        elif linkage == "average":
            sums[i] += sums[j]
            sums[:, i] = sums[i]
            row = sums[i] / ((sizes[i] + sizes[j]) * sizes)
        else:
            centre[i] = (sizes[i] * centre[i] + sizes[j] * centre[j]) / (sizes[i] + sizes[j])
            n = sizes[i] + sizes[j]
            row = np.sqrt(2 * n * sizes / (n + sizes)) * np.linalg.norm(centre - centre[i], axis=1)
        row = np.where(np.isinf(far[i]) | np.isinf(far[j]), np.inf, row)
        far[i], far[:, i], far[j], far[:, j] = row, row, np.inf, np.inf
        sizes[i] += sizes[j]
        groups[i] += groups[j]
        groups[j] = []
    labels = np.zeros(len(x), dtype=int)
    for c, g in enumerate(groups):
        labels[g] = c
    return labels.tolist()


@pytest.mark.parametrize("kind", ["ward", "complete", "average"])
@pytest.mark.parametrize(("n", "rest"), [(200, 1024), (257, 1024), (257, 120), (1300, 1024)])
def test_linkages_equal_one_merge_at_a_time(spark, kind, n, rest):
    """Below and beyond any bound the same rule holds, and rounds on Spark give what one task gives."""
    x = np.random.default_rng(n).normal(size=(n, 3))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, x double, y double, z double")
    got = labels_of(hierarchy.fit_agglomerative(rows, ["x", "y", "z"], "id", 7, kind, rest=rest))
    assert same_partition(got, brute_linkage(x, kind, 7))


def test_linkage_odd_tables(spark):
    schema = "id bigint, x double, y double"
    one = spark.createDataFrame([(4, 1.0, 2.0)], schema)
    copies = spark.createDataFrame([(i, float(i // 6), 0.0) for i in range(12)] + [(20, 50.0, 0.0)], schema)
    for kind in ("ward", "complete", "average"):
        assert labels_of(hierarchy.fit_agglomerative(one, ["x", "y"], "id", 1, kind)) == [0]
        assert hierarchy.fit_agglomerative(one.filter("false"), ["x", "y"], "id", 2, kind).count() == 0
        for rest in (3, 1024) if kind == "ward" else (1024,):
            assert labels_of(hierarchy.fit_agglomerative(copies, ["x", "y"], "id", 3, kind, rest=rest)) == [0] * 6 + [1] * 6 + [2]
        assert labels_of(hierarchy.fit_agglomerative(copies, ["x", "y"], "id", None, kind, distance_threshold=8.0)) == [0] * 12 + [1]
    staged = labels_of(hierarchy.fit_agglomerative(copies, ["x", "y"], "id", 2, "ward", micro_clusters=3))
    assert same_partition(staged, [0] * 12 + [1])


def test_ward_merge_heights():
    x = np.array([[0.0], [1.0], [10.0], [12.0], [30.0]])
    merges = linkage.merge_all(np.arange(5), np.ones(5), np.abs(x - x.T), "ward")
    assert [m[:2] for m in sorted(merges, key=lambda m: m[2])] == [(0, 1), (2, 3), (0, 2), (0, 4)]
    heights = sorted(m[2] for m in merges)
    assert heights == pytest.approx([1.0, 2.0, np.sqrt(2 * 2 * 2 / 4) * 10.5, np.sqrt(2 * 4 * 1 / 5) * (30 - 5.75)])


def brute_hdbscan(x, m):
    """A direct, slow reading of the definition: single linkage on mutual reachability, condensed, most stable."""
    d = distances(x)
    core = np.sort(d, axis=1)[:, m - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    edges = sorted((reach[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    member = {i: (frozenset([i]), None) for i in range(len(x))}
    where = {i: i for i in range(len(x))}
    nodes, n = {}, len(x)
    for w, i, j in edges:
        a, b = where[i], where[j]
        if a != b:
            nodes[n] = (w, a, b)
            member[n] = (member[a][0] | member[b][0], None)
            for v in member[n][0]:
                where[v] = n
            n += 1
    clusters = {}

    def walk(node, birth):
        own, stability, kids = node, 0.0, []
        while True:
            w, a, b = nodes[node]
            lam = 1 / w
            sa, sb = len(member[a][0]), len(member[b][0])
            if sa >= m and sb >= m:
                stability += (sa + sb) * (lam - birth)
                kids = [walk(a, lam), walk(b, lam)]
                break
            if sa < m and sb < m:
                stability += (sa + sb) * (lam - birth)
                break
            stability += min(sa, sb) * (lam - birth)
            node = a if sa >= m else b
        clusters[own] = (stability, kids, member[own][0])
        return own

    root = walk(n - 1, 0.0)

    def best(c):
        stability, kids, members = clusters[c]
        if not kids:
            return stability, [members]
        below = [best(k) for k in kids]
        value = sum(v for v, _ in below)
        if c != root and stability >= value:
            return stability, [members]
        return value, [s for _, sets in below for s in sets]

    return sorted(best(root)[1], key=min)


@pytest.mark.parametrize("group_edges", [10**6, 70])
def test_hdbscan(spark, blobs, group_edges, monkeypatch):
    if group_edges < 100:  # the small-group case also takes the path for very many clusters
        monkeypatch.setattr(hdbscan, "SMALL_TREE", 0)
    data = blobs.filter("id < 120 or id >= 125")
    rows = data.orderBy("id").collect()
    want = brute_hdbscan(np.array([[r["x"], r["y"]] for r in rows]), 6)
    got = hdbscan.fit_hdbscan(data, ["x", "y"], "id", 6, group_edges=group_edges).orderBy("id").collect()
    found = {}
    for i, r in enumerate(got):
        found.setdefault(r["cluster"], set()).add(i)
    assert [found[c] for c in sorted(found) if c >= 0] == [set(s) for s in want]


def test_silhouette_fixture(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0), (1, 1.0, 1.0, 0), (2, 10.0, 10.0, 1), (3, 11.0, 11.0, 1)], "id bigint, x double, y double, cluster int")
    assert cluster_metrics.silhouette(df, ["x", "y"], "id").first()[0] == pytest.approx(0.899749, abs=1e-6)
    report = {r["metric"]: r["value"] for r in cluster_metrics.cluster_report(df, ["x", "y"], "id").collect()}
    assert report["n_clusters"] == 2 and report["n_noise"] == 0
    assert report["inertia"] == pytest.approx(2.0)


def test_silhouette_noise_and_single(spark):
    df = spark.createDataFrame([(0, 0.0, 0), (1, 1.0, 0), (2, 9.0, -1)], "id bigint, x double, cluster int")
    assert cluster_metrics.silhouette(df, ["x"], "id").first()[0] == 0.0
    assert cluster_metrics.cluster_counts(df).first().asDict() == {"n_clusters": 1, "n_noise": 1}


def test_kmeans_and_elbow(spark, blobs):
    three = blobs.filter("id < 120")
    truth = [i // 40 for i in range(120)]
    assert same_partition(labels_of(kmeans.fit_kmeans(three, ["x", "y"], 3).transform(three)), truth)
    assert same_partition(labels_of(kmeans.fit_minibatch(three, ["x", "y"], ["id"], 3, batch_size=60).transform(three)), truth)
    curve = kmeans.elbow(three, ["x", "y"], 6).orderBy("k").collect()
    costs = [r["inertia"] for r in curve]
    assert costs == sorted(costs, reverse=True)
    assert [r["k"] for r in curve if r["is_elbow"]] == [3]


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_mixture(spark, blobs, kind):
    three = blobs.filter("id < 120")
    model = mixture.fit_mixture(three, ["x", "y"], 3, kind, max_iter=20)
    assert same_partition(labels_of(model.transform(three)), [i // 40 for i in range(120)])
    # the log-likelihood, recomputed densely
    x, total = points_of(three), 0.0
    for row in x:
        p = 0.0
        for w, m, c in zip(model.weights, model.means, model.covariances):
            cov = np.diag(c) if np.ndim(c) == 1 else np.asarray(c)
            gap = row - np.array(m)
            p += w * np.exp(-0.5 * gap @ np.linalg.solve(cov, gap)) / np.sqrt(np.linalg.det(2 * np.pi * cov))
        total += np.log(p)
    criteria = model.criteria(spark).first()
    assert criteria["log_likelihood"] == pytest.approx(total)
    assert criteria["n_parameters"] == {"full": 17, "tied": 11, "diag": 14, "spherical": 11}[kind]


def test_mean_shift(spark, blobs):
    three = blobs.filter("id < 120")
    truth = [i // 40 for i in range(120)]
    for seeding in (True, False):
        assert same_partition(labels_of(modes.fit_mean_shift(three, ["x", "y"], "id", 2.5, bin_seeding=seeding)), truth)


def test_mean_shift_joined_seeds(spark, blobs, monkeypatch):
    monkeypatch.setattr(modes, "FEW_SEEDS", 0)
    three = blobs.filter("id < 120 AND id % 4 = 0")
    got = labels_of(modes.fit_mean_shift(three, ["x", "y"], "id", 2.5, bin_seeding=True))
    assert same_partition(got, [i // 10 for i in range(30)])


def test_kth_distance(spark, blobs):
    d = np.sort(distances(points_of(blobs)), axis=1)
    pts = density.distinct_points(blobs, ["x", "y"], "id")
    got = {r["id"]: r["distance"] for r in modes.kth_distances(pts, 30).collect()}
    assert all(got[i] == pytest.approx(d[i, 29], abs=1e-6) for i in got)


def test_affinity_spectral_birch(spark, blobs):
    three = blobs.filter("id < 120")
    truth = [i // 40 for i in range(120)]
    got = modes.fit_affinity_propagation(three, ["x", "y"], "id", damping=0.7, max_iter=60, preference=-60.0, n_neighbors=119)
    assert same_partition(labels_of(got), truth)
    assert same_partition(labels_of(modes.fit_spectral(three, ["x", "y"], "id", 3, "rbf", n_neighbors=119, gamma=0.1)), truth)
    assert same_partition(labels_of(hierarchy.fit_birch(three, ["x", "y"], "id", 3, 0.4)), truth)


def test_spanning_forest_within_a_radius(spark, monkeypatch):
    """Cells and blocks of a few rows, so that block pairs share rows; the components are those of all pairs."""
    import numpy as np
    from tablewright.functions.distances import Space
    from tablewright.operators import pairwise, spanning

    monkeypatch.setattr(pairwise, "_SMALL", 20)
    monkeypatch.setattr(pairwise, "BLOCK", 9)
    x = np.random.default_rng(8).uniform(0, 10, size=(150, 2))
    points = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id bigint, vec array<double>")
    for radius in (0.5, 0.9):
        tree = spanning.spanning_tree(points, Space("euclidean"), radius=radius)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        near, root = d <= radius, np.arange(150)
        for _ in range(150):
            root = np.array([root[near[i]].min() for i in range(150)])
        got = {r.id: r.component for r in spanning.cut_tree(points.select("id"), tree, threshold=np.nextafter(radius, 99)).collect()}
        assert got == dict(enumerate(root.tolist())) and tree.count() == 150 - len(set(root.tolist()))


def test_streamed_centres_survive_a_restart(spark, blobs, tmp_path):
    from tablewright.operators import kmeans
    from tablewright.streaming import online

    start = kmeans.CenterModel(["x", "y"], [[0.0, 0.0], [5.0, 1.0], [1.0, 6.0]])
    parts = [blobs.filter(f"pmod(id, 3) = {k}").coalesce(1) for k in range(3)]
    want = start
    for part in parts:
        want = kmeans.update_centers(want, part)
    folder, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    for part in parts:  # each run is a new query, with centres that know nothing of the runs before
        part.write.mode("append").parquet(folder)
        got = online.update_on_stream(online.read_stream(spark, folder, blobs, 1), start, progress)
    assert got.weights == want.weights and all(abs(a - b) < 1e-9 for p, q in zip(got.centers, want.centers) for a, b in zip(p, q))
    again = online.update_on_stream(online.read_stream(spark, folder, blobs, 1), start, progress)  # nothing new
    assert again.centers == got.centers


def test_leading_vectors_against_numpy(spark):
    from tablewright.operators.spectral import leading_vectors, normalised_edges
    rng = np.random.default_rng(4)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 150, (700, 2)) if a != b}
    rows = [(a, b, float(rng.uniform(0.2, 1))) for a, b in sorted(pairs)]
    w = np.zeros((150, 150))
    for a, b, v in rows:
        w[a, b] = w[b, a] = v
    d = w.sum(axis=1)
    values, vectors = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    frame, got = leading_vectors(normalised_edges(spark.createDataFrame(rows, "src bigint, dst bigint, weight double")), 4)
    pdf = frame.toPandas().set_index("id").sort_index()
    assert np.allclose(got, values[::-1][:4], atol=1e-6)
    for j in range(4):
        want = vectors[:, -1 - j]
        have = pdf[f"e{j}"].to_numpy()
        assert np.abs(have * np.sign(have @ want) - want).max() < 1e-4


def test_edits_of_one_cell(spark):
    from tablewright.operators import edits
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "_row_id bigint, v double")
    twice = spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2), (2, None, 1), (2, None, 1), (9, 1.0, 1)], "_row_id bigint, value double, order int")
    got = edits.apply_cell_edits(df, twice, "v")
    assert {r["_row_id"]: r.v for r in got.collect()} == {1: 6.0, 2: None, 3: 3.0} and got.count() == 3
    with pytest.raises(Exception, match="two values"):
        edits.apply_cell_edits(df, twice.drop("order"), "v").collect()
