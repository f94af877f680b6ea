"""Clustering and cluster-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import cluster_metrics as cm
from tablewright.operators import density, hdbscan, hierarchy, kmeans, mixture, modes, prepare
from tablewright.plans.model_queries import EMBEDDING_FEATURES, _rounded, embedding_points
from tablewright.plans.registry import query, table

CUSTOMER_FEATURES = ["c_nationkey", "c_acctbal"]
_POINTS = """pts AS (SELECT c_custkey, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS x,
  (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS y FROM customer)"""


def customer_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", *CUSTOMER_FEATURES)
    return prepare.prepare_unsupervised(rows, ["c_custkey"]).train


# --- cluster quality on the labelled embeddings ------------------------------------------

_LONG = """c AS (SELECT vec_id, label AS l, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_points(spark, sf)


@query("m6_silhouette", f"""WITH {_LONG}, d AS (SELECT a.vec_id, a.l, b.l AS o, b.vec_id AS v, sqrt(sum(power(a.x - b.x, 2))) AS d
    FROM c a JOIN c b ON a.i = b.i GROUP BY ALL),
  s AS (SELECT vec_id, l, o, sum(d) AS s, count(*) AS n FROM d GROUP BY ALL),
  p AS (SELECT vec_id, max(CASE WHEN l = o THEN n END) AS n, max(CASE WHEN l = o AND n > 1 THEN s / (n - 1) END) AS a,
    min(CASE WHEN l <> o THEN s / n END) AS b FROM s GROUP BY vec_id)
  SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM p""")
def _(spark, sf):
    return _rounded(cm.silhouette(_labelled(spark, sf), EMBEDDING_FEATURES, "vec_id", "label"))


@query("m6_silhouette_squared", f"""WITH {_LONG}, d AS (SELECT a.vec_id, a.l, b.l AS o, b.vec_id AS v, sum(power(a.x - b.x, 2)) AS d
    FROM c a JOIN c b ON a.i = b.i GROUP BY ALL),
  s AS (SELECT vec_id, l, o, sum(d) AS s, count(*) AS n FROM d GROUP BY ALL),
  p AS (SELECT vec_id, max(CASE WHEN l = o THEN n END) AS n, max(CASE WHEN l = o AND n > 1 THEN s / (n - 1) END) AS a,
    min(CASE WHEN l <> o THEN s / n END) AS b FROM s GROUP BY vec_id)
  SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette_squared FROM p""")
def _(spark, sf):
    return _rounded(cm.silhouette_squared(_labelled(spark, sf), EMBEDDING_FEATURES, "label"))


@query("m7_calinski_harabasz", f"""WITH {_LONG}, g AS (SELECT i, avg(x) AS g FROM c GROUP BY i), k AS (SELECT l, i, avg(x) AS m, count(*) AS n FROM c GROUP BY l, i),
  b AS (SELECT sum(n * power(m - g, 2)) AS b FROM k JOIN g USING (i)), w AS (SELECT sum(power(x - m, 2)) AS w FROM c JOIN k USING (l, i))
  SELECT round(b * ((SELECT count(*) FROM embeddings) - (SELECT count(DISTINCT label) FROM embeddings))
    / (w * ((SELECT count(DISTINCT label) FROM embeddings) - 1)), 6) AS calinski_harabasz FROM b, w""")
def _(spark, sf):
    return _rounded(cm.calinski_harabasz(_labelled(spark, sf), EMBEDDING_FEATURES, "label"))


@query("m8_davies_bouldin", f"""WITH {_LONG}, k AS (SELECT l, i, avg(x) AS m FROM c GROUP BY l, i),
  p AS (SELECT vec_id, l, sqrt(sum(power(x - m, 2))) AS d FROM c JOIN k USING (l, i) GROUP BY vec_id, l), s AS (SELECT l, avg(d) AS s FROM p GROUP BY l),
  cd AS (SELECT a.l AS a, b.l AS b, sqrt(sum(power(a.m - b.m, 2))) AS d FROM k a JOIN k b ON a.i = b.i AND a.l <> b.l GROUP BY ALL)
  SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a, max((sa.s + sb.s) / d) AS r FROM cd JOIN s sa ON sa.l = a JOIN s sb ON sb.l = b GROUP BY a)""")
def _(spark, sf):
    return _rounded(cm.davies_bouldin(_labelled(spark, sf), EMBEDDING_FEATURES, "label"))


_NOISY = "CASE WHEN label = 3 THEN -1 ELSE label END"


@query("m9_cluster_sizes", f"SELECT {_NOISY} AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, sf):
    return cm.cluster_sizes(table(spark, sf, "embeddings").select(F.expr(_NOISY).alias("cluster")))


@query("m9_cluster_counts", f"""SELECT count(DISTINCT CASE WHEN l <> -1 THEN l END) AS n_clusters, count(*) FILTER (WHERE l = -1) AS n_noise
  FROM (SELECT {_NOISY} AS l FROM embeddings)""")
def _(spark, sf):
    return cm.cluster_counts(table(spark, sf, "embeddings").select(F.expr(_NOISY).alias("cluster")))


@query("m10_inertia", f"WITH {_LONG}, k AS (SELECT l, i, avg(x) AS m FROM c GROUP BY l, i) SELECT round(sum(power(x - m, 2)), 6) AS inertia FROM c JOIN k USING (l, i)")
def _(spark, sf):
    return _rounded(cm.inertia(_labelled(spark, sf), EMBEDDING_FEATURES, "label"))


@query("m11_information_criteria")
def _(spark, sf):
    parts = []
    for kind in ("full", "tied", "diag", "spherical"):
        model = mixture.fit_mixture(customer_points(spark, sf), CUSTOMER_FEATURES, 3, kind)
        parts.append(model.criteria(spark).withColumn("covariance", F.lit(kind)))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


# --- k-means and mixtures ----------------------------------------------------------------

_START = [(-1.0, -1.0), (0.0, 0.5), (1.0, -0.5)]


def _lloyd_sql(rounds: int) -> str:
    ctes = [_POINTS, "m0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(_START)) + ") t(k, mx, my))"]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS (SELECT c_custkey, x, y, k FROM pts, m{r} QUALIFY row_number() OVER
          (PARTITION BY c_custkey ORDER BY power(x - mx, 2) + power(y - my, 2), k) = 1)""")
        ctes.append(f"m{r + 1} AS (SELECT k, avg(x) AS mx, avg(y) AS my FROM a{r} GROUP BY k)")
    return f"WITH {', '.join(ctes)} SELECT c_custkey, k::INT AS cluster FROM a{rounds}"


@query("c1_kmeans_fixed_start", _lloyd_sql(3))
def _(spark, sf):
    points = customer_points(spark, sf).persist()
    return kmeans.fit_from_centers(points, CUSTOMER_FEATURES, _START, max_iter=3, tol=0.0).transform(points).select("c_custkey", "cluster")


@query("c1_kmeans")
def _(spark, sf):
    points = customer_points(spark, sf)
    return kmeans.fit_kmeans(points, CUSTOMER_FEATURES, 3, n_init=2).transform(points).select("c_custkey", "cluster")


@query("c2_minibatch_kmeans")
def _(spark, sf):
    points = customer_points(spark, sf)
    return kmeans.fit_minibatch(points, CUSTOMER_FEATURES, ["c_custkey"], 3).transform(points).select("c_custkey", "cluster")


@query("c3_elbow")
def _(spark, sf):
    return kmeans.elbow(customer_points(spark, sf), CUSTOMER_FEATURES)


@query("c4_gaussian_mixture")
def _(spark, sf):
    points = customer_points(spark, sf)
    return mixture.fit_mixture(points, CUSTOMER_FEATURES, 3, "full").transform(points).select("c_custkey", "cluster")


@query("c4_gaussian_mixture_diagonal")
def _(spark, sf):
    points = customer_points(spark, sf)
    return mixture.fit_mixture(points, CUSTOMER_FEATURES, 3, "diag").transform(points).select("c_custkey", "cluster")


# --- density and hierarchy ---------------------------------------------------------------


def _dbscan_sql(eps: float, min_samples: int, cores_only: bool = False) -> str:
    """Neighbour counts, core graph closure, border assignment, numbering by least core id."""
    return f"""WITH RECURSIVE {_POINTS},
      e AS MATERIALIZED (SELECT a.c_custkey AS a, b.c_custkey AS b FROM pts a, pts b
        WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= {eps}),
      core AS MATERIALIZED (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= {min_samples}),
      ce AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
      reach AS (SELECT id, id AS root FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.id),
      comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id),
      border AS (SELECT a AS id, min(b) AS core_id FROM e WHERE b IN (SELECT id FROM core) AND a NOT IN (SELECT id FROM core) GROUP BY a),
      named AS (SELECT id, c FROM comp UNION ALL SELECT border.id, c FROM border JOIN comp ON comp.id = core_id),
      num AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS n FROM (SELECT DISTINCT c FROM comp))
      SELECT c_custkey, coalesce(n, -1) AS cluster, c_custkey IN (SELECT id FROM core) AS core
      FROM pts LEFT JOIN named ON named.id = c_custkey LEFT JOIN num USING (c)"""


@query("c5_dbscan", _dbscan_sql(0.12, 6))
def _(spark, sf):
    return density.fit_dbscan(customer_points(spark, sf), CUSTOMER_FEATURES, "c_custkey", eps=0.12, min_samples=6)


@query("c5_dbscan_embeddings")
def _(spark, sf):
    return density.fit_dbscan(embedding_points(spark, sf), EMBEDDING_FEATURES, "vec_id", eps=0.9, min_samples=5, metric="cosine")


@query("c6_hdbscan")
def _(spark, sf):
    return hdbscan.fit_hdbscan(customer_points(spark, sf), CUSTOMER_FEATURES, "c_custkey", min_cluster_size=10)


@query("c7_optics", _dbscan_sql(0.12, 6))
def _(spark, sf):
    return density.fit_optics(customer_points(spark, sf), CUSTOMER_FEATURES, "c_custkey", eps=0.12, min_samples=6)


@query("c8_single_linkage", f"""WITH RECURSIVE {_POINTS},
    e AS MATERIALIZED (SELECT a.c_custkey AS a, b.c_custkey AS b FROM pts a, pts b WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 0.1),
    reach AS (SELECT c_custkey AS id, c_custkey AS root FROM pts UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id),
    comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id)
    SELECT id AS c_custkey, dense_rank() OVER (ORDER BY c) - 1 AS cluster FROM comp""")
def _(spark, sf):
    return hierarchy.fit_single_linkage(customer_points(spark, sf), CUSTOMER_FEATURES, "c_custkey", distance_threshold=0.1)


@query("c8_ward_linkage")
def _(spark, sf):
    return hierarchy.fit_agglomerative(customer_points(spark, sf), CUSTOMER_FEATURES, "c_custkey", 3, "ward")


@query("c9_mean_shift")
def _(spark, sf):
    return modes.fit_mean_shift(customer_points(spark, sf), CUSTOMER_FEATURES, "c_custkey")


@query("c9_bandwidth", f"""WITH {_POINTS}, d AS (SELECT a.c_custkey, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM pts a, pts b),
  k AS (SELECT c_custkey, d FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d) = floor(0.3 * (SELECT count(*) FROM customer)))
  SELECT round(avg(d), 5) AS bandwidth FROM k""")
def _(spark, sf):
    points = density.distinct_points(customer_points(spark, sf), CUSTOMER_FEATURES, "c_custkey").persist()
    total = points.agg(F.sum("weight")).first()[0]
    kth = modes.kth_distances(points, int(0.3 * total))
    return kth.agg(F.round(F.sum(F.col("distance") * F.col("weight")) / F.sum("weight"), 5).alias("bandwidth"))


@query("c10_affinity_propagation")
def _(spark, sf):
    return modes.fit_affinity_propagation(embedding_points(spark, sf), EMBEDDING_FEATURES, "vec_id")


@query("c11_spectral")
def _(spark, sf):
    return modes.fit_spectral(embedding_points(spark, sf), EMBEDDING_FEATURES, "vec_id", 10, "rbf")


@query("c12_birch")
def _(spark, sf):
    return hierarchy.fit_birch(customer_points(spark, sf), CUSTOMER_FEATURES, "c_custkey", 3, threshold=0.3)


@query("c12_clustering_features", f"""WITH {_POINTS} SELECT floor(x / (2 * 0.3 / sqrt(2)))::BIGINT AS cx, floor(y / (2 * 0.3 / sqrt(2)))::BIGINT AS cy,
  count(*) AS n, round(sum(x), 6) AS s0, round(sum(y), 6) AS s1, round(sum(x * x + y * y), 6) AS q FROM pts GROUP BY 1, 2""")
def _(spark, sf):
    cells = hierarchy.clustering_features(customer_points(spark, sf), CUSTOMER_FEATURES, 0.3)
    return _rounded(cells.select(F.col("_cell")[0].alias("cx"), F.col("_cell")[1].alias("cy"), "n", "s0", "s1", "q"))
