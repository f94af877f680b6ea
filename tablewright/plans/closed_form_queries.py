"""Models checked where they have a closed form: single splits, first rounds, single steps, two-predictor fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.columns import total
from tablewright.operators import boosting, density, hierarchy, kmeans, linear, mixture, prepare, scaling, scoring, trees
from tablewright.plans.cluster_queries import _POINTS, _START, CUSTOMER_FEATURES, customer_points
from tablewright.plans.registry import query, table

SIZES = 256  # more bins than p_size has distinct values, so that every split is a candidate


def sized_parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("label"))


def stump_sql(value: str, penalty: float = 0.0) -> str:
    """The best split of ``p_size`` by squared error; ``value`` is the prediction from ``m`` (mean) and ``leaf`` (mean residual of the side)."""
    p = penalty
    return f"""WITH m AS (SELECT avg(p_retailprice) AS m FROM part),
  t AS (SELECT p_size AS x, count(*) AS n, sum(p_retailprice - m) AS s FROM part, m GROUP BY p_size),
  c AS (SELECT x, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER () AS an, sum(s) OVER () AS total FROM t WINDOW w AS (ORDER BY x)),
  b AS (SELECT *, ls * ls / (ln + {p}) + (total - ls) * (total - ls) / (an - ln + {p}) AS score FROM c WHERE an > ln ORDER BY score DESC, x LIMIT 1),
  leaves AS (SELECT p_partkey, m, CASE WHEN p_size <= b.x THEN ls / (ln + {p}) ELSE (total - ls) / (an - ln + {p}) END AS leaf FROM part, b, m)
  SELECT p_partkey, round({value}, 4) AS prediction FROM leaves"""


def _stump(name, sql, fit):
    @query(name, sql)
    def _(spark, sf):
        parts = sized_parts(spark, sf)
        return fit(parts).transform(parts).select("p_partkey", F.round("prediction", 4).alias("prediction"))


_stump("l12_fitted_stump", stump_sql("m + leaf"), lambda t: trees.fit_tree(t, ["p_size"], classification=False, max_depth=1, max_bins=SIZES))
_stump("l13_single_tree", stump_sql("m + leaf"), lambda t: trees.fit_forest(
    t, ["p_size"], classification=False, n_estimators=1, max_depth=1, bootstrap=False, max_features="all", max_bins=SIZES))
_stump("l15_first_round", stump_sql("m + 0.1 * leaf"), lambda t: boosting.fit_gradient_boosting(
    t, ["p_size"], ["p_partkey"], classification=False, n_estimators=1, max_depth=1, bins=2000))
_stump("l17_fitted_first_round", stump_sql("m + 0.3 * leaf", 1.0), lambda t: boosting.fit_boosted(
    t, ["p_size"], ["p_partkey"], classification=False, preset="xgboost", n_estimators=1, max_depth=1, bins=2000))


# classes by one split: the share of each class on either side decides
@query("l12_fitted_class_stump", """WITH d AS (SELECT doc_id, n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)),
  s AS (SELECT doc_id, y, x > 400 AS side FROM d), v AS (SELECT side, avg(y) >= 0.5 AS one FROM s GROUP BY side)
  SELECT doc_id, one::INT::DOUBLE AS prediction FROM s JOIN v USING (side)""")
def _(spark, sf):
    # one binary feature has one possible split
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", (F.col("n_chars") > 400).cast("double").alias("side"), F.col("quality").cast("double").alias("label"))
    return trees.fit_tree(rows, ["side"], max_depth=1).transform(rows).select("doc_id", "prediction")


@query("m12_importance_of_one_split", f"""WITH s AS ({stump_sql('m + leaf')}) SELECT 'p_size' AS feature, 1.0::DOUBLE AS importance
  UNION ALL SELECT 'constant', 0.0 WHERE (SELECT count(DISTINCT prediction) FROM s) = 2""")
def _(spark, sf):
    parts = sized_parts(spark, sf).withColumn("constant", F.lit(1.0))
    return trees.feature_importance(trees.fit_tree(parts, ["p_size", "constant"], classification=False, max_depth=1, max_bins=SIZES), spark)


# two predictors, standardised on the training part
_TWO = """src AS (SELECT p_partkey, p_size AS a, dense_rank() OVER (ORDER BY p_brand) - 1 AS b, p_retailprice AS label FROM part),
  split AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || p_partkey)) <= ceil(0.2 * (SELECT count(*) FROM src)) AS is_test FROM src),
  st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM split WHERE NOT is_test),
  prep AS (SELECT p_partkey, is_test, label, (a - ma) / sa AS a, (b - mb) / sb AS b FROM split, st),
  g AS (SELECT count(*) AS n, avg(label) AS my, covar_pop(a, b) AS ab, covar_pop(a, label) AS ay, covar_pop(b, label) AS gy FROM prep WHERE NOT is_test)"""


def _pair_query(name, penalty, fit):
    r = f"(1 + {penalty} / n)"  # standardised, so the variances are 1

    @query(name, f"""WITH {_TWO} SELECT p_partkey, label, round(my + (ay * {r} - gy * ab) / ({r} * {r} - ab * ab) * a
      + (gy * {r} - ay * ab) / ({r} * {r} - ab * ab) * b, 3) AS prediction FROM prep, g WHERE is_test""")
    def _(spark, sf):
        parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
        ready = prepare.prepare_supervised(parts, "p_retailprice", ["p_partkey"], classification=False)
        return fit(ready.train, ready.features).transform(ready.test).select("p_partkey", "label", F.round("prediction", 3).alias("prediction"))


_pair_query("l1_linear_regression_two", 0.0, linear.fit_linear)
_pair_query("l2_ridge_two", 25.0, lambda t, f: linear.fit_ridge(t, f, alpha=25.0))


@query("l5_logistic_optimum", """SELECT * FROM (VALUES ('intercept', 0.0), ('n_chars', 0.0), ('upper', 0.0)) t(feature, gradient)""")
def _(spark, sf):
    """The mean gradient of an unpenalised fit is zero for every coefficient."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("quality").cast("double").alias("label"), F.log1p("n_chars").alias("n_chars"),
        (F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("upper")).persist()
    names = ["n_chars", "upper"]
    rows = scaling.fit_scaler(rows, names, "standard").transform(rows)
    fitted = linear.fit_logistic(rows, names, penalty=None, max_iter=500, tol=1e-12).model
    margin = total([F.lit(float(w)) * F.col(f) for w, f in zip(fitted.coefficients, names)] + [F.lit(float(fitted.intercept))])
    error = 1 / (1 + F.exp(-margin)) - F.col("label")
    sums = rows.agg(F.avg(error).alias("intercept"), *[F.avg(error * F.col(f)).alias(f) for f in names])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), (F.round(f, 4) + 0.0).alias("gradient")) for f in ("intercept", *names)])))


def _em_sql(last: str) -> str:
    """One step of expectation maximisation with diagonal covariances from fixed means."""
    start = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(_START))

    def density(w, vx, vy):
        return f"ln({w}) - 0.5 * (2 * ln(2 * pi()) + ln({vx}) + ln({vy})) - 0.5 * (power(x - mx, 2) / {vx} + power(y - my, 2) / {vy})"

    return f"""WITH {_POINTS}, v AS (SELECT var_pop(x) AS vx, var_pop(y) AS vy FROM pts), m0 AS (SELECT * FROM (VALUES {start}) t(k, mx, my)),
  s AS (SELECT c_custkey, k, x, y, {density('1.0 / 3', 'vx', 'vy')} AS s FROM pts, m0, v),
  r AS (SELECT k, x, y, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS r FROM s WINDOW w AS (PARTITION BY c_custkey)),
  c AS (SELECT k, sum(r) AS n, sum(r * x) / sum(r) AS mx, sum(r * y) / sum(r) AS my FROM r GROUP BY k),
  p AS (SELECT k, any_value(c.n) / (SELECT count(*) FROM pts) AS weight, any_value(c.mx) AS mx, any_value(c.my) AS my,
    sum(r * power(x - c.mx, 2)) / any_value(c.n) + 1e-6 AS vx, sum(r * power(y - c.my, 2)) / any_value(c.n) + 1e-6 AS vy FROM r JOIN c USING (k) GROUP BY k),
  l AS (SELECT sum(l) AS log_likelihood FROM (SELECT c_custkey, ln(sum(exp({density('weight', 'vx', 'vy')}))) AS l FROM pts, p GROUP BY c_custkey))
  {last}"""


def _one_step(spark, sf):
    return mixture.fit_mixture(customer_points(spark, sf), CUSTOMER_FEATURES, 3, "diag", max_iter=1, centers=_START)


@query("c4_mixture_one_step", _em_sql("SELECT k::INT AS k, round(weight, 6) AS weight, round(mx, 6) AS mx, round(my, 6) AS my, round(vx, 6) AS vx, round(vy, 6) AS vy FROM p"))
def _(spark, sf):
    m = _one_step(spark, sf)
    rows = [(k, *[round(float(v), 6) for v in (w, *mean, *cov)]) for k, (w, mean, cov) in enumerate(zip(m.weights, m.means, m.covariances))]
    return spark.createDataFrame(rows, "k int, weight double, mx double, my double, vx double, vy double")


@query("m11_criteria_after_one_step", _em_sql("""SELECT round(log_likelihood, 4) AS log_likelihood, 14 AS n_parameters,
  round(-2 * log_likelihood + 14 * ln((SELECT count(*) FROM pts)), 4) AS bic, round(-2 * log_likelihood + 28, 4) AS aic FROM l"""))
def _(spark, sf):
    return _one_step(spark, sf).criteria(spark).select(
        F.round("log_likelihood", 4).alias("log_likelihood"), "n_parameters", F.round("bic", 4).alias("bic"), F.round("aic", 4).alias("aic"))


def _batches_sql() -> str:
    start = ", ".join(f"({k}, {x}, {y}, 0)" for k, (x, y) in enumerate(_START))
    ctes = [_POINTS, f"m0 AS (SELECT * FROM (VALUES {start}) t(k, mx, my, w))"]
    for step in range(2):
        ctes.append(f"""a{step} AS (SELECT k, avg(x) AS ax, avg(y) AS ay, count(*) AS n FROM (SELECT x, y, k FROM pts, m{step} WHERE c_custkey % 2 = {step}
          QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY power(x - mx, 2) + power(y - my, 2), k) = 1) GROUP BY k)""")
        ctes.append(f"""m{step + 1} AS (SELECT k, mx + coalesce(n / (w + n) * (ax - mx), 0) AS mx, my + coalesce(n / (w + n) * (ay - my), 0) AS my, w + coalesce(n, 0) AS w
          FROM m{step} LEFT JOIN a{step} USING (k))""")
    return f"WITH {', '.join(ctes)} SELECT k::INT AS k, round(mx, 6) AS mx, round(my, 6) AS my FROM m2"


@query("c2_two_batches", _batches_sql())
def _(spark, sf):
    """Two mini-batch steps, on even and then on odd customers."""
    points = customer_points(spark, sf).persist()
    model = kmeans.CenterModel(CUSTOMER_FEATURES, [list(c) for c in _START])
    for step in range(2):
        model = kmeans.update_centers(model, points.filter(F.pmod("c_custkey", F.lit(2)) == step))
    return spark.createDataFrame([(k, round(x, 6), round(y, 6)) for k, (x, y) in enumerate(model.centers)], "k int, mx double, my double")


@query("c6_core_distances", f"""WITH {_POINTS}, d AS (SELECT a.c_custkey, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM pts a, pts b)
  SELECT c_custkey, round(d, 6) AS core FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d) = 10""")
def _(spark, sf):
    rows = customer_points(spark, sf)
    core = density.core_distances(rows, CUSTOMER_FEATURES, "c_custkey", 10)
    return density._spread_to_copies(rows, CUSTOMER_FEATURES, "c_custkey", core, "core").select("c_custkey", F.round("core", 6).alias("core"))


@query("c12_birch_cells", f"""WITH {_POINTS}, c AS (SELECT c_custkey, floor(x / (2 * 0.3 / sqrt(2)))::BIGINT AS cx, floor(y / (2 * 0.3 / sqrt(2)))::BIGINT AS cy FROM pts)
  SELECT c_custkey, dense_rank() OVER (ORDER BY cx, cy) - 1 AS cluster FROM c""")
def _(spark, sf):
    """Without a number of clusters every feature cell is one."""
    return hierarchy.fit_birch(customer_points(spark, sf), CUSTOMER_FEATURES, "c_custkey", None, threshold=0.3)


# suppliers join the customers, scaled as these are; components by least id
@query("x2_refit_components", """WITH RECURSIVE s AS (SELECT avg(c_nationkey) AS mx, stddev_pop(c_nationkey) AS sx, avg(c_acctbal) AS my, stddev_pop(c_acctbal) AS sy FROM customer),
  pts AS (SELECT c_custkey AS id, (c_nationkey - mx) / sx AS x, (c_acctbal - my) / sy AS y FROM customer, s
    UNION ALL SELECT s_suppkey + 1000000000, (s_nationkey - mx) / sx, (s_acctbal - my) / sy FROM supplier, s),
  e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM pts a, pts b WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 0.1),
  reach AS (SELECT id, id AS root FROM pts UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id),
  comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id), num AS (SELECT id, dense_rank() OVER (ORDER BY c) - 1 AS cluster FROM comp)
  SELECT id AS c_custkey, cluster FROM num WHERE id >= 1000000000""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", *CUSTOMER_FEATURES)
    suppliers = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 10**9).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    fresh = scaling.fit_scaler(rows, CUSTOMER_FEATURES, "standard").transform(suppliers).select("c_custkey", *CUSTOMER_FEATURES)
    return scoring.refit_with(customer_points(spark, sf), fresh, lambda both: hierarchy.fit_single_linkage(
        both, CUSTOMER_FEATURES, "c_custkey", distance_threshold=0.1), "c_custkey")
