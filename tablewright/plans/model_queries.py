"""Preparation, evaluation, and supervised models with closed forms."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import vector_columns
from tablewright.operators import (
    bayes, crossval, encoding, evaluation, linear, neighbors, prepare, ranking, scaling, training,
)
from tablewright.plans import model_sql as S
from tablewright.plans.registry import query, table

ORDER_KEY = ["o_orderkey"]


def orders_with_customers(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        "o_orderkey", *S.ORDER_FEATURES, "o_orderstatus")


def prepared_orders(spark: SparkSession, sf: str, scaler: str = "standard", encoder: str = "ordinal") -> prepare.Prepared:
    return prepare.prepare_supervised(orders_with_customers(spark, sf), "o_orderstatus", ORDER_KEY, encoder, scaler)


def _order_predictions(spark: SparkSession, sf: str, scaler: str = "standard", fit=bayes.fit_gaussian, features=None) -> DataFrame:
    ready = prepared_orders(spark, sf, scaler)
    model = fit(ready.train, features or ready.features)
    return model.transform(ready.test).select("o_orderkey", "label", "prediction")


def _rounded(df: DataFrame, digits: int = 6, *skip: str) -> DataFrame:
    doubles = [n for n, t in df.dtypes if t == "double" and n not in skip]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


_METRICS_SQL = """, k AS (SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS guessed,
    count(*) FILTER (WHERE label = c AND prediction = c) AS hit FROM pred, (SELECT DISTINCT label AS c FROM prep) GROUP BY c)
  SELECT round(sum(hit) / sum(support), 6) AS accuracy,
    round(sum(CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END * support) / sum(support), 6) AS precision,
    round(sum(CASE WHEN support > 0 THEN hit / support ELSE 0 END * support) / sum(support), 6) AS recall,
    round(sum(2 * hit / (support + guessed) * support) / sum(support), 6) AS f1_score FROM k"""


@query("flagship_order_status", f"WITH {S.scaled('standard')}{S.gaussian()}{_METRICS_SQL}")
def _(spark, sf):
    return _rounded(evaluation.classification_metrics(_order_predictions(spark, sf)))


@query("train_and_evaluate_classifier", f"WITH {S.scaled('standard')}{S.gaussian()}{_METRICS_SQL}")
def _(spark, sf):
    done = training.train_and_evaluate(orders_with_customers(spark, sf), "o_orderstatus", "gaussian_naive_bayes", "classification", ORDER_KEY)
    return _rounded(done.metrics)


@query("train_and_evaluate_regressor", f"WITH {S.PART_LINE}, pred AS (SELECT label, my + n * cxy / (n * vx + 10.0) * (x - mx) AS prediction FROM prep, g WHERE is_test) {S.REGRESSION_METRICS}")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    metrics = training.train_and_evaluate(parts, "p_retailprice", "ridge", "regression", ["p_partkey"], alpha=10.0).metrics
    return _rounded(metrics, 6, "mse").withColumn("mse", F.round("mse", 4))


# --- feature preparation -----------------------------------------------------------------


@query("p1_train_test_split", """SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) <=
  ceil(0.2 * (SELECT count(*) FROM orders)) AS is_test FROM orders""")
def _(spark, sf):
    train, test = ranking.train_test_split(table(spark, sf, "orders").select("o_orderkey"), ORDER_KEY, 0.2)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("p2_encode_label", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS label FROM orders")
def _(spark, sf):
    labelled, _ = prepare.encode_label(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    return labelled


@query("p3_ordinal_encode", f"WITH {S.ENCODED} SELECT o_orderkey, is_test, o_orderpriority, c_mktsegment FROM enc")
def _(spark, sf):
    columns = ["o_orderpriority", "c_mktsegment"]
    train, test = ranking.train_test_split(orders_with_customers(spark, sf).select("o_orderkey", *columns), ORDER_KEY)
    mapping = encoding.fit_codes(train, columns)
    return (encoding.encode_codes(train, mapping, columns).withColumn("is_test", F.lit(False))
            .unionByName(encoding.encode_codes(test, mapping, columns).withColumn("is_test", F.lit(True))))


def _target_sql(c: str, y: str, n: str = "") -> str:
    return f"""SELECT '{c}' AS col, {c} AS value, count(*) AS n, avg({y}) AS m, var_pop({y}) AS v FROM split WHERE NOT is_test GROUP BY {c}"""


_PART_SPLIT = """split AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || p_partkey)) <= ceil(0.2 * (SELECT count(*) FROM part)) AS is_test FROM part)"""


@query("p4_target_encode", f"""WITH {_PART_SPLIT}, o AS (SELECT avg(p_retailprice) AS gm, var_pop(p_retailprice) AS gv FROM split WHERE NOT is_test),
  t AS ({_target_sql('p_brand', 'p_retailprice')} UNION ALL {_target_sql('p_type', 'p_retailprice')}),
  e AS (SELECT col, value, (gv * n / (gv * n + v)) * m + (1 - gv * n / (gv * n + v)) * gm AS enc FROM t, o)
  SELECT p_partkey, is_test, round(b.enc, 6) AS p_brand, round(y.enc, 6) AS p_type FROM split
  JOIN e b ON b.col = 'p_brand' AND b.value = p_brand JOIN e y ON y.col = 'p_type' AND y.value = p_type""")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.col("p_retailprice").alias("label"))
    train, test = ranking.train_test_split(parts, ["p_partkey"])
    means = encoding.fit_target_encoder(train, ["p_brand", "p_type"], "label")
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return _rounded(encoding.encode_target(both.drop("label"), means, ["p_brand", "p_type"]))


@query("p4_target_encode_classes", f"""WITH {S.SOURCE}, t AS (SELECT o_orderpriority AS value, c, count(*) AS n,
    avg((label = c)::INT) AS m, var_pop((label = c)::INT) AS v FROM split, range(3) r(c) WHERE NOT is_test GROUP BY ALL),
  o AS (SELECT c, avg((label = c)::INT) AS gm, var_pop((label = c)::INT) AS gv FROM split, range(3) r(c) WHERE NOT is_test GROUP BY c),
  e AS (SELECT value, c, gv * n / (gv * n + v) * m + (1 - gv * n / (gv * n + v)) * gm AS enc FROM t JOIN o USING (c))
  SELECT o_orderkey, round(a.enc, 8) AS o_orderpriority_0, round(b.enc, 8) AS o_orderpriority_1, round(d.enc, 8) AS o_orderpriority_2
  FROM split JOIN e a ON a.value = o_orderpriority AND a.c = 0 JOIN e b ON b.value = o_orderpriority AND b.c = 1
  JOIN e d ON d.value = o_orderpriority AND d.c = 2""")
def _(spark, sf):
    labelled, _ = prepare.encode_label(orders_with_customers(spark, sf).select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderstatus")
    train, _ = ranking.train_test_split(labelled, ORDER_KEY)
    means = encoding.fit_target_encoder(train, ["o_orderpriority"], "label", [0.0, 1.0, 2.0])
    return _rounded(encoding.encode_target(labelled.drop("label"), means, ["o_orderpriority"]), 8)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("p5_one_hot", "SELECT c_custkey, c_acctbal, " + ", ".join(
    f"(c_mktsegment = '{s}')::INT::DOUBLE AS c_mktsegment_{s}" for s in _SEGMENTS) + " FROM customer")
def _(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    train, _ = ranking.train_test_split(customers, ["c_custkey"])
    return encoding.encode_one_hot(customers, encoding.fit_codes(train, ["c_mktsegment"]), ["c_mktsegment"])


_CUSTOMER_SPLIT = """split AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || c_custkey)) <= ceil(0.2 * (SELECT count(*) FROM customer)) AS is_test FROM customer)"""


@query("p6_unseen_values", f"""WITH {_CUSTOMER_SPLIT} SELECT 'c_name' AS "column", c_name AS value FROM split WHERE is_test
  AND c_name NOT IN (SELECT c_name FROM split WHERE NOT is_test)""")
def _(spark, sf):
    train, test = ranking.train_test_split(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"])
    columns = ["c_name", "c_mktsegment"]
    return encoding.unseen_values(test, encoding.fit_codes(train, columns), columns)


@query("p6_apply_keep_unseen", f"""WITH {_CUSTOMER_SPLIT}, m AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM
    (SELECT DISTINCT c_name FROM split WHERE NOT is_test))
  SELECT c_custkey, coalesce(code, -1)::DOUBLE AS c_name FROM split LEFT JOIN m USING (c_name)""")
def _(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    train, _ = ranking.train_test_split(customers, ["c_custkey"])
    return encoding.encode_codes(customers, encoding.fit_codes(train, ["c_name"]), ["c_name"], handle_unseen="keep")


def _info_sql() -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, row_number() OVER (ORDER BY {c}) - 1 AS code,
      count(*) OVER () AS cardinality, count(*) OVER () > 1000 AS warning FROM (SELECT DISTINCT {c} FROM customer)"""
                              for c in ("c_name", "c_mktsegment"))


@query("p7_encoding_info", _info_sql())
def _(spark, sf):
    return encoding.encoding_info(encoding.fit_codes(table(spark, sf, "customer"), ["c_name", "c_mktsegment"]))


@query("p7_encoding_json", _info_sql())
def _(spark, sf):
    mapping = encoding.fit_codes(table(spark, sf, "customer"), ["c_name", "c_mktsegment"])
    return encoding.encoding_info(encoding.mapping_from_json(spark, encoding.mapping_to_json(mapping)))


def _prep_out(how: str, where: str = "") -> str:
    return (f"WITH {S.scaled(how)} SELECT o_orderkey, is_test, label, " + ", ".join(f"round({c}, 6) AS {c}" for c in S.ORDER_FEATURES)
            + f" FROM prep {where}")


def _both_parts(ready: prepare.Prepared) -> DataFrame:
    return _rounded(ready.train.withColumn("is_test", F.lit(False)).unionByName(ready.test.withColumn("is_test", F.lit(True))))


@query("p8_standard_scale", _prep_out("standard").replace(", label, ", ", "))
def _(spark, sf):
    encoded = prepared_orders(spark, sf, "none")
    scaler = scaling.fit_scaler(encoded.train, encoded.features, "standard")
    parts = [scaler.transform(p).withColumn("is_test", F.lit(t)) for p, t in ((encoded.train, False), (encoded.test, True))]
    return _rounded(parts[0].unionByName(parts[1]).drop("label"))


@query("p9_minmax_scale", _prep_out("minmax"))
def _(spark, sf):
    return _both_parts(prepared_orders(spark, sf, "minmax"))


@query("p10_no_scale", _prep_out("none"))
def _(spark, sf):
    return _both_parts(prepared_orders(spark, sf, "none"))


@query("p11_prepare_supervised", _prep_out("standard"))
def _(spark, sf):
    return _both_parts(prepared_orders(spark, sf, "standard"))


@query("p12_prepare_unsupervised", """WITH e AS (SELECT p_partkey, (dense_rank() OVER (ORDER BY p_name) - 1)::DOUBLE AS p_name,
    (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS p_brand, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS p_type,
    p_size::DOUBLE AS p_size, p_retailprice FROM part)
  SELECT p_partkey, """ + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}"
                                    for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")) + " FROM e")
def _(spark, sf):
    return _rounded(prepare.prepare_unsupervised(table(spark, sf, "part"), ["p_partkey"]).train)


@query("p13_column_stages", """WITH e AS (SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS v0, p_size, p_retailprice FROM part)
  SELECT p_partkey, v0, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS v1,
  round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS v2 FROM e""")
def _(spark, sf):
    from pyspark.ml import Pipeline

    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    coded = encoding.encode_codes(parts, encoding.fit_codes(parts, ["p_brand"]), ["p_brand"])
    fitted = Pipeline(stages=prepare.column_stages(["p_brand"], ["p_size", "p_retailprice"])).fit(coded)
    vectors = fitted.transform(coded).select("p_partkey", vector_to_array("features").alias("v"))
    return _rounded(vectors.select("p_partkey", *[F.col("v")[i].alias(f"v{i}") for i in range(3)]))


# least squares on two predictors in closed form; neither shift nor scale of a predictor changes the predictions
@query("p14_fitted_stages", """WITH src AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS a, p_size AS b, p_retailprice AS label FROM part),
  split AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || p_partkey)) <= ceil(0.2 * (SELECT count(*) FROM src)) AS is_test FROM src),
  g AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(label) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, label) AS ay,
    covar_pop(b, label) AS gy FROM split WHERE NOT is_test)
  SELECT p_partkey, label, round(my + (ay * bb - gy * ab) / (aa * bb - ab * ab) * (a - ma) + (gy * aa - ay * ab) / (aa * bb - ab * ab) * (b - mb), 4) AS prediction
  FROM split, g WHERE is_test""")
def _(spark, sf):
    from pyspark.ml.regression import LinearRegression

    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.col("p_retailprice").alias("label"))
    coded = encoding.encode_codes(parts, encoding.fit_codes(parts, ["p_brand"]), ["p_brand"])
    train, test = ranking.train_test_split(coded, ["p_partkey"])
    fitted = prepare.full_stages(["p_brand"], ["p_size"], LinearRegression(featuresCol="features", labelCol="label")).fit(train)
    return fitted.transform(test).select("p_partkey", "label", F.round("prediction", 4).alias("prediction"))


# --- evaluation --------------------------------------------------------------------------


@query("m1_classification_metrics", f"WITH {S.scaled('minmax')}{S.gaussian()}{_METRICS_SQL}")
def _(spark, sf):
    return _rounded(evaluation.classification_metrics(_order_predictions(spark, sf, "minmax")))


@query("m2_confusion_matrix", f"""WITH {S.scaled('standard')}{S.gaussian()}, l AS (SELECT label AS x FROM pred UNION SELECT prediction FROM pred)
  SELECT a.x AS actual, b.x AS predicted, count(p.label) AS n FROM l a CROSS JOIN l b LEFT JOIN pred p ON p.label = a.x AND p.prediction = b.x
  GROUP BY a.x, b.x""")
def _(spark, sf):
    return evaluation.confusion_matrix(_order_predictions(spark, sf))


@query("m3_class_distribution", f"WITH {S.SOURCE} SELECT label::DOUBLE AS class, count(*) AS n FROM split WHERE is_test GROUP BY label")
def _(spark, sf):
    return evaluation.class_distribution(prepared_orders(spark, sf).test)


def _part_line(spark: SparkSession, sf: str) -> prepare.Prepared:
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return prepare.prepare_supervised(parts, "p_retailprice", ["p_partkey"], classification=False)


_LINE_PRED = ", pred AS (SELECT p_partkey, label, my + cxy / vx * (x - mx) AS prediction FROM prep, g WHERE is_test)"


@query("m4_regression_metrics", f"WITH {S.PART_LINE}{_LINE_PRED} {S.REGRESSION_METRICS}")
def _(spark, sf):
    ready = _part_line(spark, sf)
    pred = linear.fit_linear(ready.train, ready.features).transform(ready.test)
    metrics = evaluation.regression_metrics(pred)
    return _rounded(metrics, 6, "mse").withColumn("mse", F.round("mse", 4))


@query("m5_residual_statistics", """WITH s AS (SELECT o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS r FROM orders)
  SELECT round(avg(r), 4) AS residual_mean, round(stddev_pop(r), 4) AS residual_std, round(min(r), 4) AS residual_min,
  round(max(r), 4) AS residual_max FROM s""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("label"))
    means = orders.groupBy("o_orderpriority").agg(F.avg("label").alias("prediction"))
    metrics = evaluation.regression_metrics(orders.join(F.broadcast(means), "o_orderpriority"))
    return _rounded(metrics.select("residual_mean", "residual_std", "residual_min", "residual_max"), 4)


@query("m13_folds", f"""WITH {S.SOURCE}, t AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS r FROM split WHERE NOT is_test)
  SELECT o_orderkey, (ntile(5) OVER (ORDER BY r) - 1)::INT AS fold FROM t""")
def _(spark, sf):
    train, _ = ranking.train_test_split(orders_with_customers(spark, sf).select("o_orderkey"), ORDER_KEY)
    return crossval.with_folds(train, ORDER_KEY, 5)


def _cv_sql() -> str:
    """Gaussian scores per fold, each fold scored by a model of the other folds."""
    fs = S.ORDER_FEATURES
    stats = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in fs)
    term = " + ".join(f"(-0.5 * ln(2 * pi() * (v_{f} + eps)) - power({f} - m_{f}, 2) / (2 * (v_{f} + eps)))" for f in fs)
    return f"""WITH {S.scaled('standard')}, t AS (SELECT *, (ntile(5) OVER (ORDER BY md5('42:' || o_orderkey)) - 1)::INT AS fold FROM prep WHERE NOT is_test),
      folds AS (SELECT DISTINCT fold AS k FROM t),
      eps AS (SELECT k, greatest({', '.join(f'var_pop({f})' for f in fs)}) * 1e-9 AS eps FROM t, folds WHERE fold <> k GROUP BY k),
      cls AS (SELECT k, label AS c, count(*) AS n, {stats} FROM t, folds WHERE fold <> k GROUP BY k, label),
      tot AS (SELECT k, sum(n) AS total FROM cls GROUP BY k),
      scores AS (SELECT o_orderkey, label, fold, c, ln(n / total) + {term} AS s FROM t JOIN cls ON cls.k = fold JOIN eps ON eps.k = fold JOIN tot ON tot.k = fold),
      pred AS (SELECT fold, label, c FROM scores QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s DESC, c) = 1)
      SELECT fold, round(avg((label = c)::INT), 6) AS score FROM pred GROUP BY fold"""


@query("m13_cross_validation", _cv_sql())
def _(spark, sf):
    ready = prepared_orders(spark, sf)
    return _rounded(crossval.cross_validate(ready.train, lambda part: bayes.fit_gaussian(part, ready.features), ORDER_KEY, 5))


@query("m14_interpretation", f"""WITH {S.PART_LINE}{_LINE_PRED}, m AS ({S.REGRESSION_METRICS})
  SELECT CASE WHEN r2_score > 0.7 THEN 'Good fit' WHEN r2_score > 0.4 THEN 'Moderate fit' ELSE 'Poor fit' END AS r2_band,
  CASE WHEN mape > 1 THEN 'N/A' WHEN mape <= 0.05 THEN 'Very Good' WHEN mape <= 0.1 THEN 'Good' WHEN mape <= 0.2 THEN 'Moderate' ELSE 'Weak' END AS mape_band,
  CASE WHEN rmse_mean <= 0.05 THEN 'Very Good' WHEN rmse_mean <= 0.1 THEN 'Good' WHEN rmse_mean <= 0.2 THEN 'Moderate' ELSE 'Weak' END AS rmse_mean_band FROM m""")
def _(spark, sf):
    ready = _part_line(spark, sf)
    return evaluation.interpret(evaluation.regression_metrics(linear.fit_linear(ready.train, ready.features).transform(ready.test)))


# --- linear models -----------------------------------------------------------------------


def _line_query(name: str, slope: str, fit) -> None:
    sql = f"WITH {S.PART_LINE}, w AS (SELECT {slope} AS w FROM g) SELECT p_partkey, label, round(my + w * (x - mx), 3) AS prediction FROM prep, g, w WHERE is_test"

    @query(name, sql)
    def _(spark, sf):
        ready = _part_line(spark, sf)
        pred = fit(ready.train, ready.features).transform(ready.test)
        return pred.select("p_partkey", "label", F.round("prediction", 3).alias("prediction"))


_line_query("l1_linear_regression", "cxy / vx", linear.fit_linear)
_line_query("l1_linear_regression_positive", "greatest(cxy / vx, 0)", lambda t, f: linear.fit_linear(t, f, positive=True))
_line_query("l2_ridge", "n * cxy / (n * vx + 10.0)", lambda t, f: linear.fit_ridge(t, f, alpha=10.0))
_line_query("l3_lasso", "sign(cxy) * greatest(abs(cxy) - 2.0, 0) / vx", lambda t, f: linear.fit_lasso(t, f, alpha=2.0))
_line_query("l4_elastic_net", "sign(cxy) * greatest(abs(cxy) - 1.5 * 0.4, 0) / (vx + 1.5 * 0.6)",
            lambda t, f: linear.fit_elastic_net(t, f, alpha=1.5, l1_ratio=0.4))


@query("l5_logistic_regression")
def _(spark, sf):
    ready = prepared_orders(spark, sf)
    return evaluation.classification_metrics(linear.fit_logistic(ready.train.persist(), ready.features).transform(ready.test))


@query("l5_logistic_regression_balanced")
def _(spark, sf):
    ready = prepared_orders(spark, sf)
    model = linear.fit_logistic(ready.train.persist(), ready.features, penalty="elasticnet", l1_ratio=0.5, class_weight="balanced")
    return evaluation.classification_metrics(model.transform(ready.test))


@query("m15_linear_summary", f"""WITH {S.PART_LINE}, w AS (SELECT sign(cxy) * greatest(abs(cxy) - 2.0, 0) / vx AS w FROM g)
  SELECT 'intercept' AS term, round(my - w * mx, 3) AS value FROM g, w UNION ALL SELECT 'n_nonzero', (w <> 0)::INT::DOUBLE FROM w
  UNION ALL SELECT 'p_size', round(w, 3) FROM w""")
def _(spark, sf):
    ready = _part_line(spark, sf)
    return _rounded(linear.fit_lasso(ready.train, ready.features, alpha=2.0).summary(spark), 3)


# --- naive Bayes -------------------------------------------------------------------------

_PRED_OUT = " SELECT o_orderkey, label, prediction FROM pred"


@query("l6_gaussian_nb", f"WITH {S.scaled('standard')}{S.gaussian()}{_PRED_OUT}")
def _(spark, sf):
    return _order_predictions(spark, sf)


@query("l7_multinomial_nb", f"WITH {S.scaled('minmax')}{S.multinomial()}{_PRED_OUT}")
def _(spark, sf):
    return _order_predictions(spark, sf, "minmax", bayes.fit_multinomial)


@query("l8_complement_nb", f"WITH {S.scaled('minmax')}{S.complement()}{_PRED_OUT}")
def _(spark, sf):
    return _order_predictions(spark, sf, "minmax", bayes.fit_complement)


@query("l9_bernoulli_nb", f"WITH {S.scaled('standard')}{S.bernoulli()}{_PRED_OUT}")
def _(spark, sf):
    return _order_predictions(spark, sf, "standard", bayes.fit_bernoulli)


@query("l10_categorical_nb", f"WITH {S.scaled('none')}{S.categorical()}{_PRED_OUT}")
def _(spark, sf):
    return _order_predictions(spark, sf, "none", bayes.fit_categorical, S.CATEGORY_FEATURES)


# --- nearest neighbours ------------------------------------------------------------------


def embedding_points(spark: SparkSession, sf: str) -> DataFrame:
    return vector_columns(table(spark, sf, "embeddings"), "embedding", 64)


EMBEDDING_FEATURES = [f"f{i}" for i in range(64)]
_VEC_SPLIT = """split AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY md5('42:' || vec_id)) <=
  ceil(0.2 * (SELECT count(*) FROM embeddings)) AS is_test FROM embeddings)"""


@query("l11_knn_classifier", f"""WITH {_VEC_SPLIT}, c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, is_test FROM split),
  d AS (SELECT a.vec_id, a.label, b.vec_id AS nb, b.label AS nl, sqrt(sum(power(a.x - b.x, 2))) AS d FROM c a JOIN c b ON a.i = b.i
    WHERE a.is_test AND NOT b.is_test GROUP BY ALL),
  k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), nb) <= 5),
  v AS (SELECT vec_id, label, nl, count(*) AS n FROM k GROUP BY ALL)
  SELECT vec_id, label::DOUBLE AS label, nl::DOUBLE AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, nl) = 1""")
def _(spark, sf):
    rows = embedding_points(spark, sf).withColumn("label", F.col("label").cast("double"))
    train, test = ranking.train_test_split(rows, ["vec_id"])
    model = neighbors.fit_neighbors(train, EMBEDDING_FEATURES, "vec_id", n_neighbors=5, metric="euclidean")
    return model.transform(test).select("vec_id", "label", "prediction")


@query("l11_knn_regressor", f"""WITH {_PART_SPLIT}, d AS (SELECT a.p_partkey, a.p_retailprice AS label, b.p_partkey AS nb, b.p_retailprice AS nl,
    abs(a.p_size - b.p_size) + abs(length(a.p_name) - length(b.p_name)) AS d FROM split a, split b WHERE a.is_test AND NOT b.is_test),
  k AS (SELECT *, bool_or(d = 0) OVER (PARTITION BY p_partkey) AS touch FROM
    (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, nb) <= 7))
  SELECT p_partkey, label, round(sum(CASE WHEN touch THEN (d = 0)::INT ELSE 1.0 / d END * nl)
    / sum(CASE WHEN touch THEN (d = 0)::INT ELSE 1.0 / d END), 6) AS prediction FROM k GROUP BY p_partkey, label""")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size", F.length("p_name").alias("name_length"), F.col("p_retailprice").alias("label"))
    train, test = ranking.train_test_split(parts, ["p_partkey"])
    model = neighbors.fit_neighbors(train, ["p_size", "name_length"], "p_partkey", n_neighbors=7, weights="distance",
                                    metric="manhattan", classification=False)
    return _rounded(model.transform(test).select("p_partkey", "label", "prediction"), 6, "label")


