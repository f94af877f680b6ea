"""Trees, boosting, gradient-trained models, and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import bayes, boosting, gradient, hierarchy, kmeans, prepare, scaling, scoring, trees
from tablewright.plans import model_sql as S
from tablewright.plans.cluster_queries import CUSTOMER_FEATURES, customer_points
from tablewright.plans.model_queries import ORDER_KEY, orders_with_customers
from tablewright.plans.registry import query, table
from tablewright.session import scratch_path
from tablewright.streaming import online



def _labelled_documents(spark, sf):
    """Text quality from counts of a document's characters, its language and its source."""
    share = {"upper": "[A-Z]", "marks": "[#*$%&|<>!]", "ends": "[.]"}
    documents = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source", *[
        (F.regexp_count("text", F.lit(rule)) / F.greatest(F.length("text"), F.lit(1))).alias(name) for name, rule in share.items()])
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return prepare.prepare_supervised(documents.join(labels, "doc_id"), "quality", ["doc_id"])


def _parts(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return prepare.prepare_supervised(parts, "p_retailprice", ["p_partkey"], encoder="target", classification=False)


def _class_query(name, fit):
    @query(name)
    def _(spark, sf):
        ready = _labelled_documents(spark, sf)
        return fit(ready.train.persist(), ready.features).transform(ready.test).select("doc_id", "label", "prediction")


def _value_query(name, fit):
    @query(name)
    def _(spark, sf):
        ready = _parts(spark, sf)
        return fit(ready.train.persist(), ready.features).transform(ready.test).select("p_partkey", "label", "prediction")


DOC, PART = ["doc_id"], ["p_partkey"]


# one split of a regression stump: the exact best threshold over the distinct sizes, by least squares
@query("l12_regression_stump", """WITH t AS (SELECT p_size AS x, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY p_size),
  c AS (SELECT x, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER () AS an, sum(s) OVER () AS total FROM t WINDOW w AS (ORDER BY x)),
  b AS (SELECT *, ls * ls / ln + (total - ls) * (total - ls) / (an - ln) AS score FROM c WHERE an > ln ORDER BY score DESC, x LIMIT 1)
  SELECT p_partkey, round(CASE WHEN p_size <= b.x THEN ls / ln ELSE (total - ls) / (an - ln) END, 4) AS prediction FROM part, b""")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("label"))
    # edges at every distinct size, so no candidate is missed
    edges = {"p_size": [float(r[0]) for r in parts.select("p_size").distinct().orderBy("p_size").collect()]}
    binned = trees.with_bins(parts, ["p_size"], edges)
    stump = trees.grow(binned, ["p_size"], edges, [(-F.col("label"), F.lit(1.0))], trees.Growth(max_depth=1))[0]
    return parts.select("p_partkey", F.round(stump.expression(), 4).alias("prediction"))


_class_query("l12_decision_tree_classifier", lambda t, f: trees.fit_tree(t, f, criterion="entropy"))
_value_query("l12_decision_tree_regressor", lambda t, f: trees.fit_tree(t, f, classification=False))
_class_query("l13_random_forest_classifier", lambda t, f: trees.fit_forest(t, f))
_value_query("l13_random_forest_regressor", lambda t, f: trees.fit_forest(t, f, classification=False, max_features="all"))
_class_query("l14_extra_trees_classifier", lambda t, f: trees.fit_extra_trees(t, f, DOC))
_value_query("l14_extra_trees_regressor", lambda t, f: trees.fit_extra_trees(t, f, PART, classification=False))
_class_query("l15_gradient_boosting_classifier", lambda t, f: boosting.fit_gradient_boosting(t, f, DOC))
_value_query("l15_gradient_boosting_regressor", lambda t, f: boosting.fit_gradient_boosting(t, f, PART, classification=False, loss="huber", n_estimators=4))
_class_query("l16_adaboost_classifier", lambda t, f: boosting.fit_adaboost(t, f, n_estimators=6))
_value_query("l16_adaboost_regressor", lambda t, f: boosting.fit_adaboost(t, f, classification=False, n_estimators=5))
_class_query("l17_boosted_trees_classifier", lambda t, f: boosting.fit_boosted(t, f, DOC, preset="xgboost"))
_value_query("l17_boosted_trees_regressor", lambda t, f: boosting.fit_boosted(
    t, f, PART, classification=False, preset="lightgbm", subsample=0.8, colsample_bytree=0.8))
_class_query("l18_svm_classifier", lambda t, f: gradient.fit_svm(t, f, DOC, kernel="rbf"))
_class_query("l18_svm_polynomial", lambda t, f: gradient.fit_svm(t, f, DOC, kernel="poly", coef0=1.0))
_value_query("l18_svm_regressor", lambda t, f: gradient.fit_svm(t, f, PART, classification=False, kernel="linear"))
_class_query("l19_sgd_classifier", lambda t, f: gradient.fit_sgd(t, f, DOC, loss="log_loss"))
_value_query("l19_sgd_regressor", lambda t, f: gradient.fit_sgd(t, f, PART, classification=False, penalty="elasticnet"))
_class_query("l20_mlp_classifier", lambda t, f: gradient.fit_mlp(t, f, DOC, max_iter=50))
_value_query("l20_mlp_regressor", lambda t, f: gradient.fit_mlp(t, f, PART, classification=False, activation="tanh"))


# the first boosting round in closed form: a stump on the residuals of the mean
@query("l17_boosted_one_round", """WITH m AS (SELECT avg(p_retailprice) AS m FROM part),
  t AS (SELECT p_size AS x, count(*) AS n, sum(p_retailprice - m) AS s FROM part, m GROUP BY p_size),
  c AS (SELECT x, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER () AS an, sum(s) OVER () AS total FROM t WINDOW w AS (ORDER BY x)),
  b AS (SELECT *, ls * ls / (ln + 1) + (total - ls) * (total - ls) / (an - ln + 1) AS score FROM c WHERE an > ln ORDER BY score DESC, x LIMIT 1)
  SELECT p_partkey, round(m + 0.3 * CASE WHEN p_size <= b.x THEN ls / (ln + 1) ELSE (total - ls) / (an - ln + 1) END, 4) AS prediction FROM part, b, m""")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("label"))
    mean = parts.agg(F.avg("label")).first()[0]
    edges = {"p_size": [float(r[0]) for r in parts.select("p_size").distinct().orderBy("p_size").collect()]}
    binned = trees.with_bins(parts, ["p_size"], edges)
    stump = trees.grow(binned, ["p_size"], edges, [(F.lit(mean) - F.col("label"), F.lit(1.0))], trees.Growth(max_depth=1, reg_lambda=1.0))[0]
    model = boosting.BoostedModel(["p_size"], [mean], [[stump]], 0.3, None)
    return model.transform(parts).select("p_partkey", F.round("prediction", 4).alias("prediction"))


@query("m12_feature_importance")
def _(spark, sf):
    ready = _labelled_documents(spark, sf)
    return trees.feature_importance(trees.fit_forest(ready.train.persist(), ready.features), spark)


# --- scoring -----------------------------------------------------------------------------


def _scorer(spark, sf):
    rows = orders_with_customers(spark, sf)
    return scoring.fit_for_scoring(rows, "o_orderstatus", bayes.fit_gaussian, ORDER_KEY), rows.drop("o_orderstatus")


_ALL_ROWS = S.scaled("standard").replace("<= ceil(0.2 * (SELECT count(*) FROM src)) AS is_test", "<= 0 AS is_test") + S.gaussian().replace(
    "WHERE is_test", "")
_SCORE_SQL = f"WITH {_ALL_ROWS} SELECT o_orderkey, prediction FROM pred"


@query("x1_score_batch", _SCORE_SQL)
def _(spark, sf):
    score, rows = _scorer(spark, sf)
    return score(rows).select("o_orderkey", "prediction")


@query("x2_refit_with_new_rows")
def _(spark, sf):
    # suppliers join the customers, scaled as these are
    rows = table(spark, sf, "customer").select("c_custkey", *CUSTOMER_FEATURES)
    points = customer_points(spark, sf)
    suppliers = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 10**9).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    fresh = scaling.fit_scaler(rows, CUSTOMER_FEATURES, "standard").transform(suppliers).select("c_custkey", *CUSTOMER_FEATURES)
    return scoring.refit_with(points, fresh, lambda both: hierarchy.fit_single_linkage(both, CUSTOMER_FEATURES, "c_custkey", distance_threshold=0.1), "c_custkey")


@query("x3_score_stream", _SCORE_SQL)
def _(spark, sf):
    score, rows = _scorer(spark, sf)
    folder = scratch_path(spark, "orders-stream")
    rows.repartition(4).write.parquet(folder)
    stream = online.read_stream(spark, folder, rows, files_per_batch=2)
    return online.score_available(spark, stream, lambda df: score(df).select("o_orderkey", "prediction"))


@query("c2_minibatch_kmeans_stream")
def _(spark, sf):
    points = customer_points(spark, sf)
    folder = scratch_path(spark, "points-stream")
    points.repartition(4, "c_custkey").write.parquet(folder)
    start = kmeans.CenterModel(CUSTOMER_FEATURES, [[-1.0, -1.0], [0.0, 0.5], [1.0, -0.5]])
    model = online.update_on_stream(online.read_stream(spark, folder, points, 1), start, scratch_path(spark, "points-progress"))
    return model.transform(points).select("c_custkey", "cluster")


@query("x4_input_constraints", """WITH v AS (SELECT 'p_name' AS "column", 'category' AS kind, p_name AS value FROM part UNION SELECT 'p_brand', 'category', p_brand FROM part
    UNION SELECT 'p_type', 'category', p_type FROM part UNION SELECT 'p_size', 'number', p_size::VARCHAR FROM part UNION SELECT 'p_retailprice', 'number', p_retailprice::VARCHAR FROM part),
  n AS (SELECT "column", kind, count(*) AS n_values FROM v GROUP BY ALL)
  SELECT "column", kind, n_values, value FROM v JOIN n USING ("column", kind) WHERE kind = 'category' OR n_values <= 20
  UNION ALL SELECT "column", kind, n_values, NULL FROM n WHERE kind = 'number' AND n_values > 20""")
def _(spark, sf):
    return scoring.input_constraints(table(spark, sf, "part"), exclude=["p_partkey"])


@query("x4_violations", """SELECT 'o_orderpriority' AS "column", upper(o_orderpriority) || '!' AS value, count(*) AS n FROM orders
  WHERE o_orderstatus = 'P' GROUP BY o_orderpriority""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    strange = orders.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "P", F.concat(F.upper("o_orderpriority"), F.lit("!")))
                                .otherwise(F.col("o_orderpriority")))
    return scoring.violations(strange, scoring.input_constraints(orders), ["o_orderpriority", "o_orderstatus", "o_totalprice"])
