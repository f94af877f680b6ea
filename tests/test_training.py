"""Training by name, column stages, encoders past their old limits, text replacement in Python's dialect, number texts."""

import re

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablewright.operators import bayes, edits, encoding, modes, prepare, quality, training, trees
from tablewright.sources import delimited


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(i % 7), "abc"[i % 3], float(3 * (i % 7) + i % 3)) for i in range(120)], "id bigint, x double, c string, y double")


def test_every_name_resolves():
    names = training.model_names()
    assert len(names) == len(set(names)) == 34
    for kind in ("classification", "regression", "clustering"):
        for name in training.model_names(kind):
            assert callable(training.resolve(name, kind))
    for name, kind in (("ridge", "classification"), ("kmeans", "regression"), ("none", "clustering")):
        with pytest.raises(ValueError):
            training.resolve(name, kind)


def test_train_and_evaluate(rows):
    done = training.train_and_evaluate(rows, "y", "linear_regression", "regression", ["id"], encoder="onehot", folds=3)
    assert done.metrics.first()["r2_score"] > 0.999 and done.folds.count() == 3
    assert training.train_and_evaluate(rows, "c", "decision_tree", "classification", ["id"], max_depth=3).predictions.count() == 24


def test_gates_stop_before_training(rows):
    with pytest.raises(quality.DataQualityError):
        training.train_and_evaluate(rows.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), "y", "ridge", "regression", ["id"])
    with pytest.raises(ValueError, match="continuous"):
        training.train_and_evaluate(rows.withColumn("t", F.col("id") / 3), "t", "knn", "classification", ["id"])


def test_cluster_by_name(rows):
    labelled, ready = training.cluster(rows.select("id", "x", "y"), "hierarchical", ["id"], n_clusters=3)
    assert labelled.count() == 120 and labelled.select("cluster").distinct().count() == 3


@pytest.mark.parametrize("scale", ["standard", True, "minmax", None, False])
def test_column_stages_scale(rows, scale):
    fitted = Pipeline(stages=prepare.column_stages([], ["x", "y"], scale)).fit(rows)
    got = np.array([r[0] for r in fitted.transform(rows).orderBy("id").select(vector_to_array("features")).collect()])
    raw = np.array([(r.x, r.y) for r in rows.orderBy("id").collect()])
    if scale in ("standard", True):
        raw = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    elif scale == "minmax":
        raw = (raw - raw.min(axis=0)) / (raw.max(axis=0) - raw.min(axis=0))
    assert np.allclose(got, raw)


def test_fitted_stages_are_saved_and_loaded(rows, tmp_path):
    pipeline = prepare.full_stages([], ["x"], LinearRegression(featuresCol="features", labelCol="y"))
    fitted = pipeline.fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    want = fitted.transform(rows).select("id", "prediction").orderBy("id").collect()
    assert PipelineModel.load(str(tmp_path / "model")).transform(rows).select("id", "prediction").orderBy("id").collect() == want
    assert Pipeline.load(str(tmp_path / "pipeline")).fit(rows).transform(rows).select("id", "prediction").orderBy("id").collect() == want


@pytest.mark.parametrize("pattern, replacement", [
    ("(b)", r"<\1>"), ("(?P<q>b)", r"[\g<q>]"), ("(?P<a_1>a)(b)", r"\g<2>\g<a_1>"), ("(b)", r"\g<1>0"), ("b", "$1"), ("b", r"\\x"), ("b", r"\n"),
    (r"(?P<c>[ab])(?P=c)", r"\g<c>"), (r"\(b\)", "B"), ("(a)(b)", r"\2$\1"),
])
def test_replacement_is_that_of_python(spark, pattern, replacement):
    texts = ["abc", "aabb b", "(b) a$b", "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.t for r in edits.regex_replace(df, "t", pattern, replacement).orderBy("i").collect()]
    assert got == [re.sub(pattern, replacement, t) for t in texts]


def test_texts_with_suffixes_are_no_numbers(spark, tmp_path):
    texts = ["5d", "7f", "5", " 6.5 ", "1e3", "0x1p3", ".5", "5.", "inf", "", "1 2", "-3", "+.5e-2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.n for r in df.select("t", edits.to_number("t").alias("n")).collect()}
    assert {t for t, n in got.items() if n is None} == {"5d", "7f", "0x1p3", "", "1 2"}
    assert got["1e3"] == 1000.0 and got[" 6.5 "] == 6.5
    df.filter("t IN ('5d', '7f')").write.option("header", True).csv(str(tmp_path / "codes"))
    assert {r.t for r in delimited.read_csv(spark, str(tmp_path / "codes")).collect()} == {"5d", "7f"}
    assert edits.conversion_failures(df, "t", "Float64").first()["failures"] == 5


def test_feature_shares():
    share = trees.feature_share
    assert [share(m, 16) for m in ("sqrt", "log2", None, 4, 0.5)] == [0.25, 0.25, 1.0, 0.25, 0.5] and share("log2", 1) == 1.0
    for bad in (0, 17, 1.5, "half"):
        with pytest.raises(ValueError):
            share(bad, 16)


def test_trees_refuse_what_spark_cannot_grow(rows):
    with pytest.raises(ValueError):
        trees.fit_tree(rows, ["x"], "y", classification=False, max_depth=31)
    with pytest.raises(ValueError):
        trees.fit_tree(rows, ["x"], "y", classification=False, min_samples_split=9)


def test_extra_trees_grow_until_pure(rows):
    model = trees.fit_extra_trees(rows, ["x"], ["id"], "x", classification=False, n_estimators=2, max_depth=None)
    assert model.transform(rows).filter(F.abs(F.col("prediction") - F.col("x")) > 1e-9).count() == 0


def test_unseen_values_are_all_reported(spark):
    seen = spark.createDataFrame([("a",)], "c string")
    new = spark.range(1500).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    with pytest.raises(encoding.EncodingError) as found:
        encoding.encode_codes(new, encoding.fit_codes(seen, ["c"]), ["c"])
    error = found.value
    assert error.total == 1500 and error.values.count() == 1500 and len(error.unseen) == 1000 and error.expected == ["a"]


def test_one_hot_vector_past_the_column_limit(spark):
    many = spark.range(10_050).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    mapping = encoding.fit_codes(many, ["c"])
    with pytest.raises(ValueError, match="encode_one_hot_vector"):
        encoding.encode_one_hot(many, mapping, ["c"])
    new = many.limit(20).unionByName(spark.createDataFrame([(-1, "unknown")], many.schema))
    sizes = [(r.id, r.c.size, r.c.numNonzeros()) for r in encoding.encode_one_hot_vector(new, mapping, ["c"]).collect()]
    assert all(size == 10_050 and ones == (0 if i == -1 else 1) for i, size, ones in sizes)


def test_every_row_has_an_exemplar(blobs):
    got = modes.fit_affinity_propagation(blobs, ["x", "y"], "id", n_neighbors=4, max_iter=30)
    assert got.filter("cluster = -1 OR exemplar IS NULL").count() == 0 and got.count() == blobs.count()


def test_categorical_counts_stay_a_table(spark):
    """A hot category, a category only one class shows, and a code that training never saw."""
    rows = [(float(i % 2), 0.0 if i % 10 else 1.0 + i % 3, float(i % 4)) for i in range(400)] + [(1.0, 9.0, 0.0)]
    train = spark.createDataFrame(rows, "label double, a double, b double")
    model = bayes.fit_categorical(train, ["a", "b"])
    got = model.transform_scores(spark.createDataFrame([(9.0, 0.0), (5.0, 3.0)], "a double, b double")).collect()

    def score(c, codes):
        own = [r for r in rows if r[0] == c]
        out = np.log(len(own) / len(rows))
        for i, (code, width) in enumerate(zip(codes, (10, 4))):
            out += np.log((sum(r[1 + i] == code for r in own) + 1) / (len(own) + width))
        return out

    for r in got:
        assert np.allclose([r.score_0, r.score_1], [score(0.0, (r.a, r.b)), score(1.0, (r.a, r.b))])
    assert model.transform(train).count() == len(rows)
    with pytest.raises(Exception, match="unseen in training"):
        model.transform(spark.createDataFrame([(10.0, 0.0)], "a double, b double")).collect()
