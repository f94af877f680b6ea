"""Edits, browsing, quality, quantiles and CSV on small frames."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts, edits, profiling, quality, quantiles, ranking, rowid
from tablewright.operators.groups import join_groups
from tablewright.session import scratch_path
from tablewright.sources import delimited


@pytest.fixture
def cells(spark):
    rows = [(0, "red", 1.0, 5), (1, "red", None, 5), (2, None, 3.0, 6), (3, "red", 1.0, 5), (4, "blue", 2.0, 7)]
    return spark.createDataFrame(rows, "_row_id bigint, color string, x double, k bigint")


def column(df, name):
    return [r[name] for r in df.orderBy("_row_id").collect()]


def test_row_ids_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    for parts in (1, 8):
        numbered = rowid.add_row_id(df.repartition(parts), ["v"], partitions=parts)
        assert numbered.filter("_row_id <> v").count() == 0


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000)
    train, test = ranking.train_test_split(df, ["id"], 0.2)
    assert (train.count(), test.count()) == (800, 200)
    again = ranking.train_test_split(df.repartition(3), ["id"], 0.2)[1]
    assert test.exceptAll(again).isEmpty()
    six = ranking.train_test_split(spark.range(6), ["id"], 0.33)
    assert (six[0].count(), six[1].count()) == (4, 2)


def test_rank_selection_refines(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_FETCH", 1)
    hashed = spark.range(3000).withColumn("h", ranking.row_hash(1, "id"))
    total, cuts = ranking.hash_cutoffs(hashed, "h", lambda n: [0, 17, 1500, n - 1])
    order = sorted(r["h"] for r in hashed.collect())
    assert total == 3000 and cuts == {r: order[r] for r in (0, 17, 1500, 2999)}


def test_edits(cells):
    assert column(edits.drop_rows(cells, [1, 99]), "_row_id") == [0, 2, 3, 4]
    assert column(edits.drop_duplicates(cells), "_row_id") == [0, 1, 2, 3]
    assert column(edits.drop_missing_rows(cells, reset=False), "_row_id") == [0, 3, 4]
    assert column(edits.update_cell(cells, 2, "x", "9"), "x") == [1.0, None, 9.0, 1.0, 2.0]
    assert column(edits.update_cell(cells, 2, "x", "big"), "x") == ["1.0", None, "big", "1.0", "2.0"]
    assert column(edits.replace_values(cells, "color", {"red": "pink", "nan": "grey"}), "color") == ["pink", "pink", "grey", "pink", "blue"]
    assert column(edits.regex_replace(cells, "color", "(r)(e)", r"\2\1"), "color") == ["erd", "erd", None, "erd", "blue"]
    assert column(edits.regex_replace(cells, "color", "n", "m", null_as="nan"), "color")[2] == "mam"
    assert column(edits.fill_mean(cells, ["x"]), "x")[1] == pytest.approx(1.75)
    assert edits.rename_column(cells, "x", "  ").columns == cells.columns
    with pytest.raises(ValueError):
        edits.drop_column(cells.select("_row_id", "x"), "x")


def test_lossy_conversion_fails(cells):
    assert column(edits.convert_dtype(cells, "x", "Int64"), "x") == [1, None, 3, 1, 2]
    halves = cells.withColumn("x", F.col("x") / 2)
    with pytest.raises(Exception, match="fractions"):
        edits.convert_dtype(halves, "x", "Int64").collect()
    assert edits.conversion_failures(halves, "x", "Int64").first()["failures"] == 3
    with pytest.raises(ValueError):
        edits.convert_dtype(cells, "x", "complex128")


def test_paging(spark):
    df = rowid.add_row_id(spark.range(25), ["id"])
    assert rowid.page(df, 99).count() == 5 and rowid.page(df, -3).first()["_row_id"] == 0
    assert rowid.filter_positions(df, "20-90").count() == 5
    for bad in ("9-3", "30", "a", "1-2-3", "-4"):
        with pytest.raises(ValueError):
            rowid.filter_positions(df, bad)


def test_quality_gate(spark, cells):
    with pytest.raises(quality.DataQualityError, match="color, x"):
        quality.require_quality(cells)
    with pytest.raises(quality.DataQualityError, match="empty"):
        quality.require_quality(cells.filter("false"))
    quality.require_quality(cells.na.drop())


def test_missing_counts_as_a_value(cells):
    facts = {r["variable"]: r for r in quality.describe_columns(cells).collect()}
    assert (facts["color"]["n_unique"], facts["color"]["n_missing"]) == (3, 1)
    assert {r["column"]: r["n_distinct"] for r in quality.distinct_counts(cells, ["color", "x"]).collect()} == {"color": 2, "x": 3}
    assert [r["value"] for r in quality.unique_values(cells, "color").collect()] == ["red", None, "blue"]
    assert quality.value_counts(cells, "color").first().asDict() == {"value": "red", "n": 3}


def test_duplicates_and_hot_groups(spark, cells):
    assert column(quality.duplicate_rows(cells.drop("_row_id").withColumn("_row_id", F.lit(1))), "color") == ["red", "red"]
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert join_groups(rows, groups, ["k"], "n", 5000).count() == 5000


@pytest.mark.parametrize("limit", [10**6, 120])
def test_quantiles_by_bracketing(spark, limit):
    import numpy as np

    df = spark.range(6000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.col("id") % 997, F.lit(1.5))).alias("v"))
    got = quantiles.exact_quantiles(df, ["v"], [0.1, 0.5, 0.9], ["g"], direct_limit=limit)
    rows = df.toPandas()
    for r in got.collect():
        want = np.quantile(rows.v[rows.g == r["g"]], [0.1, 0.5, 0.9])
        assert [r["v_q0"], r["v_q1"], r["v_q2"]] == pytest.approx(list(want))


def test_csv_round_trip(spark):
    folder = scratch_path(spark, "csv")
    spark.createDataFrame([("id,name,score,ok",), ('1,"a, ""b""",1.5,True',), ("2,NA,nan,False",), ("3,c,,True",)], "value string").coalesce(1).write.text(folder)
    df = delimited.read_csv(spark, folder)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'a, "b"', 1.5, True), (2, None, None, False), (3, "c", None, True)]
    back = delimited.read_csv(spark, delimited.export_csv(rowid.add_row_id(df, ["id"]), scratch_path(spark, "out"), "t"))
    assert back.columns[0] == "_row_id" and back.drop("_row_id").exceptAll(df).isEmpty()


def test_charts(spark, cells):
    bins = charts.histogram(spark.range(100).withColumn("v", F.col("id").cast("double")), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [25, 25, 25, 25]
    assert [tuple(r) for r in charts.bar(cells, "color", "x", "sum").collect()] == [("blue", 2.0), ("red", 2.0)]
    box = charts.box_stats(spark.range(11).selectExpr("CASE WHEN id = 10 THEN 100.0D ELSE CAST(id AS DOUBLE) END AS v"), "v").first()
    assert (box["median"], box["n_outliers"], box["whisker_high"]) == (5.0, 1, 9.0)
    with pytest.raises(ValueError):
        charts.correlation_matrix(cells, ["x"])


def test_profile(cells):
    found = profiling.profile(cells)
    assert found.duplicates.first()["n_surplus"] == 1
    assert {r["column"] for r in found.alerts.collect() if r["alert"] == "missing"} == {"color", "x"}
    assert found.correlations.count() == 4
