"""Reading, editing, browsing, profiling and charting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import charts, edits, profiling, quality, ranking, rowid
from tablewright.plans.registry import query, table
from tablewright.session import scratch_path
from tablewright.sources import delimited

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_KEY_SQL = ", ".join(LINE_KEY)
# the rows numbered in key order, with some discounts missing
_BASE = f"""base AS (SELECT row_number() OVER (ORDER BY {_KEY_SQL}) - 1 AS _row_id, l_orderkey, l_linenumber,
  l_quantity, l_extendedprice, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS l_discount,
  l_returnflag, l_linestatus FROM lineitem)"""
_NUMBERED = f"numbered AS (SELECT row_number() OVER (ORDER BY {_KEY_SQL}) - 1 AS _row_id, * FROM lineitem)"
# a narrow table with many equal rows
_DUPES = f"""dupes AS (SELECT row_number() OVER (ORDER BY {_KEY_SQL}) - 1 AS _row_id, l_quantity, l_discount,
  l_returnflag, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax FROM lineitem)"""


def _gappy():
    return F.when(F.col("l_linenumber") != 3, F.col("l_discount"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return rowid.add_row_id(rows, LINE_KEY).withColumn("l_discount", _gappy()).drop("l_partkey", "l_suppkey")


def _unnumbered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", _gappy().alias("l_discount"),
        "l_returnflag", "l_linestatus")


def _dupes(spark: SparkSession, sf: str) -> DataFrame:
    rows = rowid.add_row_id(table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", "l_returnflag", "l_tax"), LINE_KEY)
    return rows.select("_row_id", "l_quantity", "l_discount", "l_returnflag",
                       F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"))


def _plain_dupes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"))


# --- sources and sinks -------------------------------------------------------------------


@query("s1_read_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, "
       "CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part")
def _(spark, sf):
    folder = scratch_path(spark, "parts-csv")
    priced = table(spark, sf, "part").withColumn(
        "p_retailprice", F.when(F.col("p_size") > 40, F.lit("NaN")).otherwise(F.col("p_retailprice").cast("string")))
    priced.write.option("header", True).csv(folder)
    return delimited.read_csv(spark, folder)


@query("s1_read_csv_codes", "SELECT p_partkey, p_size || 'd' AS code, p_size::DOUBLE / 2 AS half FROM part")
def _(spark, sf):
    """Texts such as ``5d`` stay texts."""
    folder = scratch_path(spark, "codes-csv")
    table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("d")).alias("code"), (F.col("p_size") / 2).alias("half")).write.option(
        "header", True).csv(folder)
    return delimited.read_csv(spark, folder)


@query("s1_read_parquet", "SELECT * FROM events")
def _(spark, sf):
    return delimited.read_parquet(spark, f"{sf}/events.parquet")


@query("s2_export_csv", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _row_id, c_custkey, c_name, "
       "c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    customers = rowid.add_row_id(table(spark, sf, "customer"), ["c_custkey"])
    return delimited.read_csv(spark, delimited.export_csv(customers, scratch_path(spark, "export"), "customer"))


@query("s3_row_id", f"WITH {_NUMBERED} SELECT _row_id, {_KEY_SQL} FROM numbered")
def _(spark, sf):
    return rowid.add_row_id(table(spark, sf, "lineitem").select(*LINE_KEY), LINE_KEY).select("_row_id", *LINE_KEY)


@query("s4_sample_row", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders "
       "ORDER BY md5('42:' || o_orderkey) LIMIT 1")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return ranking.sample_rows(orders, ["o_orderkey"], 1, seed=42)


# --- edits -------------------------------------------------------------------------------


@query("e1_drop_column", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    return edits.drop_column(table(spark, sf, "supplier"), "s_name")


@query("e2_rename_column", "SELECT p_partkey, p_brand, p_size, p_retailprice AS price FROM part")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return edits.rename_column(parts, "p_retailprice", "  price ")


@query("e3_drop_row", f"WITH {_BASE} SELECT * FROM base WHERE _row_id NOT IN (7, 100, 5000)")
def _(spark, sf):
    return edits.drop_rows(edits.drop_rows(_base(spark, sf), 7), [100, 5000, 10**15])


@query("e3_drop_rows_by_table", f"WITH {_BASE} SELECT * FROM base WHERE l_orderkey NOT IN "
       "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, sf):
    base = _base(spark, sf)
    pending = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return edits.drop_rows(base, base.join(pending, "l_orderkey", "left_semi"))


@query("e4_update_cell", f"""WITH {_BASE} SELECT _row_id, l_orderkey, l_linenumber,
  CASE WHEN _row_id = 3 THEN 12.5 ELSE l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN _row_id = 9 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN _row_id = 11 THEN 'Z' ELSE l_returnflag END AS l_returnflag, l_linestatus FROM base""")
def _(spark, sf):
    one = edits.update_cell(_base(spark, sf), 3, "l_quantity", "12.5")
    return edits.update_cell(edits.update_cell(one, 9, "l_discount", "nan"), 11, "l_returnflag", "Z")


@query("e4_bulk_cell_edits", f"""WITH {_BASE} SELECT _row_id, l_orderkey,
  CASE WHEN l_quantity = 50 THEN CASE WHEN l_returnflag = 'N' THEN NULL ELSE 0.0 END ELSE l_discount END AS l_discount
  FROM base""")
def _(spark, sf):
    base = _base(spark, sf)
    patch = base.filter("l_quantity = 50").select("_row_id", F.when(F.col("l_returnflag") != "N", 0.0).alias("value"))
    return edits.apply_cell_edits(base, patch, "l_discount").select("_row_id", "l_orderkey", "l_discount")


@query("e5_replace_exact", """SELECT l_orderkey, l_linenumber, l_extendedprice, l_linestatus,
  CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN NULL ELSE l_returnflag END AS l_returnflag,
  CASE WHEN l_linenumber = 3 THEN 0.5 ELSE l_discount END AS l_discount,
  CASE WHEN l_quantity = 1 THEN 100.0 ELSE l_quantity END AS l_quantity FROM lineitem""")
def _(spark, sf):
    step = edits.replace_values(_unnumbered(spark, sf), "l_returnflag", {"A": "accepted", "R": "nan"})
    return edits.replace_values(edits.replace_values(step, "l_discount", {"nan": 0.5}), "l_quantity", {1.0: 100.0})


@query("e6_regex_replace", "SELECT doc_id, lang, regexp_replace(text, '([aeiou])([rst])', '\\2\\1', 'g') AS text FROM documents")
def _(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return edits.regex_replace(documents, "text", "([aeiou])([rst])", r"\2\1")


@query("e6_regex_replace_delimiters", "SELECT doc_id, regexp_replace(text, '([aeiou])([rst])', '<\\1>$|\\2', 'g') AS text FROM documents")
def _(spark, sf):
    """Named groups, and references next to brackets and dollars."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return edits.regex_replace(documents, "text", "(?P<vowel_1>[aeiou])([rst])", r"<\g<vowel_1>>$|\g<2>")


@query("e7_convert_dtype", """SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber,
  l_quantity::BIGINT AS l_quantity, (l_discount <> 0) AS has_discount FROM lineitem""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_discount").alias("has_discount"))
    for column, dtype in (("l_orderkey", "string"), ("l_linenumber", "Float64"), ("l_quantity", "Int64"), ("has_discount", "bool")):
        rows = edits.convert_dtype(rows, column, dtype)
    return rows


@query("e7_conversion_failures", "SELECT 'code' AS \"column\", 'Int64' AS dtype, "
       "count(*) FILTER (WHERE TRY_CAST(replace(p_brand, 'Brand#1', '') AS BIGINT) IS NULL) AS failures FROM part")
def _(spark, sf):
    codes = table(spark, sf, "part").select(F.replace("p_brand", F.lit("Brand#1"), F.lit("")).alias("code"))
    return edits.conversion_failures(codes, "code", "Int64")


@query("e8_drop_duplicates", f"""WITH {_DUPES}, firsts AS (SELECT min(_row_id) AS f, l_quantity, l_discount, l_returnflag, l_tax
  FROM dupes GROUP BY ALL) SELECT row_number() OVER (ORDER BY f) - 1 AS _row_id, l_quantity, l_discount, l_returnflag, l_tax FROM firsts""")
def _(spark, sf):
    return edits.drop_duplicates(_dupes(spark, sf))


@query("e9_drop_missing_rows", f"""WITH {_BASE} SELECT * REPLACE (row_number() OVER (ORDER BY _row_id) - 1 AS _row_id)
  FROM base WHERE l_discount IS NOT NULL""")
def _(spark, sf):
    return edits.drop_missing_rows(_base(spark, sf))


@query("e10_fill_mean", """WITH g AS (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS d FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(coalesce(d, (SELECT avg(d) FROM g)), 8) AS l_discount FROM g""")
def _(spark, sf):
    filled = edits.fill_mean(_unnumbered(spark, sf).select("l_orderkey", "l_linenumber", "l_discount"), ["l_discount"])
    return filled.withColumn("l_discount", F.round("l_discount", 8))


@query("e11_custom_operation", """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
  FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag HAVING count(*) > 1""")
def _(spark, sf):
    busy = edits.apply_function(table(spark, sf, "lineitem"), lambda df: df.filter("l_quantity > 10"))
    return edits.apply_sql(busy, "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue "
                                 "FROM {df} GROUP BY l_returnflag HAVING count(*) > 1")


@query("e12_is_number", """SELECT p_partkey, TRY_CAST(right(p_brand, 2) AS DOUBLE) AS number,
  TRY_CAST(right(p_brand, 2) AS DOUBLE) IS NOT NULL AS is_number FROM part""")
def _(spark, sf):
    tail = F.substring("p_brand", -2, 2)
    return table(spark, sf, "part").select("p_partkey", edits.to_number(tail).alias("number"), edits.is_number(tail).alias("is_number"))


@query("e12_is_number_suffix", """SELECT doc_id, TRY_CAST(code AS DOUBLE) AS number, TRY_CAST(code AS DOUBLE) IS NOT NULL AS is_number FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars || 'd' WHEN 1 THEN n_chars || 'f' WHEN 2 THEN n_chars || 'e1' ELSE ' ' || n_chars || '.5' END AS code FROM documents)""")
def _(spark, sf):
    turn, chars = F.pmod("doc_id", F.lit(4)), F.col("n_chars").cast("string")
    code = F.when(turn == 0, F.concat(chars, F.lit("d"))).when(turn == 1, F.concat(chars, F.lit("f"))).when(
        turn == 2, F.concat(chars, F.lit("e1"))).otherwise(F.concat(F.lit(" "), chars, F.lit(".5")))
    return table(spark, sf, "documents").select("doc_id", edits.to_number(code).alias("number"), edits.is_number(code).alias("is_number"))


# --- browse and quality ------------------------------------------------------------------


@query("q1_shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def _(spark, sf):
    return quality.shape(table(spark, sf, "lineitem"))


def _describe_sql(numbers: list[str], texts: list[str], source: str) -> str:
    parts = [f"""SELECT '{c}' AS "column", count({c}) AS count, NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
      round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
      round(quantile_cont({c}, 0.25), 6)::DOUBLE AS p25, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS p50,
      round(quantile_cont({c}, 0.75), 6)::DOUBLE AS p75, max({c})::DOUBLE AS max FROM {source}""" for c in numbers]
    parts += [f"""SELECT '{c}', sum(n)::BIGINT, count(*), first({c} ORDER BY n DESC, {c}), first(n ORDER BY n DESC, {c}),
      NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"""
              for c in texts]
    return " UNION ALL ".join(parts)


_GAPPED = """g AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS l_discount, l_returnflag, l_linestatus FROM lineitem)"""


@query("q2_describe", f"WITH {_GAPPED} " + _describe_sql(
    ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"], "g"))
def _(spark, sf):
    result = quality.describe(_unnumbered(spark, sf))
    return result.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("q2_describe_parts", _describe_sql(["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"], "part"))
def _(spark, sf):
    result = quality.describe(table(spark, sf, "part"))
    return result.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


_BASE_TYPES = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
               "l_discount": "double", "l_returnflag": "string", "l_linestatus": "string"}


@query("q3_describe_columns", f"WITH {_GAPPED} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, '{t}' AS dtype, count(*) AS n_rows, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)
    AS n_unique, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM g""" for c, t in _BASE_TYPES.items()))
def _(spark, sf):
    return quality.describe_columns(_unnumbered(spark, sf))


@query("q4_missing_percent", f"WITH {_GAPPED} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS percent_missing FROM g"""
    for c in _BASE_TYPES))
def _(spark, sf):
    return quality.missing_percent(_unnumbered(spark, sf)).withColumn("percent_missing", F.round("percent_missing", 6))


@query("q5_rows_with_missing", f"WITH {_GAPPED} SELECT * FROM g WHERE l_discount IS NULL")
def _(spark, sf):
    return quality.rows_with_missing(_unnumbered(spark, sf))


@query("q6_duplicate_rows", f"""WITH {_DUPES} SELECT * EXCLUDE (c) FROM (SELECT *, count(*) OVER
  (PARTITION BY l_quantity, l_discount, l_returnflag, l_tax) AS c FROM dupes) WHERE c > 1""")
def _(spark, sf):
    return quality.duplicate_rows(_dupes(spark, sf))


@query("q7_unique_values", f"WITH {_BASE} SELECT l_discount AS value, min(_row_id) AS first_row FROM base GROUP BY l_discount")
def _(spark, sf):
    return quality.unique_values(_base(spark, sf), "l_discount")


@query("q8_distinct_counts", f"WITH {_GAPPED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM g" for c in _BASE_TYPES))
def _(spark, sf):
    return quality.distinct_counts(_unnumbered(spark, sf), list(_BASE_TYPES))


@query("q9_value_counts", f"WITH {_GAPPED} SELECT l_discount AS value, count(*) AS n FROM g GROUP BY l_discount")
def _(spark, sf):
    return quality.value_counts(_unnumbered(spark, sf), "l_discount")


@query("q9_value_counts_page", "SELECT user_id AS value, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, value LIMIT 10 OFFSET 10")
def _(spark, sf):
    return quality.value_counts(table(spark, sf, "events"), "user_id", page=2)


@query("q10_page", f"WITH {_BASE} SELECT * FROM base WHERE _row_id BETWEEN 40 AND 49")
def _(spark, sf):
    return rowid.page(_base(spark, sf), 5)


@query("q11_filter_positions", f"WITH {_BASE} SELECT * FROM base WHERE _row_id BETWEEN 1000 AND 1999")
def _(spark, sf):
    return rowid.filter_positions(_base(spark, sf), "1000 - 1999")


@query("q12_quality_report", f"WITH {_GAPPED} " + " UNION ALL ".join(
    f"""SELECT 'missing' AS "check", '{c}' AS "column", count(*) = count({c}) AS ok,
    CASE WHEN count(*) > count({c}) THEN 'Missing values: ' || (count(*) - count({c})) END AS detail FROM g""" for c in _BASE_TYPES)
    + " UNION ALL SELECT 'empty', NULL, count(*) > 0, CASE WHEN count(*) = 0 THEN 'the table is empty' END FROM g")
def _(spark, sf):
    return quality.quality_report(_unnumbered(spark, sf))


@query("q13_high_cardinality", """SELECT * FROM (SELECT 'c_name' AS "column", count(DISTINCT c_name) AS n_distinct,
  1000::BIGINT AS threshold FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), 1000 FROM customer)
  WHERE n_distinct > 1000""")
def _(spark, sf):
    return quality.cardinality_warnings(table(spark, sf, "customer"))


@query("q14_wrong_task", """SELECT count(DISTINCT o_totalprice) AS n_distinct, count(*) AS n_rows,
  round(count(DISTINCT o_totalprice)::DOUBLE / count(*) * 100, 2) AS percent,
  round(count(DISTINCT o_totalprice)::DOUBLE / count(*) * 100, 2) > 50 AS suspicious FROM orders""")
def _(spark, sf):
    return quality.wrong_task_check(table(spark, sf, "orders"), "o_totalprice")


_PART_KINDS = {"p_partkey": "numeric", "p_name": "categorical", "p_brand": "categorical", "p_type": "categorical",
               "p_size": "numeric", "p_retailprice": "numeric"}


@query("q15_column_kinds", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{k}' AS kind, count(DISTINCT {c}) AS n_distinct,
    '{k}' = 'categorical' OR count(DISTINCT {c}) <= 30 AS bar_axis, '{k}' = 'categorical' OR count(DISTINCT {c}) < 30 AS box_axis
    FROM part""" for c, k in _PART_KINDS.items()))
def _(spark, sf):
    return quality.column_kinds(table(spark, sf, "part"))


# --- full profile ------------------------------------------------------------------------

_PROFILE_NUMBERS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]


def _moment_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min,
      max({c})::DOUBLE AS max, round(avg(power(({c} - m) / s, 3)), 4) AS skewness, round(avg(power(({c} - m) / s, 4)) - 3, 4) AS kurtosis,
      count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives,
      round(quantile_cont({c}, 0.05), 4)::DOUBLE AS p5, round(quantile_cont({c}, 0.25), 4)::DOUBLE AS p25,
      round(quantile_cont({c}, 0.5), 4)::DOUBLE AS p50, round(quantile_cont({c}, 0.75), 4)::DOUBLE AS p75,
      round(quantile_cont({c}, 0.95), 4)::DOUBLE AS p95
      FROM g, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM g)"""


@query("q16_profile_numbers", f"WITH {_GAPPED} " + " UNION ALL ".join(_moment_sql(c) for c in _PROFILE_NUMBERS))
def _(spark, sf):
    result = profiling.number_profile(_unnumbered(spark, sf))
    return result.withColumns({c: F.round(c, 4) for c in ("mean", "std", "skewness", "kurtosis", "p5", "p25", "p50", "p75", "p95")})


@query("q16_profile_texts", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", min(length({c})) AS min_length, round(avg(length({c})), 6) AS mean_length,
    max(length({c})) AS max_length FROM documents""" for c in ("text", "lang", "source")))
def _(spark, sf):
    return profiling.text_profile(table(spark, sf, "documents")).withColumn("mean_length", F.round("mean_length", 6))


@query("q16_profile_top_values", """WITH c AS (SELECT 'p_name' AS "column", p_name AS value, count(*) AS n FROM part GROUP BY p_name
  UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
  UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY p_size)
  SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value, n FROM c
  QUALIFY rank <= 5""")
def _(spark, sf):
    return profiling.top_values(table(spark, sf, "part").select("p_name", "p_brand", "p_type", "p_size"))


@query("q16_profile_duplicates", """WITH g AS (SELECT l_quantity, l_discount, l_returnflag,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax FROM lineitem)
  SELECT (SELECT count(*) FROM g) AS n_rows, count(*) AS n_distinct_rows, (SELECT count(*) FROM g) - count(*) AS n_surplus
  FROM (SELECT DISTINCT * FROM g)""")
def _(spark, sf):
    return profiling.duplicate_summary(_plain_dupes(spark, sf))


@query("q16_profile_alerts", f"WITH {_GAPPED}, f AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS u,
    count(*) - count({c}) AS m, {f"count(*) FILTER (WHERE {c} = 0)" if t not in ("string",) else "0"} AS z FROM g"""
    for c, t in _BASE_TYPES.items()) + """) SELECT "column", 'constant' AS alert FROM f WHERE u = 1 UNION ALL
    SELECT "column", 'almost unique' FROM f WHERE u > n * 0.9 UNION ALL SELECT "column", 'missing' FROM f WHERE m > n * 0.05
    UNION ALL SELECT "column", 'zeros' FROM f WHERE z > n * 0.5""")
def _(spark, sf):
    return profiling.alerts(_unnumbered(spark, sf))


# --- charts ------------------------------------------------------------------------------


def _histogram_sql(column: str, source: str, bins: int) -> str:
    return f"""WITH m AS (SELECT min({column})::DOUBLE AS lo, (max({column}) - min({column}))::DOUBLE / {bins} AS w FROM {source}),
      c AS (SELECT least(floor(({column} - lo) / w), {bins - 1})::INT AS bin, count(*) AS n FROM {source}, m GROUP BY 1)
      SELECT r.bin::INT AS bin, round(lo + r.bin * w, 6) AS left_edge, round(lo + (r.bin + 1) * w, 6) AS right_edge, coalesce(n, 0) AS n
      FROM range({bins}) r(bin) CROSS JOIN m LEFT JOIN c ON c.bin = r.bin"""


@query("v1_histogram", _histogram_sql("l_extendedprice", "lineitem", 10))
def _(spark, sf):
    edges = ("left_edge", "right_edge")
    return charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice").withColumns({c: F.round(c, 6) for c in edges})


@query("v1_histogram_events", _histogram_sql("value", "events", 60))
def _(spark, sf):
    edges = ("left_edge", "right_edge")
    return charts.histogram(table(spark, sf, "events"), "value", bins=60).withColumns({c: F.round(c, 6) for c in edges})


@query("v2_density", """WITH m AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi,
    stddev_samp(value) * power(count(value), -0.2) AS h FROM events),
  v AS (SELECT value AS x, count(*) AS c FROM events GROUP BY value)
  SELECT i::INT AS point, round(lo + (hi - lo) * i / 99, 6) AS x, round(sum(c * exp(-0.5 * power((lo + (hi - lo) * i / 99 - v.x) / h, 2)))
    / (max(n) * max(h) * sqrt(2 * pi())), 8) AS density FROM range(100) r(i), m, v GROUP BY i, lo, hi""")
def _(spark, sf):
    return charts.density(table(spark, sf, "events"), "value").withColumns({"x": F.round("x", 6), "density": F.round("density", 8)})


_BOX_SQL = """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
    quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag),
  b AS (SELECT *, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM lineitem JOIN q USING (l_returnflag))"""


@query("v3_box_stats", _BOX_SQL + """ SELECT l_returnflag, count(*) AS n, round(first(q1), 6) AS q1, round(first(median), 6) AS median,
  round(first(q3), 6) AS q3, min(l_extendedprice) FILTER (WHERE inside) AS whisker_low,
  max(l_extendedprice) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS n_outliers
  FROM b GROUP BY l_returnflag""")
def _(spark, sf):
    stats = charts.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return stats.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("v3_box_outliers", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type) SELECT event_id, event_type, value FROM events JOIN q USING (event_type)
  WHERE value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def _(spark, sf):
    return charts.box_outliers(table(spark, sf, "events").select("event_id", "event_type", "value"), "value", "event_type")


def _bar(how: str):
    def run(spark, sf):
        return charts.bar(table(spark, sf, "part"), "p_brand", "p_retailprice", how).withColumn("value", F.round("value", 4))
    return run


for _how, _sql in {"sum": "sum(p_retailprice)", "count": "count(p_retailprice)", "mean": "avg(p_retailprice)",
                   "median": "quantile_cont(p_retailprice, 0.5)", "min": "min(p_retailprice)", "max": "max(p_retailprice)"}.items():
    query(f"v4_bar_{_how}", f"SELECT p_brand, round({_sql}, 4) AS value FROM part GROUP BY p_brand")(_bar(_how))


@query("v5_pie", """SELECT event_type AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
  FROM events GROUP BY event_type""")
def _(spark, sf):
    return charts.pie(table(spark, sf, "events"), "event_type").withColumn("percent", F.round("percent", 6))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query("v6_correlation_matrix", f"WITH {_GAPPED} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM g" for a in _CORR for b in _CORR))
def _(spark, sf):
    return charts.correlation_matrix(_unnumbered(spark, sf), _CORR).withColumn("r", F.round("r", 6))


@query("v7_correlation_with", f"WITH {_GAPPED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS r FROM g" for c in _CORR if c != "l_extendedprice"))
def _(spark, sf):
    return charts.correlation_with(_unnumbered(spark, sf), "l_extendedprice", _CORR).withColumn("r", F.round("r", 6))


@query("v8_scatter", f"WITH {_GAPPED} SELECT l_quantity, l_extendedprice, l_returnflag, l_discount FROM g WHERE l_discount IS NOT NULL")
def _(spark, sf):
    return charts.scatter(_unnumbered(spark, sf), "l_quantity", "l_extendedprice", "l_returnflag", "l_discount")


@query("v8_scatter_bins", """WITH m AS (SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 20 AS wx,
    min(l_extendedprice) AS y0, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS wy FROM lineitem)
  SELECT least(floor((l_quantity - x0) / wx), 19)::INT AS x_bin, least(floor((l_extendedprice - y0) / wy), 19)::INT AS y_bin,
    count(*) AS n FROM lineitem, m GROUP BY 1, 2""")
def _(spark, sf):
    return charts.scatter_bins(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", bins=20)
