"""Building blocks of the SQL twins for prepared data and closed-form models."""

from __future__ import annotations

ORDER_FEATURES = ["o_totalprice", "o_orderpriority", "c_nationkey", "c_acctbal", "c_mktsegment"]
_TEXT = ["o_orderpriority", "c_mktsegment"]

SOURCE = """src AS (SELECT o_orderkey, o_totalprice, o_orderpriority, c_nationkey, c_acctbal, c_mktsegment, o_orderstatus,
  dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS label FROM orders JOIN customer ON o_custkey = c_custkey),
split AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) <= ceil(0.2 * (SELECT count(*) FROM src)) AS is_test FROM src)"""

ENCODED = SOURCE + "".join(f""", codes_{c} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS code FROM
  (SELECT DISTINCT {c} FROM split WHERE NOT is_test))""" for c in _TEXT) + """, enc AS (SELECT o_orderkey, is_test, label::DOUBLE AS label,
  o_totalprice, codes_o_orderpriority.code::DOUBLE AS o_orderpriority, c_nationkey::DOUBLE AS c_nationkey, c_acctbal,
  codes_c_mktsegment.code::DOUBLE AS c_mktsegment
  FROM split JOIN codes_o_orderpriority USING (o_orderpriority) JOIN codes_c_mktsegment USING (c_mktsegment))"""


def scaled(how: str, features: list[str] = ORDER_FEATURES) -> str:
    """CTEs up to ``prep``: split, encoded, scaled orders."""
    if how == "none":
        return ENCODED + ", prep AS (SELECT * FROM enc)"
    a, b = {"standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "(max({c}) - min({c}))")}[how]
    stats = ", ".join(f"{a.format(c=c)} AS a_{c}, {b.format(c=c)} AS b_{c}" for c in features)
    outs = ", ".join(f"({c} - a_{c}) / b_{c} AS {c}" for c in features)
    return ENCODED + f", st AS (SELECT {stats} FROM enc WHERE NOT is_test), prep AS (SELECT o_orderkey, is_test, label, {outs} FROM enc, st)"


def decide(scores: str) -> str:
    """``pred``: the class with the highest score, the smaller class winning a tie."""
    return f""", scores AS ({scores}), pred AS (SELECT o_orderkey, label, c AS prediction FROM scores
      QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s DESC, c) = 1)"""


def gaussian(features: list[str] = ORDER_FEATURES, smoothing: float = 1e-9) -> str:
    eps = "greatest(" + ", ".join(f"var_pop({f})" for f in features) + f") * {smoothing}"
    stats = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in features)
    term = " + ".join(f"(-0.5 * ln(2 * pi() * (v_{f} + eps)) - power({f} - m_{f}, 2) / (2 * (v_{f} + eps)))" for f in features)
    return f""", eps AS (SELECT {eps} AS eps FROM prep WHERE NOT is_test),
      cls AS (SELECT label AS c, count(*) AS n, {stats} FROM prep WHERE NOT is_test GROUP BY label)""" + decide(
        f"SELECT o_orderkey, label, c, ln(n / (SELECT sum(n) FROM cls)) + {term} AS s FROM prep, cls, eps WHERE is_test")


def multinomial(features: list[str] = ORDER_FEATURES) -> str:
    sums = ", ".join(f"sum({f}) + 1.0 AS s_{f}" for f in features)
    whole = " + ".join(f"s_{f}" for f in features)
    term = " + ".join(f"{f} * (ln(s_{f}) - ln({whole}))" for f in features)
    return f", cls AS (SELECT label AS c, count(*) AS n, {sums} FROM prep WHERE NOT is_test GROUP BY label)" + decide(
        f"SELECT o_orderkey, label, c, ln(n / (SELECT sum(n) FROM cls)) + {term} AS s FROM prep, cls WHERE is_test")


def complement(features: list[str] = ORDER_FEATURES) -> str:
    sums = ", ".join(f"sum({f}) AS s_{f}" for f in features)
    rest = ", ".join(f"sum(s_{f}) OVER () + 1.0 - s_{f} AS r_{f}" for f in features)
    whole = " + ".join(f"r_{f}" for f in features)
    term = " + ".join(f"{f} * -ln(r_{f} / ({whole}))" for f in features)
    return f""", cls AS (SELECT label AS c, {sums} FROM prep WHERE NOT is_test GROUP BY label), com AS (SELECT c, {rest} FROM cls)""" + decide(
        f"SELECT o_orderkey, label, c, {term} AS s FROM prep, com WHERE is_test")


def bernoulli(features: list[str] = ORDER_FEATURES) -> str:
    sums = ", ".join(f"(count(*) FILTER (WHERE {f} > 0) + 1.0) / (count(*) + 2.0) AS p_{f}" for f in features)
    term = " + ".join(f"CASE WHEN {f} > 0 THEN ln(p_{f}) ELSE ln(1 - p_{f}) END" for f in features)
    return f", cls AS (SELECT label AS c, count(*) AS n, {sums} FROM prep WHERE NOT is_test GROUP BY label)" + decide(
        f"SELECT o_orderkey, label, c, ln(n / (SELECT sum(n) FROM cls)) + {term} AS s FROM prep, cls WHERE is_test")


CATEGORY_FEATURES = ["o_orderpriority", "c_nationkey", "c_mktsegment"]


def categorical() -> str:
    long = " UNION ALL ".join(f"SELECT o_orderkey, label, is_test, '{f}' AS f, {f} AS k FROM prep" for f in CATEGORY_FEATURES)
    return f""", long AS ({long}), width AS (SELECT f, max(k) + 1 AS w FROM long WHERE NOT is_test GROUP BY f),
      cls AS (SELECT label AS c, count(*) AS n FROM prep WHERE NOT is_test GROUP BY label),
      cnt AS (SELECT label AS c, f, k, count(*) AS m FROM long WHERE NOT is_test GROUP BY ALL)""" + decide(
        """SELECT o_orderkey, label, cls.c, any_value(ln(n / (SELECT sum(n) FROM cls))) + sum(ln((coalesce(m, 0) + 1.0) / (n + w))) AS s
        FROM long JOIN width USING (f) CROSS JOIN cls LEFT JOIN cnt ON cnt.c = cls.c AND cnt.f = long.f AND cnt.k = long.k
        WHERE is_test GROUP BY o_orderkey, label, cls.c""")


# parts split for regression on one feature; x is standardised on the training part
PART_LINE = """src AS (SELECT p_partkey, p_size, p_retailprice AS label FROM part),
split AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || p_partkey)) <= ceil(0.2 * (SELECT count(*) FROM src)) AS is_test FROM src),
st AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM split WHERE NOT is_test),
prep AS (SELECT p_partkey, is_test, label, (p_size - m) / s AS x FROM split, st),
g AS (SELECT count(*) AS n, avg(x) AS mx, avg(label) AS my, covar_pop(x, label) AS cxy, var_pop(x) AS vx FROM prep WHERE NOT is_test)"""

REGRESSION_METRICS = """SELECT round(1 - mse / vy, 6) AS r2_score, round(mse, 4) AS mse, round(sqrt(mse), 6) AS rmse,
  round(sqrt(mse) / my, 6) AS rmse_mean, round(mae, 6) AS mae, round(mape, 6) AS mape,
  round(1 - (mse / vy) * (n - 1) / (n - 2), 6) AS adjusted_r2_score, round(rm, 6) AS residual_mean, round(rs, 6) AS residual_std,
  round(rmin, 6) AS residual_min, round(rmax, 6) AS residual_max
  FROM (SELECT count(*) AS n, avg(label) AS my, var_pop(label) AS vy, avg(power(label - prediction, 2)) AS mse,
    avg(abs(label - prediction)) AS mae, avg(abs(label - prediction) / greatest(abs(label), 2.220446049250313e-16)) AS mape,
    avg(label - prediction) AS rm, stddev_pop(label - prediction) AS rs, min(label - prediction) AS rmin, max(label - prediction) AS rmax FROM pred)"""
