"""Statistics (M rows without learning algorithms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import stats as st
from tallyloom.operators.reshape import hash_split
from tallyloom.plans.registry import query

XY = "l_extendedprice AS y, l_quantity AS x1, l_discount AS x2"
OLS2 = f"""z AS (SELECT {XY} FROM lineitem),
  s AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) * var_pop(x1) AS s11, count(*) * var_pop(x2) AS s22, count(*) * var_pop(y) AS syy,
          count(*) * covar_pop(x1, x2) AS s12, count(*) * covar_pop(x1, y) AS s1y, count(*) * covar_pop(x2, y) AS s2y FROM z),
  b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
  r AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (syy - b1 * s1y - b2 * s2y) AS rss, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS v FROM b),
  c AS (SELECT 'l_quantity' AS term, b1 AS estimate, sqrt(v * s22 / det) AS se FROM r UNION ALL SELECT 'l_discount', b2, sqrt(v * s11 / det) FROM r
    UNION ALL SELECT '(intercept)', b0, sqrt(v * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) FROM r)"""
XS = ["l_quantity", "l_discount"]


def price_rows(t):
    return t.lineitem.select("l_extendedprice", *XS)


FIT = ["slope", "intercept", "sigma", "slope_se", "intercept_se", "slope_t", "intercept_t"]


@query(
    "M01_simple_fit",
    """WITH g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx,
           regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS mx FROM lineitem GROUP BY 1),
         v AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM g),
         e AS (SELECT *, sqrt(s2) AS sigma, sqrt(s2 / sxx) AS bse, sqrt(s2 * (1 / n + mx * mx / sxx)) AS ase FROM v)
       SELECT l_returnflag, CAST(n AS BIGINT) AS n, round(b, 6) AS slope, round(a, 4) AS intercept, round(sigma, 4) AS sigma, round(bse, 6) AS slope_se, round(ase, 6) AS intercept_se,
         round(b / bse, 6) AS slope_t, round(a / ase, 6) AS intercept_t, round(sxy * sxy / (sxx * syy), 8) AS r_squared FROM e""",
)
def _(t):
    out = st.simple_fit(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")
    digits = {"slope": 6, "intercept": 4, "sigma": 4, "slope_se": 6, "intercept_se": 6, "slope_t": 6, "intercept_t": 6, "r_squared": 8}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "M01_coefficient_table",
    f"WITH {OLS2} SELECT term, round(estimate, 4) AS estimate, round(se, 4) AS std_error, round(estimate / se, 4) AS t_value FROM c",
)
def _(t):
    out = st.coefficient_table(price_rows(t), "l_extendedprice", XS)
    return out.select("term", *[F.round(c, 4).alias(c) for c in ("estimate", "std_error", "t_value")])


@query(
    "M01_model_quality",
    f"""WITH {OLS2} SELECT round(1 - rss / syy, 8) AS r_squared, round(1 - (rss / (n - 3)) / (syy / (n - 1)), 8) AS adj_r_squared, round(sqrt(rss / n), 4) AS rmse,
          CAST(n - 3 AS BIGINT) AS df_residual, CAST(n AS BIGINT) AS n FROM r""",
)
def _(t):
    out = st.model_quality(price_rows(t), "l_extendedprice", XS)
    return out.withColumns({"r_squared": F.round("r_squared", 8), "adj_r_squared": F.round("adj_r_squared", 8), "rmse": F.round("rmse", 4)})


@query("M01_coefficient_tests")
def _(t):
    return st.coefficient_table(price_rows(t), "l_extendedprice", XS)


@query(
    "M02_fitted_residuals",
    """WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1)
       SELECT l_orderkey, l_linenumber, l_partkey, round(a + b * l_quantity, 4) AS fitted, round(l_extendedprice - (a + b * l_quantity), 4) AS residual FROM lineitem JOIN f USING (l_returnflag)""",
)
def _(t):
    out = st.with_fit(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("fitted", 4).alias("fitted"), F.round("residual", 4).alias("residual"))


ANOVA = """g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1),
  a AS (SELECT count(*) - 1 AS df1, sum(n) - count(*) AS df2, sum(n * m) / sum(n) AS gm, sum(n * v) AS ssw FROM g),
  b AS (SELECT sum(n * pow(m - gm, 2)) AS ssb FROM g, a)"""


@query(
    "M03_anova",
    f"""WITH {ANOVA} SELECT df1 AS df_between, CAST(df2 AS BIGINT) AS df_within, round(ssb, 4) AS ss_between, round(ssw, 3) AS ss_within, round((ssb / df1) / (ssw / df2), 6) AS f_value FROM a, b""",
)
def _(t):
    out = st.anova(t.events, "event_type", "value")
    return out.select(
        "df_between", "df_within", F.round("ss_between", 4).alias("ss_between"), F.round("ss_within", 3).alias("ss_within"),
        F.round("f_value", 6).alias("f_value"),
    )


@query("M03_anova_test")
def _(t):
    return st.anova(t.events, "event_type", "value")


@query("M04_confidence_limits")
def _(t):
    out = st.coefficient_table(price_rows(t), "l_extendedprice", XS, level=0.95)
    return out.select("term", "estimate", "conf_low", "conf_high")


@query(
    "M05_rss_surface",
    """WITH z AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
         g AS (SELECT count(*)::DOUBLE AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx FROM z),
         e AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS s FROM g),
         k AS (SELECT unnest(range(-5, 6)) AS k), p AS (SELECT i.k AS i, j.k AS j, a + i.k * 3.0 / 5 * s * sqrt(1 / n + mx * mx / sxx) AS b0, b + j.k * 3.0 / 5 * s / sqrt(sxx) AS b1 FROM e, k i, k j)
       SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(b0, 6) AS b0, round(b1, 6) AS b1, round(avg(pow(y - b0 - b1 * x, 2)), 5) AS mse FROM p, z GROUP BY i, j, b0, b1""",
)
def _(t):
    rows = t.lineitem.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    out = st.rss_surface(rows, "y", "x", 3.0, 5)
    return out.withColumns({"b0": F.round("b0", 6), "b1": F.round("b1", 6), "mse": F.round("mse", 5)})


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "M06_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else f"round(corr({min(a, b, key=NUMS.index)}, {max(a, b, key=NUMS.index)}), 8)") + " AS r FROM "
        + ("(SELECT 1)" if a == b else "lineitem")
        for a in NUMS for b in NUMS
    ),
)
def _(t):
    return st.correlation_matrix(t.lineitem, NUMS).withColumn("r", F.round("r", 8))


@query(
    "M07_correlation_test",
    """WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT l_returnflag, round(r, 8) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t_value FROM c""",
)
def _(t):
    out = st.correlation_test(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round("r", 8).alias("r"), "n", F.round("t_value", 5).alias("t_value"))


@query("M07_correlation_p_value")
def _(t):
    out = st.correlation_test(t.lineitem, ["l_returnflag"], "l_discount", "l_tax")
    return out.select("l_returnflag", F.round("r", 8).alias("r"), "n", "p_value")


DEVICES = "(SELECT l_extendedprice / l_quantity AS a, p_retailprice * 1.5 AS b FROM lineitem JOIN part ON l_partkey = p_partkey)"


def devices(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select((F.col("l_extendedprice") / F.col("l_quantity")).alias("a"), (F.col("p_retailprice") * 1.5).alias("b"))


@query(
    "M08_paired_t_test",
    f"""SELECT round(avg(a - b), 5) AS mean_diff, round(stddev_samp(a - b), 5) AS sd_diff, count(*) AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 5) AS t_value FROM {DEVICES}""",
)
def _(t):
    out = st.paired_t_test(devices(t), [], "a", "b")
    return out.select(*[F.round(c, 5).alias(c) for c in ("mean_diff", "sd_diff", "t_value")], "n")


@query("M08_paired_t_p_value")
def _(t):
    out = st.paired_t_test(t.lineitem, ["l_returnflag", "l_linestatus"], "l_discount", "l_tax")
    return out.select("l_returnflag", "l_linestatus", "n", F.round("t_value", 5).alias("t_value"), "p_value")


@query(
    "M09_agreement",
    f"""WITH x AS (SELECT b - a AS d, (a + b) / 2 AS m FROM {DEVICES}), s AS (SELECT avg(d) AS bias, stddev_samp(d) AS sd, corr(d, m) AS r, count(*) AS n FROM x)
        SELECT round(bias, 5) AS bias, round(sd, 5) AS sd, round(any_value(r), 7) AS level_correlation, any_value(n) AS n, round(bias - 2 * sd, 5) AS lower, round(bias + 2 * sd, 5) AS upper,
          round(avg((d BETWEEN bias - 2 * sd AND bias + 2 * sd)::INT), 7) AS share_inside FROM x, s GROUP BY bias, sd""",
)
def _(t):
    out = st.agreement(devices(t), "a", "b")
    digits = {"bias": 5, "sd": 5, "level_correlation": 7, "lower": 5, "upper": 5, "share_inside": 7}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


TALLY = "(SELECT p_brand, p_size, count(*) AS w FROM part GROUP BY 1, 2)"


@query(
    "M10_weighted_mean",
    """SELECT p_brand, count(*) AS n, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size) / sqrt(count(*)), 6) AS std_error FROM part GROUP BY 1""",
)
def _(t):
    tally = t.part.groupBy("p_brand", "p_size").agg(F.count("*").alias("w"))
    out = st.weighted_mean_interval(tally, ["p_brand"], "p_size", "w")
    return out.select("p_brand", "n", F.round("mean", 6).alias("mean"), F.round("std_error", 6).alias("std_error"))


@query("M10_weighted_interval")
def _(t):
    tally = t.part.groupBy("p_brand", "p_size").agg(F.count("*").alias("w"))
    return st.weighted_mean_interval(tally, ["p_brand"], "p_size", "w")


@query(
    "M11_moments",
    """WITH m AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS sd FROM events GROUP BY 1)
       SELECT event_type, count(*) AS n, round(any_value(mean), 6) AS mean, round(any_value(sd), 6) AS sd, round(avg(pow((value - mean) / sd, 3)), 5) AS skewness, round(avg(pow((value - mean) / sd, 4)) - 3, 5) AS kurtosis
       FROM events JOIN m USING (event_type) GROUP BY 1""",
)
def _(t):
    digits = {"mean": 6, "sd": 6, "skewness": 5, "kurtosis": 5}
    return st.moments(t.events, ["event_type"], "value").withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("M11_normality_test")
def _(t):
    return st.normality_test(t.customer, "c_acctbal")


@query(
    "M12_outside_limits",
    """SELECT event_id, value FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type) WHERE abs(value - m) > 2 * s""",
)
def _(t):
    return st.outside_limits(t.events, ["event_type"], "value").select("event_id", "value")


@query(
    "M13_hash_split",
    "SELECT o_orderkey, ('0x' || substr(md5('3|' || o_orderkey), 1, 8))::UBIGINT % 1000 < 750 AS is_train FROM orders",
)
def _(t):
    return hash_split(t.orders.select("o_orderkey"), 0.75, 3, "o_orderkey")


@query(
    "M16_near_zero_variance",
    "WITH " + ", ".join(
        f"c{i} AS (SELECT {c} AS v, count(*) AS n FROM z GROUP BY 1), o{i} AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM c{i})"
        for i, c in enumerate(["l_returnflag", "l_discount", "rare", "fixed"])
    ).replace("c0 AS", "z AS (SELECT l_returnflag, l_discount, CASE WHEN l_quantity = 50 AND l_tax = 0 THEN 'x' ELSE 'y' END AS rare, 'k' AS fixed FROM lineitem), c0 AS", 1)
    + " " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(coalesce((SELECT n FROM o{i} WHERE r = 1)::DOUBLE / (SELECT n FROM o{i} WHERE r = 2), 0), 8) AS freq_ratio, round(count(*) / sum(n), 10) AS unique_share,
            count(*) = 1 OR (coalesce((SELECT n FROM o{i} WHERE r = 1)::DOUBLE / (SELECT n FROM o{i} WHERE r = 2), 0) > 19 AND count(*) / sum(n) <= 0.1) AS "drop" FROM c{i}"""
        for i, c in enumerate(["l_returnflag", "l_discount", "rare", "fixed"])
    ),
)
def _(t):
    rare = F.when((F.col("l_quantity") == 50) & (F.col("l_tax") == 0), "x").otherwise("y")
    rows = t.lineitem.select("l_returnflag", "l_discount", rare.alias("rare"), F.lit("k").alias("fixed"))
    out = st.near_zero_variance(rows, rows.columns)
    return out.withColumns({"freq_ratio": F.round("freq_ratio", 8), "unique_share": F.round("unique_share", 10)})


LAMBDAS = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]


@query(
    "M17_box_cox_grid",
    " UNION ALL ".join(
        f"""SELECT {l}::DOUBLE AS lambda, round(-count(*) / 2.0 * ln(var_pop({'ln(l_quantity)' if l == 0 else f'(pow(l_quantity, {l}) - 1) / {l}'})) + ({l} - 1) * sum(ln(l_quantity)), 2) AS log_likelihood FROM lineitem"""
        for l in LAMBDAS
    ),
)
def _(t):
    out = st.box_cox_grid(t.lineitem, "l_quantity", LAMBDAS)
    return out.withColumn("log_likelihood", F.round("log_likelihood", 2))


@query(
    "M17_centre_scale",
    """WITH s AS (SELECT avg(p_size) AS m1, stddev_samp(p_size) AS s1, avg(p_retailprice) AS m2, stddev_samp(p_retailprice) AS s2 FROM part)
       SELECT p_partkey, round((p_size - m1) / s1, 8) AS p_size, round((p_retailprice - m2) / s2, 8) AS p_retailprice FROM part, s""",
)
def _(t):
    out = st.centre_scale(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.withColumns({c: F.round(c, 8) for c in ("p_size", "p_retailprice")})


@query(
    "M25_regression_metrics",
    f"SELECT round(sqrt(avg(pow(a - b, 2))), 5) AS rmse, round(avg(abs(a - b)), 5) AS mae, round(pow(corr(a, b), 2), 8) AS r_squared FROM {DEVICES}",
)
def _(t):
    out = st.regression_metrics(devices(t), "a", "b")
    return out.withColumns({"rmse": F.round("rmse", 5), "mae": F.round("mae", 5), "r_squared": F.round("r_squared", 8)})


PROFILE_COLS = ["o_orderkey", "o_totalprice", "big"]


@query(
    "M26_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg(({c} IS NULL)::INT), 8) AS missing_share, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, min({c})::DOUBLE AS p0,
            round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, max({c})::DOUBLE AS p100
            FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS big FROM orders)"""
        for c in PROFILE_COLS
    ),
)
def _(t):
    rows = t.orders.select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice")).alias("big")
    )
    out = st.profile(rows, PROFILE_COLS)
    return out.withColumns({"missing_share": F.round("missing_share", 8), **{c: F.round(c, 4) for c in ("mean", "sd", "p25", "p50", "p75")}})


@query(
    "X15_bounding_box",
    """SELECT p_brand, round(min(p_size) - 0.1::DOUBLE * (max(p_size) - min(p_size)), 6) AS p_size_low, round(max(p_size) + 0.1::DOUBLE * (max(p_size) - min(p_size)), 6) AS p_size_high,
         round(min(p_retailprice) - 0.1::DOUBLE * (max(p_retailprice) - min(p_retailprice)), 6) AS p_retailprice_low, round(max(p_retailprice) + 0.1::DOUBLE * (max(p_retailprice) - min(p_retailprice)), 6) AS p_retailprice_high
       FROM part GROUP BY 1""",
)
def _(t):
    out = st.bounding_box(t.part, ["p_brand"], ["p_size", "p_retailprice"])
    return out.select("p_brand", *[F.round(c, 6).alias(c) for c in out.columns[1:]])
