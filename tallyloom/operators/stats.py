"""Regression, tests and summaries from sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import cut_lineage, join_on_keys, store_and_reload, with_group_totals, with_table_scalars
from tallyloom.functions.columns import grown_bounds
from tallyloom.functions.tails import f_pvalue, t_critical, t_pvalue
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.relational import top_per_group

# --- regression ------------------------------------------------------------------


def simple_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Straight-line fit per group with standard errors, t values and r squared."""
    n, sxx, syy, sxy = (F.col(c) for c in ("n", "__sxx", "__syy", "__sxy"))
    s = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_sxx(y, x).alias("__sxx"),
        F.regr_syy(y, x).alias("__syy"),
        F.regr_sxy(y, x).alias("__sxy"),
        F.regr_avgx(y, x).alias("__mx"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )
    rss = syy - sxy * sxy / sxx
    s2 = rss / (n - 2)
    s = s.withColumns(
        {
            "sigma": F.sqrt(s2),
            "slope_se": F.sqrt(s2 / sxx),
            "intercept_se": F.sqrt(s2 * (1 / n + F.col("__mx") * F.col("__mx") / sxx)),
            "r_squared": sxy * sxy / (sxx * syy),
        }
    )
    return s.withColumns(
        {
            "slope_t": F.col("slope") / F.col("slope_se"),
            "intercept_t": F.col("intercept") / F.col("intercept_se"),
        }
    ).drop("__sxx", "__syy", "__sxy", "__mx")


def with_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Fitted value and residual of a straight-line fit on every row.

    The fits are stored first: Spark then knows how small a table of few groups
    is, and does not shuffle the rows by the group.
    """
    fit = [F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a")]
    if keys:
        out = join_on_keys(df, store_and_reload(df.groupBy(*keys).agg(*fit), "fits"), list(keys))
    else:
        out = with_group_totals(df, [], *fit)
    fitted = F.col("__a") + F.col("__b") * F.col(x)
    return out.withColumns({"fitted": fitted, "residual": F.col(y) - fitted}).drop("__a", "__b")


def linear_model(df: DataFrame, y: str, xs: Sequence[str]):
    """Ordinary least squares by the normal equations (one distributed pass)."""
    rows = VectorAssembler(inputCols=list(xs), outputCol="__x", handleInvalid="skip").transform(
        df.select(y, *xs).na.drop()
    )
    return LinearRegression(featuresCol="__x", labelCol=y, solver="normal", regParam=0.0).fit(rows)


def coefficient_table(df: DataFrame, y: str, xs: Sequence[str], level: float = 0.95) -> DataFrame:
    """Estimate, standard error, t, p and confidence limits per coefficient."""
    model = linear_model(df, y, xs)
    s = model.summary
    est = [*model.coefficients.tolist(), model.intercept]
    rows = list(
        zip(
            [*xs, "(intercept)"],
            [float(v) for v in est],
            [float(v) for v in s.coefficientStandardErrors],
            [float(v) for v in s.tValues],
            [float(v) for v in s.pValues],
        )
    )
    table = df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, t_value double, p_value double"
    )
    margin = t_critical(level, F.lit(float(s.degreesOfFreedom))) * F.col("std_error")
    return table.withColumns(
        {"conf_low": F.col("estimate") - margin, "conf_high": F.col("estimate") + margin}
    )


def model_quality(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    s = linear_model(df, y, xs).summary
    row = (float(s.r2), float(s.r2adj), float(s.rootMeanSquaredError), int(s.degreesOfFreedom), int(s.numInstances))
    return df.sparkSession.createDataFrame(
        [row], "r_squared double, adj_r_squared double, rmse double, df_residual long, n long"
    )


def rss_surface(df: DataFrame, y: str, x: str, spread: float, steps: int) -> DataFrame:
    """Mean squared error on a grid of intercepts and slopes around the fit.

    The grid spans ``spread`` standard errors on both sides. Each grid point is
    a quadratic form of sums of distances from the means.
    """
    fit = simple_fit(df, [], y, x)
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    rows = with_table_scalars(rows, rows.agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my")))
    sums = rows.withColumns({"x": F.col("x") - F.col("__mx"), "y": F.col("y") - F.col("__my")}).agg(
        F.first("__mx").alias("__mx"),
        F.first("__my").alias("__my"),
        F.count("*").alias("__n"),
        F.sum("x").alias("__x"),
        F.sum("y").alias("__y"),
        F.sum(F.col("x") * F.col("x")).alias("__xx"),
        F.sum(F.col("x") * F.col("y")).alias("__xy"),
        F.sum(F.col("y") * F.col("y")).alias("__yy"),
    )
    one = with_table_scalars(fit, sums)
    grid = F.sequence(F.lit(-steps), F.lit(steps))
    at = one.withColumn("i", F.explode(grid)).withColumn("j", F.explode(grid))
    b0 = F.col("intercept") + F.col("i") * spread / steps * F.col("intercept_se")
    b1 = F.col("slope") + F.col("j") * spread / steps * F.col("slope_se")
    at = at.withColumns({"b0": b0, "b1": b1})
    b1 = F.col("b1")
    b0 = F.col("b0") + b1 * F.col("__mx") - F.col("__my")  # the intercept as the shifted values see it
    rss = (
        F.col("__yy") - 2 * b0 * F.col("__y") - 2 * b1 * F.col("__xy")
        + b0 * b0 * F.col("__n") + 2 * b0 * b1 * F.col("__x") + b1 * b1 * F.col("__xx")
    )
    return at.select("i", "j", "b0", "b1", (rss / F.col("__n")).alias("mse"))


# --- tests ------------------------------------------------------------------------


def anova(df: DataFrame, factor: str, y: str) -> DataFrame:
    """One-way analysis of variance from one grouped pass."""
    g = df.filter(F.col(y).isNotNull()).groupBy(factor).agg(
        F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")
    )
    g = cut_lineage(g)  # one row per level
    tot = g.agg(
        F.sum("n").alias("N"),
        F.count("*").alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("v")).alias("ss_within"),
    )
    between = with_table_scalars(g, tot.select("grand")).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))).alias("ss_between")
    )
    t = with_table_scalars(tot, between).withColumns(
        {"df_between": F.col("k") - 1, "df_within": F.col("N") - F.col("k")}
    )
    f = (F.col("ss_between") / F.col("df_between")) / (F.col("ss_within") / F.col("df_within"))
    t = t.withColumn("f_value", f)
    return t.select(
        "df_between", "df_within", "ss_between", "ss_within", "f_value",
        f_pvalue(F.col("f_value"), F.col("df_between"), F.col("df_within")).alias("p_value"),
    )


def correlation_test(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation with t and two-sided p."""
    r = df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.regr_count(x, y).alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    r = r.withColumn("t_value", t)
    return r.withColumn("p_value", t_pvalue(F.col("t_value"), F.col("n") - 2))


def paired_t_test(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    s = df.groupBy(*keys).agg(F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), F.count(d).alias("n"))
    s = s.withColumn("t_value", F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n")))
    return s.withColumn("p_value", t_pvalue(F.col("t_value"), F.col("n") - 1))


def agreement(df: DataFrame, a: str, b: str, k: float = 2.0) -> DataFrame:
    """Agreement of two measurements: bias, limits, share inside, level effect."""
    d, m = F.col(b) - F.col(a), (F.col(a) + F.col(b)) / 2
    rows = store_and_reload(df.select(d.alias("d"), m.alias("m")).na.drop(), "differences")  # read for the limits and the share
    s = rows.agg(
        F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"), F.corr("d", "m").alias("level_correlation"),
        F.count("*").alias("n"),
    ).withColumns(
        {"lower": F.col("bias") - k * F.col("sd"), "upper": F.col("bias") + k * F.col("sd")}
    )
    limits = with_table_scalars(rows, s.select("lower", "upper"))
    inside = limits.agg(F.avg(F.col("d").between(F.col("lower"), F.col("upper")).cast("int")).alias("share_inside"))
    return with_table_scalars(s, inside)


def weighted_mean_interval(
    df: DataFrame, keys: Sequence[str], x: str, weight: str, level: float = 0.95
) -> DataFrame:
    """Mean of frequency-weighted values with a t confidence interval.

    The sums are of distances from the plain mean of a group, so that a high
    level costs no digits.
    """
    rows = with_group_totals(df.select(*keys, x, weight), list(keys), F.avg(x).alias("__c"))
    w, v = F.col(weight), F.col(x) - F.col("__c")
    s = rows.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * v).alias("__s"), F.sum(w * v * v).alias("__q"), F.first("__c").alias("__c")
    )
    mean = F.col("__c") + F.col("__s") / F.col("n")
    var = (F.col("__q") - F.col("__s") * F.col("__s") / F.col("n")) / (F.col("n") - 1)
    s = s.withColumns({"mean": mean, "std_error": F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n"))})
    margin = t_critical(level, F.col("n") - 1) * F.col("std_error")
    return s.withColumns({"low": F.col("mean") - margin, "high": F.col("mean") + margin}).drop("__s", "__q", "__c")


def moments(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Mean, standard deviation, skewness and excess kurtosis (population form)."""
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"),
        F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
    )


def normality_test(df: DataFrame, x: str) -> DataFrame:
    """Kolmogorov-Smirnov test against the normal with the sample's mean and sd."""
    row = df.agg(F.avg(x), F.stddev_samp(x)).first()
    return KolmogorovSmirnovTest.test(df.select(F.col(x).cast("double").alias(x)), x, "norm", row[0], row[1]).select(
        F.col("statistic"), F.col("pValue").alias("p_value")
    )


def outside_limits(df: DataFrame, keys: Sequence[str], x: str, k: float = 2.0) -> DataFrame:
    """Rows farther than k standard deviations from their group's mean."""
    s = with_group_totals(df, list(keys), F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    return s.filter(F.abs(F.col(x) - F.col("__m")) > k * F.col("__s")).drop("__m", "__s")


# --- whole tables --------------------------------------------------------------------


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of all column pairs, one aggregation, long form."""
    k = len(columns)
    row = df.agg(
        *[F.corr(columns[i], columns[j]).alias(f"v{i}_{j}") for i in range(k) for j in range(i + 1, k)]
    )
    cell = lambda i, j: F.lit(1.0) if i == j else F.col(f"v{min(i, j)}_{max(i, j)}")
    items = [
        F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), cell(i, j).alias("r"))
        for i in range(k)
        for j in range(k)
    ]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share, mean, sd and quartiles of each numeric column."""
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = typed.unpivot([], list(columns), "column", "value")
    basics = long.groupBy("column").agg(
        F.avg(F.col("value").isNull().cast("int")).alias("missing_share"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )
    q = exact_quantiles(long, ["column"], "value", {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0})
    return join_on_keys(basics, q, ["column"], "left")


def regression_metrics(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    """rmse, mean absolute error and squared correlation."""
    e = F.col(truth) - F.col(estimate)
    r = F.corr(truth, estimate)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (r * r).alias("r_squared"))


def near_zero_variance(df: DataFrame, columns: Sequence[str], freq_ratio: float = 19.0, unique_share: float = 0.1) -> DataFrame:
    """Columns that hardly vary: one dominant value and few distinct ones.

    The two highest value counts come from grouped counts in long form.
    """
    typed = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = typed.unpivot([], list(columns), "column", "value").filter("value IS NOT NULL")
    counts = store_and_reload(long.groupBy("column", "value").agg(F.count("*").alias("n")), "value-counts")
    top = top_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], 2)
    lead = top.groupBy("column").agg(F.max("n").alias("n1"), F.min("n").alias("n2"), F.count("*").alias("k"))
    sizes = counts.groupBy("column").agg(F.count("*").alias("n_unique"), F.sum("n").alias("n_rows"))
    both = lead.join(sizes, "column")
    ratio = F.when(F.col("k") == 1, F.lit(0.0)).otherwise(F.col("n1") / F.col("n2"))
    both = both.select("column", ratio.alias("freq_ratio"), (F.col("n_unique") / F.col("n_rows")).alias("unique_share"), "n_unique")
    flag = (F.col("n_unique") == 1) | ((F.col("freq_ratio") > freq_ratio) & (F.col("unique_share") <= unique_share))
    return both.select("column", "freq_ratio", "unique_share", flag.alias("drop"))


def box_cox_grid(df: DataFrame, x: str, lambdas: Sequence[float]) -> DataFrame:
    """Profile log-likelihood of the Box-Cox parameter on a grid, one pass."""
    v = F.col(x).cast("double")
    power = lambda l: F.ln(v) if l == 0 else (F.pow(v, F.lit(float(l))) - 1) / float(l)
    row = df.filter(v > 0).agg(
        F.count("*").alias("n"), F.sum(F.ln(v)).alias("sl"),
        *[F.var_pop(power(l)).alias(f"v{i}") for i, l in enumerate(lambdas)],
    )
    items = [
        F.struct(
            F.lit(float(l)).alias("lambda"),
            (-F.col("n") / 2 * F.ln(f"v{i}") + (float(l) - 1) * F.col("sl")).alias("log_likelihood"),
        )
        for i, l in enumerate(lambdas)
    ]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def centre_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with mean 0 and standard deviation 1."""
    aggs = [f(c).alias(f"__{t}_{c}") for c in columns for t, f in (("m", F.avg), ("s", F.stddev_samp))]
    out = with_table_scalars(df, df.agg(*aggs))
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}") for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def bounding_box(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fraction: float = 0.1) -> DataFrame:
    aggs: list[Column] = []
    for c in columns:
        lo, hi = grown_bounds(F.min(c), F.max(c), fraction)
        aggs += [lo.alias(f"{c}_low"), hi.alias(f"{c}_high")]
    return df.groupBy(*keys).agg(*aggs)
