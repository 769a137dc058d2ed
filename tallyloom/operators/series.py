"""Time-series models in closed form, all series in parallel.

The inputs are period tables (for example one row per series and day) whose
length per series is limited by the calendar, so ordered columns are computed
with ``bounded=True`` unless the caller says ``bounded=False``: a long series is
then cut into blocks, and its totals are combined before they are exchanged.
Operators that use the period table more than once store it first, so the raw
data is read once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import (
    cut_lineage,
    dealt,
    join_on_keys,
    store_and_reload,
    with_bounded_totals,
    with_group_totals,
    with_table_scalars,
)
from tallyloom.operators.relational import dense_calendar, role_join
from tallyloom.operators.sequence import sequence_columns
from tallyloom.operators.window import crossings, drop_repeats, event_flags, start_stop_intervals

# Two-sided 80 % and 95 % points of the normal distribution.
Z80, Z95 = 1.2815515655446004, 1.959963984540054


def _with_totals(df: DataFrame, keys: Sequence[str], bounded: bool, **aggs: Column) -> DataFrame:
    if bounded:
        return with_bounded_totals(df, list(keys), **aggs)
    return with_group_totals(cut_lineage(df), list(keys), *[a.alias(name) for name, a in aggs.items()])


def bucket_totals(df: DataFrame, keys: Sequence[str], bucket: Column, **aggs: Column) -> DataFrame:
    """Tumbling-bucket aggregates; ``bucket`` is an expression on event time."""
    return df.groupBy(*keys, bucket.alias("bucket")).agg(*[v.alias(k) for k, v in aggs.items()])


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, shift: str) -> DataFrame:
    """Two sensors on the same instant, after moving the right clock."""
    moved = right.withColumn(time, F.col(time) + F.expr(f"interval {shift}"))
    return left.join(moved, [*keys, time])


def interrupted_fit(
    df: DataFrame, keys: Sequence[str], time: str, value: str, event_date: Column, bounded: bool = True
) -> DataFrame:
    """Level and slope change at a known point, per series.

    The model value ~ T + D + P splits into one straight line on each side of
    the event, so two grouped regressions give all four coefficients.
    """
    flags = event_flags(df, keys, time, event_date, bounded=bounded)
    y, t, p = (F.col(c).cast("double") for c in (value, "T", "P"))
    pre, post = F.col("D") == 0, F.col("D") == 1
    f = flags.groupBy(*keys).agg(
        F.regr_intercept(F.when(pre, y), F.when(pre, t)).alias("intercept"),
        F.regr_slope(F.when(pre, y), F.when(pre, t)).alias("trend"),
        F.regr_intercept(F.when(post, y), F.when(post, p)).alias("__i1"),
        F.regr_slope(F.when(post, y), F.when(post, p)).alias("__s1"),
        F.count_if(pre).alias("n_before"),
        F.count_if(post).alias("n_after"),
    )
    level = F.col("__i1") - (F.col("intercept") + F.col("trend") * F.col("n_before"))
    return f.withColumns(
        {"level_change": level, "slope_change": F.col("__s1") - F.col("trend")}
    ).drop("__i1", "__s1")


def interrupted_with_control(
    fits: DataFrame, series: str, treated: str, control: str
) -> DataFrame:
    """Difference of all coefficients between a treated and a control series.

    These are the interaction terms of the pooled model with a group dummy.
    """
    coefs = ["intercept", "trend", "level_change", "slope_change"]
    pick = lambda s, c: F.max(F.when(F.col(series) == s, F.col(c)))
    return fits.agg(
        *[pick(control, c).alias(c) for c in coefs],
        *[(pick(treated, c) - pick(control, c)).alias(f"{c}_by_group") for c in coefs],
    )


def change_point(
    df: DataFrame, keys: Sequence[str], time: str, value: str, margin: int = 3, bounded: bool = True
) -> DataFrame:
    """Split of each series into two straight lines with the least squared error.

    Running sums give the error of both sides for every candidate at once. They
    are sums of distances from the means of the series, so that a high level
    costs no digits.
    """
    keys = list(keys)
    base = sequence_columns(df, keys, [time], position="t", bounded=bounded)
    base = _with_totals(base, keys, bounded, __n=F.count("*"), __m=F.avg(value))
    y, t = F.col(value).cast("double") - F.col("__m"), F.col("t") - (F.col("__n") + 1) / 2
    base = base.withColumns({"__t": t, "__y": y, "__tt": t * t, "__ty": t * y, "__yy": y * y})
    parts = ["__t", "__y", "__tt", "__ty", "__yy"]
    run = sequence_columns(base, keys, [time], running={f"{p}_l": p for p in parts}, bounded=bounded)
    run = _with_totals(run, keys, bounded, **{f"{p}_a": F.sum(p) for p in parts})

    def sse(n, st, sy, stt, sty, syy):
        vt, vy, c = stt - st * st / n, syy - sy * sy / n, sty - st * sy / n
        return F.greatest(vy - F.when(vt > 0, c * c / vt).otherwise(0.0), F.lit(0.0))

    left = sse(F.col("t"), *[F.col(f"{p}_l") for p in parts])
    right = sse(F.col("__n") - F.col("t"), *[F.col(f"{p}_a") - F.col(f"{p}_l") for p in parts])
    inside = (F.col("t") >= margin) & (F.col("t") <= F.col("__n") - margin)
    scored = run.filter(inside).withColumn("sse", left + right)
    best = F.min_by(F.struct(F.col(time).alias("last_before"), "t", "sse"), F.struct("sse", "t"))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def unit_root(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, **kw) -> DataFrame:
    """Dickey-Fuller t statistic: regression of the change on the last value."""
    kw.setdefault("bounded", True)
    s = sequence_columns(df, keys, order, lag={"__p": value}, **kw)
    change = F.col(value) - F.col("__p")
    r = s.groupBy(*keys).agg(
        F.corr(change, F.col("__p")).alias("r"), F.count("__p").alias("n")
    )
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return r.select(*keys, "n", t.alias("t_stat"))


def pair_residuals(df: DataFrame, series: str, time: str, value: str, a: str, b: str) -> DataFrame:
    """Residuals of series a regressed on series b at their common instants."""
    side = lambda s: F.max(F.when(F.col(series) == s, F.col(value)))
    wide = (
        df.filter(F.col(series).isin(a, b))
        .groupBy(time)
        .agg(side(a).alias("a"), side(b).alias("b"))
        .na.drop()
    )
    wide = cut_lineage(wide)  # one row per instant, used for the fit and the rows
    fit = wide.agg(F.regr_slope("a", "b").alias("slope"), F.regr_intercept("a", "b").alias("intercept"))
    both = with_table_scalars(wide, fit)
    return both.withColumn("residual", F.col("a") - (F.col("intercept") + F.col("slope") * F.col("b")))


def cointegration(df: DataFrame, series: str, time: str, value: str, a: str, b: str, **kw) -> DataFrame:
    """Engle-Granger: regression of a on b and unit-root test of the residuals."""
    res = pair_residuals(df, series, time, value, a, b)
    coefs = res.agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"))
    return with_table_scalars(unit_root(res, [], [time], "residual", **kw), coefs)


def cointegration_of_pairs(
    df: DataFrame, series: str, time: str, value: str, pairs: DataFrame, **kw
) -> DataFrame:
    """Engle-Granger test of many pairs at once; ``pairs`` has columns a and b."""
    rows = cut_lineage(df.select(F.col(series).alias("__s"), time, F.col(value).cast("double").alias("__v")))
    side = lambda name: rows.select(F.col("__s").alias(name), time, F.col("__v").alias(f"v_{name}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", time]).na.drop()
    fit = both.groupBy("a", "b").agg(
        F.regr_slope("v_a", "v_b").alias("slope"), F.regr_intercept("v_a", "v_b").alias("intercept")
    )
    res = join_on_keys(both, fit, ["a", "b"]).withColumn(
        "residual", F.col("v_a") - (F.col("intercept") + F.col("slope") * F.col("v_b"))
    )
    return join_on_keys(unit_root(res, ["a", "b"], [time], "residual", **kw), fit, ["a", "b"])


def pair_trades(residuals: DataFrame, time: str, k: float = 2.0, bounded: bool = True) -> DataFrame:
    """Long and short trades of a pair: open at k sd, close at the mean."""
    band = residuals.agg((k * F.stddev_samp("residual")).alias("band"))
    banded = with_table_scalars(residuals.select(time, "residual"), band).withColumn("mid", F.lit(0.0))
    ops = crossings(banded, [], [time], "residual", "band", "mid", bounded=bounded)
    ops = drop_repeats(ops, ["side"], [time], "op", bounded=bounded)
    return start_stop_intervals(ops, [], [time, "op"], time, "op", bounded=bounded)


def trade_returns(trades: DataFrame, prices: DataFrame, time: str, capital: float) -> DataFrame:
    """Cash-neutral return of each trade; half the capital on each leg.

    ``prices`` has one row per instant with the columns a and b.
    """
    priced = role_join(trades, prices.select(time, "a", "b"), time, {"open": "open", "close": "close"})
    va, vb = (F.bround(0.5 * capital / F.col(f"open_{s}")) for s in "ab")
    entry = F.when(F.col("operation") == "short", va * F.col("open_a") - vb * F.col("open_b")).otherwise(
        vb * F.col("open_b") - va * F.col("open_a")
    )
    exit_ = F.when(F.col("operation") == "short", vb * F.col("close_b") - va * F.col("close_a")).otherwise(
        va * F.col("close_a") - vb * F.col("close_b")
    )
    out = priced.withColumns({"entry": F.bround(entry, 2), "exit": F.bround(exit_, 2)})
    return out.withColumn("ret", (F.col("exit") - F.col("entry")) / capital)


def impute_gaps(
    df: DataFrame, keys: Sequence[str], day: str, value: str, donors: int = 5, bounded: bool = True
) -> DataFrame:
    """Fill missing days with the mean of the nearest observed values.

    Donors are the ``donors`` observations whose value on the fitted straight
    line is nearest. On a line these are the nearest in time, so candidates
    are reached by their rank among the observed days: an equi-join of at most
    2 * donors candidates per gap. Tasks are as many as days and candidates need.
    """
    keys = list(keys)
    df = cut_lineage(df)
    span = df.groupBy(*keys).agg((F.datediff(F.max(day), F.min(day)) + 1).alias("__n"))
    days = span.agg(F.sum("__n")).first()[0] or 0
    cal = dense_calendar(df, keys, day, days).withColumn("__o", F.when(F.col(value).isNotNull(), 1).otherwise(0))
    cal = dealt(cal, days, *keys) if bounded else cal
    cal = store_and_reload(sequence_columns(cal, keys, [day], running={"__rank": "__o"}, bounded=bounded), "calendar")
    n_cand = 2 * donors * cal.filter("__o = 0").count()
    observed = cal.filter("__o = 1").select(
        *keys, F.col(day).alias("__d"), F.col(value).alias("__v"), "__rank"
    )
    near = F.sequence(F.col("__rank") - (donors - 1), F.col("__rank") + donors)
    gaps = cal.filter("__o = 0").select(*keys, day, F.explode(near).alias("__rank"))
    at = [*keys, "__rank"]
    cand = dealt(dealt(gaps, n_cand, *at).join(dealt(observed, n_cand, *at), at), n_cand, *keys, day)
    w = Window.partitionBy(*keys, day).orderBy(F.abs(F.datediff(day, "__d")), "__d")
    filled = (
        cand.withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= donors)
        .groupBy(*keys, day)
        .agg(F.avg("__v").alias("__f"))
    )
    out = dealt(cal, days, *keys, day).join(dealt(filled, days, *keys, day), [*keys, day], "left")
    return out.select(
        *keys, day, F.coalesce(value, "__f").alias(value), (F.col("__o") == 0).alias("imputed")
    )


def trend_weekday_forecast(
    df: DataFrame, keys: Sequence[str], day: str, value: str, cutoff: Column, horizon: int
) -> DataFrame:
    """Forecast after a hold-out date: straight trend plus weekday effect.

    Fits on days before the cutoff and gives 80 % and 95 % bands from the
    standard deviation of the remaining errors, next to the actual values.
    """
    keys = list(keys)
    day0 = F.lit("2000-01-01").cast("date")
    base = cut_lineage(df).withColumn("__t", F.datediff(day, day0).cast("double"))
    train = base.filter(F.col(day) < cutoff)
    fit = train.groupBy(*keys).agg(
        F.regr_slope(value, "__t").alias("__b"), F.regr_intercept(value, "__t").alias("__a")
    )
    line = F.col("__a") + F.col("__b") * F.col("__t")
    errors = join_on_keys(train, fit, keys).withColumns(
        {"__e": F.col(value) - line, "__w": F.dayofweek(day)}
    )
    weekday = errors.groupBy(*keys, "__w").agg(F.avg("__e").alias("__we"))
    left = join_on_keys(errors, weekday, [*keys, "__w"])
    sd = left.groupBy(*keys).agg(F.stddev_samp(F.col("__e") - F.col("__we")).alias("__sd"))
    days = F.sequence(cutoff, F.date_add(cutoff, horizon - 1))
    future = fit.withColumn(day, F.explode(days)).withColumns(
        {"__t": F.datediff(day, day0).cast("double"), "__w": F.dayofweek(day)}
    )
    future = join_on_keys(future, weekday, [*keys, "__w"], "left")
    future = join_on_keys(future, sd, keys).withColumn("forecast", line + F.coalesce("__we", F.lit(0.0)))
    bands = {
        f"{side}{pct}": F.col("forecast") + sign * z * F.col("__sd")
        for pct, z in ((80, Z80), (95, Z95))
        for side, sign in (("lo", -1), ("hi", 1))
    }
    out = future.withColumns(bands).select(*keys, day, "forecast", *bands)
    return out.join(base.select(*keys, day, F.col(value).alias("actual")), [*keys, day], "left")


def decay_half_life(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Half-life of the exponential decay after the peak; NULL without decay."""
    keys = list(keys)
    df = cut_lineage(df)
    peak = df.groupBy(*keys).agg(
        F.max_by(F.col(time), F.struct(F.col(value), -F.col(time))).alias("peak_time")
    )
    after = join_on_keys(df, peak, keys).filter(
        (F.col(time) >= F.col("peak_time")) & (F.col(value) > 0)
    )
    x = (F.col(time) - F.col("peak_time")).cast("double")
    fit = after.groupBy(*keys, "peak_time").agg(
        F.regr_slope(F.ln(value), x).alias("slope"), F.count("*").alias("n_after")
    )
    life = F.when(F.col("slope") < 0, F.lit(math.log(2)) / -F.col("slope"))
    return fit.withColumn("half_life", life)


def decay_fit(
    df: DataFrame, keys: Sequence[str], time: str, value: str, tolerance: float = 1e-8, max_rounds: int = 100
) -> DataFrame:
    """Least-squares fit of asymptote + rise * exp(-rate * t) from the peak of each series on.

    For a given rate the other two are a straight line, so each round needs
    central moments of value, e = exp(-rate t) and t e per series, and moves the
    logarithm of the rate by a Gauss-Newton step; a step that raises the error
    is halved. All series go at once, and those whose step is below
    ``tolerance`` take no further part.

    Returns (keys, peak_time, n_after, asymptote, rise, rate, half_life, rmse,
    step: the last step, rounds). Series with fewer than four points or without
    a decay (steps that do not settle, a rate at a limit, no rise) have a NULL
    fit. Half-lives are looked for from 1/50 of a time unit to 50 spans.
    """
    keys = list(keys)
    peak = F.max_by(F.col(time), F.struct(F.col(value), -F.col(time)))
    df = store_and_reload(df.select(*keys, time, F.col(value).cast("double").alias(value)).dropna(subset=[time, value]), "decay-rows")
    peaks = df.groupBy(*keys).agg(peak.alias("peak_time"))
    after = join_on_keys(df, peaks, keys).filter(F.col(time) >= F.col("peak_time"))
    after = after.select(*keys, "peak_time", (F.col(time) - F.col("peak_time")).cast("double").alias("__t"), F.col(value).alias("__y"))
    after = store_and_reload(after, "decay-after")
    series = [*keys, "peak_time"]
    first = after.groupBy(*series).agg(
        F.count("*").alias("n_after"), F.max("__t").alias("__span"),
        F.regr_slope(F.when(F.col("__y") > 0, F.ln("__y")), F.col("__t")).alias("__slope"),
    )
    low, high = F.ln(F.lit(math.log(2) / 50) / F.col("__span")), F.lit(math.log(50 * math.log(2)))
    start = F.ln(F.when(F.col("__slope") < 0, -F.col("__slope")).otherwise(1 / F.col("__span")))
    start = F.least(F.greatest(start, F.col("__low")), F.col("__high"))
    first = first.filter("__span > 0").withColumns({"__low": low, "__high": high}).withColumn("__try", start)
    # best: the log rate of the least error so far; try: the one to look at; step: from best to try
    none = F.lit(None).cast("double")
    first = first.withColumns({"__best": none, "__error": none, "__step": none, "__line": F.lit(None).cast("struct<rise:double,asymptote:double>"), "rounds": F.lit(0)})
    columns = [*series, "n_after", "__low", "__high", "__try", "__best", "__error", "__step", "__line", "rounds"]
    open_, closed = first.filter("n_after > 3").select(*columns), []
    e, t, y = F.col("__e"), F.col("__t"), F.col("__y")
    for _ in range(max_rounds):
        rows = join_on_keys(after.drop("peak_time"), open_.select(*keys, "__try"), keys)
        rows = rows.withColumn("__e", F.exp(-F.exp("__try") * t)).withColumn("__u", t * e * F.exp("__try"))
        u = F.col("__u")
        sums = rows.groupBy(*keys).agg(
            F.var_pop(e).alias("ee"), F.var_pop(u).alias("uu"), F.var_pop(y).alias("yy"), F.covar_pop(e, y).alias("ey"),
            F.covar_pop(e, u).alias("eu"), F.covar_pop(u, y).alias("uy"), F.avg(e).alias("me"), F.avg(y).alias("my"),
        )
        rise = F.col("ey") / F.nullif(F.col("ee"), F.lit(0.0))
        s = join_on_keys(open_, sums, keys).withColumn("__b", rise)
        s = s.withColumns({
            "__now": F.greatest(F.col("yy") - F.col("__b") * F.col("ey"), F.lit(0.0)),
            "__newton": -(F.col("uy") - F.col("__b") * F.col("eu"))
            / F.nullif(F.col("__b") * (F.col("uu") - F.col("eu") * F.col("eu") / F.nullif(F.col("ee"), F.lit(0.0))), F.lit(0.0)),
        })
        better = F.col("__best").isNull() | (F.col("__now") <= F.col("__error"))
        move = F.when(better, F.least(F.greatest("__newton", F.lit(-1.0)), F.lit(1.0))).otherwise(F.col("__step") / 2)
        s = s.withColumn("__better", better).withColumn("__move", move)
        s = s.withColumns({
            "__best": F.when(F.col("__better"), F.col("__try")).otherwise(F.col("__best")),
            "__error": F.when(F.col("__better"), F.col("__now")).otherwise(F.col("__error")),
            "__line": F.when(F.col("__better"), F.struct(F.col("__b").alias("rise"), (F.col("my") - F.col("__b") * F.col("me")).alias("asymptote"))).otherwise(F.col("__line")),
            "__step": F.col("__move"), "rounds": F.col("rounds") + 1,
        })
        s = s.withColumn("__try", F.least(F.greatest(F.col("__best") + F.col("__step"), "__low"), "__high"))
        s = store_and_reload(s.select(*columns), "decay-round")
        settled = F.coalesce(F.abs("__step") <= tolerance, F.lit(True)) | (F.col("__try") == F.col("__best"))
        closed.append(s.filter(settled))
        open_ = s.filter(~settled)
        if open_.isEmpty():
            break
    found = closed[0]
    for part in closed[1:]:
        found = found.union(part)
    inside = (F.col("__best") > F.col("__low")) & (F.col("__best") < F.col("__high")) & (F.col("__line.rise") > 0)
    fit = found.filter(inside & (F.abs("__step") <= tolerance)).select(
        *keys, F.col("__line.asymptote").alias("asymptote"), F.col("__line.rise").alias("rise"), F.exp("__best").alias("rate"),
        (math.log(2) / F.exp("__best")).alias("half_life"), F.sqrt("__error").alias("rmse"), F.col("__step").alias("step"), "rounds",
    )
    counts = after.groupBy(*series).agg(F.count("*").alias("n_after"))
    return join_on_keys(counts, fit, keys, "left")


def token_share(counts: DataFrame, totals: DataFrame, period: str, count: str, total: str) -> DataFrame:
    """Relative frequency of a token against the total of its period."""
    return counts.join(totals, period).withColumn("share", F.col(count) / F.col(total))


def track_kinematics(df: DataFrame, track: Sequence[str], time: str, order: Sequence[str], **kw) -> DataFrame:
    """Seconds since the previous point and minutes since the start."""
    track = list(track)
    s = sequence_columns(df, track, order, lag={"__p": time}, **kw)
    sec = F.coalesce(F.unix_timestamp(time) - F.unix_timestamp("__p"), F.lit(0))
    s = s.withColumn("step_seconds", sec).drop("__p")
    s = sequence_columns(s, track, order, running={"__c": "step_seconds"}, **kw)
    return s.withColumn("minutes", F.bround(F.col("__c") / 60.0, 1)).drop("__c")


def status_matrix(
    df: DataFrame, place: str, day: str, status: str, ordinal: Column, latitude: str
) -> DataFrame:
    """Distinct place x date x status cells with the mean latitude of the place.

    Rows are combined to cells first; the mean comes from the sums of cells.
    """
    cells = df.groupBy(place, day, status).agg(
        F.sum(latitude).alias("__s"), F.count(latitude).alias("__c")
    )
    lat = with_group_totals(cells, [place], (F.sum("__s") / F.sum("__c")).alias("mean_latitude"))
    return lat.select(place, day, status, ordinal.alias("status_code"), "mean_latitude")
