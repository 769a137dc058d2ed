"""Time series (TS rows), batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.columns import floor_minutes, level_code
from tallyloom.operators import series as ts
from tallyloom.operators import window as wn
from tallyloom.plans.registry import query
from tallyloom.streaming import buckets as sb

DAILY = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"
MONTHLY = "m AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1, 2)"
EVENT = "1998-06-01"


def daily_values(t):
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))


def monthly_prices(t):
    month = F.trunc(F.to_date("o_orderdate"), "month")
    return t.orders.groupBy("o_orderpriority", month.alias("month")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("v")
    )


@query(
    "TS01_monthly_totals",
    """SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def _(t):
    return ts.bucket_totals(
        t.orders, ["o_orderpriority"], F.trunc(F.to_date("o_orderdate"), "month"),
        total=F.round(F.sum("o_totalprice"), 2), n=F.count("*"),
    )


FRAMES = "SELECT event_type, time_bucket(INTERVAL 3 MINUTE, ts) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query("TS01_minute_frames", FRAMES)
def _(t):
    return ts.bucket_totals(
        t.events, ["event_type"], floor_minutes("ts", 3), n=F.count("*"), total=F.round(F.sum("value"), 4)
    )


@query("TS01_stream_frames", FRAMES)
def _(t):
    stream = sb.stream_table(t.spark, t.dir, "events", "ts")
    frames = sb.windowed_totals(
        stream, "ts", "3 minutes", sb.replay_delay(t.events, "ts"), ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 4)
    )
    out = sb.run_to_table(frames, "frames", keys=["bucket", "event_type"])
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


ALIGNED = """WITH e AS (SELECT event_id, user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS at FROM events)
  SELECT a.user_id, a.at, a.event_id AS click_id, b.event_id AS view_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.at = b.at - INTERVAL 2 HOUR
  WHERE a.event_type = 'click' AND b.event_type = 'view'"""


def two_sensors(ev):
    side = lambda kind, name: ev.filter(F.col("event_type") == kind).select(
        "user_id", floor_minutes("ts", 60).alias("at"), F.col("event_id").alias(name)
    )
    return side("click", "click_id"), side("view", "view_id")


@query("TS02_aligned_sensors", ALIGNED)
def _(t):
    click, view = two_sensors(t.events)
    return ts.aligned(click, view, ["user_id"], "at", "-2 hours")


@query("TS02_stream_aligned", ALIGNED)
def _(t):
    parts = []
    for kind, name in (("click", "click_id"), ("view", "view_id")):
        ev = sb.stream_table(t.spark, t.dir, "events", "ts").filter(F.col("event_type") == kind)
        parts.append(ev.select("user_id", F.date_trunc("hour", "ts").alias("at"), F.col("event_id").alias(name)))
    joined = sb.stream_aligned(parts[0], parts[1], ["user_id"], "at", "-2 hours", sb.replay_delay(t.events, "ts", "3 hours"))
    out = sb.run_to_table(joined, "aligned")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "TS03_event_flags",
    f"""WITH {DAILY}, f AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) AS "T", CASE WHEN day >= DATE '2024-01-15' THEN 1 ELSE 0 END AS "D" FROM d)
        SELECT *, CASE WHEN "D" = 1 THEN "T" - count(*) FILTER ("D" = 0) OVER (PARTITION BY event_type) ELSE 0 END AS "P" FROM f""",
)
def _(t):
    out = wn.event_flags(daily_values(t), ["event_type"], "day", F.lit("2024-01-15").cast("date"), bounded=True)
    return out.select("event_type", "day", "T", "D", "P")


ITS = f"""{MONTHLY}, f AS (SELECT o_orderpriority, month, v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) AS t FROM m),
  n AS (SELECT o_orderpriority, count(*) FILTER (month < DATE '1998-06-01') AS n0 FROM f GROUP BY 1),
  c AS (SELECT o_orderpriority, regr_intercept(v, t) FILTER (month < DATE '1998-06-01') AS b0, regr_slope(v, t) FILTER (month < DATE '1998-06-01') AS b1,
     regr_intercept(v, t - n0) FILTER (month >= DATE '1998-06-01') AS i1, regr_slope(v, t - n0) FILTER (month >= DATE '1998-06-01') AS s1,
     any_value(n0) AS n_before, count(*) - any_value(n0) AS n_after FROM f JOIN n USING (o_orderpriority) GROUP BY 1),
  its AS (SELECT o_orderpriority, b0 AS intercept, b1 AS trend, i1 - (b0 + b1 * n_before) AS level_change, s1 - b1 AS slope_change, n_before, n_after FROM c)"""
COEFS = ["intercept", "trend", "level_change", "slope_change"]


def its_fits(t):
    return ts.interrupted_fit(monthly_prices(t), ["o_orderpriority"], "month", "v", F.lit(EVENT).cast("date"))


@query(
    "TS04_interrupted_series",
    f"WITH {ITS} SELECT o_orderpriority, n_before, n_after, {', '.join(f'round({c}, 4) AS {c}' for c in COEFS)} FROM its",
)
def _(t):
    return its_fits(t).withColumns({c: F.round(c, 4) for c in COEFS})


@query(
    "TS05_interrupted_control",
    f"""WITH {ITS} SELECT {', '.join(f'round(b.{c}, 4) AS {c}, round(a.{c} - b.{c}, 4) AS {c}_by_group' for c in COEFS)}
        FROM its a JOIN its b ON a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '5-LOW'""",
)
def _(t):
    out = ts.interrupted_with_control(its_fits(t), "o_orderpriority", "1-URGENT", "5-LOW")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query(
    "TS06_change_point",
    f"""WITH {MONTHLY}, f AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) AS t, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM m),
        c AS (SELECT a.o_orderpriority, a.month, a.t,
            regr_syy(b.v, b.t) FILTER (b.t <= a.t) - pow(regr_sxy(b.v, b.t) FILTER (b.t <= a.t), 2) / regr_sxx(b.v, b.t) FILTER (b.t <= a.t)
            + regr_syy(b.v, b.t) FILTER (b.t > a.t) - pow(regr_sxy(b.v, b.t) FILTER (b.t > a.t), 2) / regr_sxx(b.v, b.t) FILTER (b.t > a.t) AS sse
          FROM f a JOIN f b USING (o_orderpriority) WHERE a.t >= 6 AND a.t <= a.n - 6 GROUP BY 1, 2, 3)
        SELECT o_orderpriority, month AS last_before, t, round(sse / 1e6, 3) AS sse FROM c QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sse, t) = 1""",
)
def _(t):
    out = ts.change_point(monthly_prices(t), ["o_orderpriority"], "month", "v", margin=6)
    return out.withColumn("sse", F.round(F.col("sse") / 1e6, 3))


@query(
    "TS07_unit_root",
    f"""WITH {MONTHLY}, l AS (SELECT o_orderpriority, v, lag(v) OVER (PARTITION BY o_orderpriority ORDER BY month) AS p FROM m),
        r AS (SELECT o_orderpriority, corr(v - p, p) AS r, count(p) AS n FROM l WHERE p IS NOT NULL GROUP BY 1)
        SELECT o_orderpriority, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t_stat FROM r""",
)
def _(t):
    out = ts.unit_root(monthly_prices(t), ["o_orderpriority"], ["month"], "v")
    return out.withColumn("t_stat", F.round("t_stat", 6))


PRICES = "p AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS v FROM orders GROUP BY 1, 2)"
PAIR = f"""{PRICES}, w AS (SELECT day, max(v) FILTER (o_orderpriority = '1-URGENT') AS a, max(v) FILTER (o_orderpriority = '5-LOW') AS b FROM p GROUP BY 1),
  x AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL), f AS (SELECT regr_slope(a, b) AS s, regr_intercept(a, b) AS i FROM x),
  res AS (SELECT day, a, b, s, i, a - (i + s * b) AS e FROM x, f)"""


def daily_prices(t):
    return t.orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(
        F.max("o_totalprice").alias("v")
    )


@query(
    "TS08_cointegration",
    f"""WITH {PAIR}, l AS (SELECT e, lag(e) OVER (ORDER BY day) AS q FROM res), r AS (SELECT corr(e - q, q) AS r, count(q) AS n FROM l WHERE q IS NOT NULL)
        SELECT n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t_stat, round(s, 8) AS slope, round(i, 4) AS intercept FROM r, f""",
)
def _(t):
    out = ts.cointegration(daily_prices(t), "o_orderpriority", "day", "v", "1-URGENT", "5-LOW")
    return out.select(
        "n", F.round("t_stat", 6).alias("t_stat"), F.round("slope", 8).alias("slope"), F.round("intercept", 4).alias("intercept")
    )


PAIRS = [("1-URGENT", "5-LOW"), ("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("3-MEDIUM", "5-LOW")]


@query(
    "TS08_cointegration_pairs",
    f"""WITH {PRICES}, k(a, b) AS (VALUES {', '.join(str(p) for p in PAIRS)}), x AS (SELECT k.a, k.b, p.day, p.v AS va, q.v AS vb FROM k JOIN p ON p.o_orderpriority = a JOIN p q ON q.o_orderpriority = b AND q.day = p.day),
        f AS (SELECT a, b, regr_slope(va, vb) AS s, regr_intercept(va, vb) AS i FROM x GROUP BY 1, 2), res AS (SELECT a, b, day, va - (i + s * vb) AS e FROM x JOIN f USING (a, b)),
        l AS (SELECT a, b, e, lag(e) OVER (PARTITION BY a, b ORDER BY day) AS q FROM res), r AS (SELECT a, b, corr(e - q, q) AS r, count(q) AS n FROM l WHERE q IS NOT NULL GROUP BY 1, 2)
        SELECT a, b, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t_stat, round(s, 8) AS slope, round(i, 4) AS intercept FROM r JOIN f USING (a, b)""",
)
def _(t):
    pairs = t.spark.createDataFrame(PAIRS, "a string, b string")
    out = ts.cointegration_of_pairs(daily_prices(t), "o_orderpriority", "day", "v", pairs)
    return out.withColumns({"t_stat": F.round("t_stat", 6), "slope": F.round("slope", 8), "intercept": F.round("intercept", 4)})


TRADES = f"""{PAIR}, g AS (SELECT 1.5 * stddev_samp(e) AS band FROM res), l AS (SELECT day, e, lag(e) OVER (ORDER BY day) AS q, band FROM res, g),
  ops AS (SELECT day, 'short' AS side, CASE WHEN q < band AND e >= band THEN 'short_start' WHEN q > 0 AND e <= 0 THEN 'short_stop' END AS op FROM l
    UNION ALL SELECT day, 'long', CASE WHEN q > -band AND e <= -band THEN 'long_start' WHEN q < 0 AND e >= 0 THEN 'long_stop' END FROM l),
  k AS (SELECT * FROM (SELECT *, lag(op) OVER (PARTITION BY side ORDER BY day) AS po FROM ops WHERE op IS NOT NULL) WHERE po IS DISTINCT FROM op),
  n AS (SELECT *, lead(op) OVER (ORDER BY day, op) AS nop, lead(day) OVER (ORDER BY day, op) AS nday FROM k),
  trades AS (SELECT replace(op, '_start', '') AS operation, day AS open, nday AS close, CAST(nday - day AS INTEGER) AS days FROM n
    WHERE (op = 'short_start' AND nop = 'short_stop') OR (op = 'long_start' AND nop = 'long_stop'))"""


def pair(t):
    return ts.pair_residuals(daily_prices(t), "o_orderpriority", "day", "v", "1-URGENT", "5-LOW")


@query("TS09_trades", f"WITH {TRADES} SELECT * FROM trades")
def _(t):
    return ts.pair_trades(pair(t), "day", 1.5)


@query(
    "TS10_trade_returns",
    f"""WITH {TRADES}, z AS (SELECT operation, open, close, round_even(1e6 / o.a, 0) AS va, round_even(1e6 / o.b, 0) AS vb, o.a AS oa, o.b AS ob, c.a AS ca, c.b AS cb
          FROM trades JOIN x o ON o.day = open JOIN x c ON c.day = close),
        q AS (SELECT operation, open, close, round_even(CASE WHEN operation = 'short' THEN va * oa - vb * ob ELSE vb * ob - va * oa END, 2) AS entry,
          round_even(CASE WHEN operation = 'short' THEN vb * cb - va * ca ELSE va * ca - vb * cb END, 2) AS exit FROM z)
        SELECT operation, open, close, entry, exit, round((exit - entry) / 2e6, 10) AS ret FROM q""",
)
def _(t):
    res = pair(t)
    out = ts.trade_returns(ts.pair_trades(res, "day", 1.5), res, "day", 2e6)
    return out.select("operation", "open", "close", "entry", "exit", F.round("ret", 10).alias("ret"))


@query(
    "TS11_impute_gaps",
    """WITH d AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, round(sum(value), 2) AS v FROM events GROUP BY 1, 2, 3),
         c AS (SELECT event_type, user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1, 2),
         g AS (SELECT c.event_type, c.user_id, c.day FROM c ANTI JOIN d USING (event_type, user_id, day)),
         n AS (SELECT g.event_type, g.user_id, g.day, d.v FROM g JOIN d USING (event_type, user_id)
               QUALIFY row_number() OVER (PARTITION BY g.event_type, g.user_id, g.day ORDER BY abs(g.day - d.day), d.day) <= 5)
       SELECT event_type, user_id, day, round(v, 6) AS v, FALSE AS imputed FROM d
       UNION ALL SELECT event_type, user_id, day, round(avg(v), 6), TRUE FROM n GROUP BY 1, 2, 3""",
)
def _(t):
    daily = t.events.groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("v"))
    return ts.impute_gaps(daily, ["event_type", "user_id"], "day", "v").withColumn("v", F.round("v", 6))


@query(
    "TS12_trend_forecast",
    f"""WITH {DAILY}, b AS (SELECT event_type, day, v, (day - DATE '2000-01-01')::DOUBLE AS t, dayofweek(day) AS w FROM d),
        tr AS (SELECT * FROM b WHERE day < DATE '2024-01-24'), f AS (SELECT event_type, regr_slope(v, t) AS sl, regr_intercept(v, t) AS ic FROM tr GROUP BY 1),
        e AS (SELECT event_type, w, v - (ic + sl * t) AS e FROM tr JOIN f USING (event_type)), wd AS (SELECT event_type, w, avg(e) AS we FROM e GROUP BY 1, 2),
        sd AS (SELECT event_type, stddev_samp(e - we) AS sd FROM e JOIN wd USING (event_type, w) GROUP BY 1),
        fu AS (SELECT event_type, CAST(unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day FROM f),
        o AS (SELECT fu.event_type, fu.day, ic + sl * (fu.day - DATE '2000-01-01') + coalesce(we, 0) AS fc, sd FROM fu JOIN f USING (event_type) JOIN sd USING (event_type)
              LEFT JOIN wd ON wd.event_type = fu.event_type AND wd.w = dayofweek(fu.day))
        SELECT o.event_type, o.day, round(fc, 4) AS forecast, round(fc - 1.2815515655446004 * sd, 4) AS lo80, round(fc + 1.2815515655446004 * sd, 4) AS hi80,
          round(fc - 1.959963984540054 * sd, 4) AS lo95, round(fc + 1.959963984540054 * sd, 4) AS hi95, d.v AS actual FROM o LEFT JOIN d USING (event_type, day)""",
)
def _(t):
    out = ts.trend_weekday_forecast(
        daily_values(t), ["event_type"], "day", "v", F.lit("2024-01-24").cast("date"), 7
    )
    return out.withColumns({c: F.round(c, 4) for c in ("forecast", "lo80", "hi80", "lo95", "hi95")})


@query(
    "TS13_decay_half_life",
    """WITH d AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY 1, 2),
         p AS (SELECT user_id, arg_min(day, (-n, day)) AS peak_time FROM d GROUP BY 1),
         f AS (SELECT user_id, peak_time, regr_slope(ln(n), (day - peak_time)::DOUBLE) AS s, count(*) AS n_after FROM d JOIN p USING (user_id) WHERE day >= peak_time GROUP BY 1, 2)
       SELECT user_id, peak_time, n_after, CASE WHEN n_after > 1 AND s < -1e-9 THEN round(ln(2.0) / -s, 4) END AS half_life FROM f""",
)
def _(t):
    daily = t.events.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("n"))
    out = ts.decay_half_life(daily, ["user_id"], "day", "n")
    life = F.when(F.col("slope") < -1e-9, F.round("half_life", 4))
    return out.select("user_id", "peak_time", "n_after", life.alias("half_life"))


FALL = 10  # width of a bin of event values; their counts fall off


def _least_error(name: str, before: str, step: float) -> str:
    """Log rates around those in ``before``, 150 steps to either side, and the one of least error per series."""
    return f"""{name} AS (SELECT event_type, arg_min(g, err) AS g FROM (
           SELECT event_type, g, regr_syy(n, exp(-exp(g) * t)) - pow(regr_sxy(n, exp(-exp(g) * t)), 2) / regr_sxx(n, exp(-exp(g) * t)) AS err
           FROM (SELECT event_type, g + i * {step} AS g FROM {before}, range(-150, 151) r(i)) JOIN f USING (event_type) GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "TS13_decay_fit",
    f"""WITH d AS (SELECT event_type, CAST(floor(value / {FALL}) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
         p AS (SELECT event_type, arg_min(bin, (-n, bin)) AS peak_time FROM d GROUP BY 1),
         f AS (SELECT event_type, peak_time, (bin - peak_time)::DOUBLE AS t, n::DOUBLE AS n FROM d JOIN p USING (event_type) WHERE bin >= peak_time),
         g0 AS (SELECT event_type, -1.5::DOUBLE AS g FROM p), {_least_error("g1", "g0", 0.02)}, {_least_error("g2", "g1", 0.0002)}, {_least_error("g3", "g2", 0.000002)}
       SELECT event_type, any_value(peak_time) AS peak_time, count(*) AS n_after, round(ln(2.0) / exp(any_value(g)), 3) AS half_life,
         round(regr_intercept(n, exp(-exp(g) * t)), 1) AS asymptote, round(regr_slope(n, exp(-exp(g) * t)), 1) AS rise
       FROM f JOIN g3 USING (event_type) GROUP BY 1""",
)
def _(t):
    bins = t.events.groupBy("event_type", F.floor(F.col("value") / FALL).alias("bin")).agg(F.count("*").alias("n"))
    out = ts.decay_fit(bins, ["event_type"], "bin", "n")
    rounded = [F.round(c, d).alias(c) for c, d in (("half_life", 3), ("asymptote", 1), ("rise", 1))]
    return out.select("event_type", "peak_time", "n_after", *rounded)


@query(
    "TS14_token_share",
    """WITH t AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total FROM events GROUP BY 1), c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT day, event_type, n, total, round(n / total, 8) AS share FROM c JOIN t USING (day)""",
)
def _(t):
    day = F.to_date("ts").alias("day")
    totals = t.events.groupBy(day).agg(F.count("*").alias("total"))
    counts = t.events.groupBy(day, "event_type").agg(F.count("*").alias("n"))
    return ts.token_share(counts, totals, "day", "n", "total").withColumn("share", F.round("share", 8))


@query(
    "TS15_track_kinematics",
    """WITH s AS (SELECT event_id, user_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS x FROM events),
         g AS (SELECT event_id, user_id, ts, coalesce(x - lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS step_seconds FROM s)
       SELECT event_id, step_seconds, round_even(sum(step_seconds) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 60.0::DOUBLE, 1) AS minutes FROM g""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", "ts")
    out = ts.track_kinematics(rows, ["user_id"], "ts", ["ts", "event_id"])
    return out.select("event_id", "step_seconds", "minutes")


@query(
    "TS16_status_matrix",
    """SELECT DISTINCT n_name AS place, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status,
         CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 END AS INTEGER) AS status_code, lat AS mean_latitude
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS lat FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON k = c_nationkey""",
)
def _(t):
    rows = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("place"), F.to_date("o_orderdate").alias("day"),
                F.col("o_orderstatus").alias("status"), F.col("c_acctbal").alias("lat"))
    )
    out = ts.status_matrix(rows, "place", "day", "status", level_code("status", ["O", "P", "F"]), "lat")
    return out.withColumn("mean_latitude", F.round("mean_latitude", 4))
