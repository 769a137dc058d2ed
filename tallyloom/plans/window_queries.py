"""Ordered-series operators (W rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.core import with_group_totals
from tallyloom.operators import aggregate as ag
from tallyloom.operators import relational as rel
from tallyloom.operators import window as wn
from tallyloom.operators.sequence import sequence_columns
from tallyloom.plans.registry import query

EV = ["user_id", "ts", "event_id", "value"]
BRAND_SIZES = "(SELECT p_brand, p_partkey, p_size FROM part)"


def user_events(t, *more):
    return t.events.select(*EV, *more)


@query(
    "W01_neighbours",
    """SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(t):
    out = sequence_columns(
        user_events(t), ["user_id"], ["ts", "event_id"], lag={"before": "value"}, lead={"after": "value"}
    )
    return out.select("event_id", "before", "after")


@query(
    "W02_differences",
    """SELECT event_id, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS diff FROM events""",
)
def _(t):
    out = wn.differences(user_events(t), ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", F.round("diff", 6).alias("diff"))


@query(
    "W03_running_total",
    """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = sequence_columns(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], running={"total": "o_totalprice"})
    return out.select("o_orderkey", F.round("total", 2).alias("total"))


@query(
    "W04_row_numbers",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS pos FROM orders",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    out = sequence_columns(rows, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], position="pos")
    return out.select("o_orderkey", "pos")


@query(
    "W05_share_of_group",
    """SELECT p_brand, p_type, n, round(n / sum(n) OVER (PARTITION BY p_brand), 8) AS share FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)""",
)
def _(t):
    counts = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return ag.share_of_group(counts, ["p_brand"], "n").withColumn("share", F.round("share", 8))


@query(
    "W06_group_maximum_rows",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) = 1",
)
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return wn.group_maximum_rows(rows, ["l_suppkey"], "l_quantity")


@query(
    "W07_half_life",
    """WITH d AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY 1, 2),
         s AS (SELECT user_id, min(day) AS first_day FROM d GROUP BY 1),
         p AS (SELECT user_id, max(n) AS peak, arg_min(day, (-n, day)) AS peak_time FROM d GROUP BY 1),
         h AS (SELECT user_id, first_day, peak, peak_time, min(day) AS half_time FROM d JOIN p USING (user_id) JOIN s USING (user_id)
               WHERE day >= peak_time AND n <= peak / 2 GROUP BY 1, 2, 3, 4)
       SELECT *, half_time - peak_time AS half_life_from_peak, half_time - first_day AS half_life_from_key FROM h""",
)
def _(t):
    daily = t.events.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("n"))
    keyed = with_group_totals(daily, ["user_id"], F.min("day").alias("first_day"))
    return wn.half_life(keyed, ["user_id"], "day", "n", key_time="first_day")


@query(
    "W08_top_n_ties",
    """SELECT * FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)
       QUALIFY rank() OVER (PARTITION BY o_orderpriority ORDER BY n DESC) <= 5""",
)
def _(t):
    counts = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return rel.top_per_group_with_ties(counts, ["o_orderpriority"], "n", 5)


@query(
    "W09_first_n",
    """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3""",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    out = rel.top_per_group(rows, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)
    return out.drop("o_orderdate")


@query(
    "W10_plot_rank",
    """SELECT p_brand, p_partkey, CAST(11 - rn AS INTEGER) AS plot_rank FROM (SELECT p_brand, p_partkey,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 10""",
)
def _(t):
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice")
    by = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return wn.plot_rank(rows, ["p_brand"], by, 10, "plot_rank").drop("p_retailprice")


@query(
    "W11_table_limits",
    """WITH s AS (SELECT avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS sd FROM supplier)
       SELECT s_suppkey, round(m, 6) AS mean, round(sd, 6) AS sd, round(m - 2 * sd, 6) AS lower, round(m + 2 * sd, 6) AS upper FROM supplier, s""",
)
def _(t):
    out = wn.with_limits(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal")
    return out.drop("s_acctbal").withColumns({c: F.round(c, 6) for c in ("mean", "sd", "lower", "upper")})


@query(
    "W12_not_sum_of_previous",
    f"""WITH s AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM {BRAND_SIZES})
       SELECT p_brand, pos, p_size FROM s x WHERE pos > 6 AND NOT EXISTS (SELECT 1 FROM s a JOIN s b ON a.p_brand = b.p_brand
         WHERE a.p_brand = x.p_brand AND a.pos BETWEEN x.pos - 6 AND x.pos - 1 AND b.pos BETWEEN x.pos - 6 AND x.pos - 1
           AND a.p_size + b.p_size = x.p_size AND a.p_size <> b.p_size)""",
)
def _(t):
    rows = t.part.select("p_brand", "p_partkey", "p_size")
    return wn.not_sum_of_previous(rows, ["p_brand"], ["p_partkey"], "p_size", 6)


@query(
    "W13_runs_with_sum",
    f"""WITH c AS (SELECT p_brand, p_size, row_number() OVER w AS pos, sum(p_size) OVER w AS s FROM {BRAND_SIZES}
           WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)),
       r AS (SELECT a.p_brand, a.pos AS first_pos, b.pos AS last_pos FROM c a JOIN c b ON a.p_brand = b.p_brand AND b.s = a.s - a.p_size + 100 WHERE b.pos > a.pos)
       SELECT r.p_brand, first_pos, last_pos, min(p_size) AS min_value, max(p_size) AS max_value, min(p_size) + max(p_size) AS min_plus_max
       FROM r JOIN c ON c.p_brand = r.p_brand AND c.pos BETWEEN first_pos AND last_pos GROUP BY 1, 2, 3""",
)
def _(t):
    rows = t.part.select("p_brand", "p_partkey", "p_size")
    return wn.runs_with_sum(rows, ["p_brand"], ["p_partkey"], "p_size", 100)


SPREAD = """d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2),
  m AS (SELECT event_type, CAST(floor(avg(cents)) AS BIGINT) AS mean, CAST(floor(stddev_samp(cents)) AS BIGINT) AS band FROM d GROUP BY 1),
  s AS (SELECT event_type, day, cents - mean AS dev, band FROM d JOIN m USING (event_type)),
  l AS (SELECT *, lag(dev) OVER (PARTITION BY event_type ORDER BY day) AS p FROM s),
  ops AS (SELECT event_type, day, 'short' AS side, CASE WHEN p < band AND dev >= band THEN 'short_start' WHEN p > 0 AND dev <= 0 THEN 'short_stop' END AS op FROM l
    UNION ALL SELECT event_type, day, 'long', CASE WHEN p > -band AND dev <= -band THEN 'long_start' WHEN p < 0 AND dev >= 0 THEN 'long_stop' END FROM l)"""


def spread_series(t):
    cents = F.round(F.col("value") * 100).cast("long")
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum(cents).alias("cents"))
    stats = with_group_totals(
        daily, ["event_type"], F.floor(F.avg("cents")).alias("mean"), F.floor(F.stddev_samp("cents")).alias("band")
    )
    return stats.select("event_type", "day", (F.col("cents") - F.col("mean")).alias("dev"), "band", F.lit(0).alias("mid"))


def spread_ops(t):
    return wn.crossings(spread_series(t), ["event_type"], ["day"], "dev", "band", "mid", bounded=True)


@query("W14_crossings", f"WITH {SPREAD} SELECT * FROM ops WHERE op IS NOT NULL")
def _(t):
    return spread_ops(t).select("event_type", "day", "side", "op")


KEPT = """k AS (SELECT * FROM (SELECT *, lag(op) OVER (PARTITION BY event_type, side ORDER BY day) AS po FROM ops WHERE op IS NOT NULL) WHERE po IS DISTINCT FROM op)"""


@query("W15_drop_repeats", f"WITH {SPREAD}, {KEPT} SELECT event_type, day, side, op FROM k")
def _(t):
    ops = spread_ops(t).select("event_type", "day", "side", "op")
    return wn.drop_repeats(ops, ["event_type", "side"], ["day"], "op", bounded=True)


@query(
    "W16_intervals",
    f"""WITH {SPREAD}, {KEPT}, n AS (SELECT *, lead(op) OVER w AS nop, lead(day) OVER w AS nday FROM k WINDOW w AS (PARTITION BY event_type ORDER BY day, op))
        SELECT event_type, replace(op, '_start', '') AS operation, day AS open, nday AS close, CAST(nday - day AS INTEGER) AS days FROM n
        WHERE (op = 'short_start' AND nop = 'short_stop') OR (op = 'long_start' AND nop = 'long_stop')""",
)
def _(t):
    ops = spread_ops(t).select("event_type", "day", "side", "op")
    kept = wn.drop_repeats(ops, ["event_type", "side"], ["day"], "op", bounded=True)
    return wn.start_stop_intervals(kept, ["event_type"], ["day", "op"], "day", "op", bounded=True)


@query(
    "W17_chain_arrangements",
    """WITH RECURSIVE v AS (SELECT DISTINCT p_brand, p_size FROM part), top AS (SELECT p_brand, max(p_size) AS m FROM v GROUP BY 1),
         walk(p_brand, x, a, b, c) AS (SELECT p_brand, 0, 1::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM top
           UNION ALL SELECT w.p_brand, w.x + 1, CASE WHEN v.p_size IS NULL THEN 0 ELSE a + b + c END, a, b FROM walk w
             JOIN top USING (p_brand) LEFT JOIN v ON v.p_brand = w.p_brand AND v.p_size = w.x + 1 WHERE w.x < top.m)
       SELECT p_brand, a AS arrangements FROM walk JOIN top USING (p_brand) WHERE x = m""",
)
def _(t):
    return wn.chain_arrangements(t.part.select("p_brand", "p_size"), ["p_brand"], "p_size")


@query(
    "W18_top_groups",
    """WITH g AS (SELECT o_custkey, count(*) AS group_total FROM orders GROUP BY 1), k AS (SELECT * FROM g QUALIFY dense_rank() OVER (ORDER BY group_total DESC) <= 3)
       SELECT o_orderkey, o_custkey, CAST(group_total AS BIGINT) AS group_total FROM orders JOIN k USING (o_custkey)""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.lit(1).alias("one"))
    return wn.top_groups(rows, "o_custkey", "one", 3).select("o_orderkey", "o_custkey", "group_total")
