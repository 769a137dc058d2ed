"""Aggregations (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.columns import level_code
from tallyloom.operators import aggregate as ag
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.plans.registry import query

GUESS = """(SELECT quality AS truth, CASE WHEN n_chars >= 1000 AND toxic = 0 THEN 1 ELSE 0 END AS guess
            FROM labels JOIN documents USING (doc_id))"""


def guesses(t):
    guess = F.when((F.col("n_chars") >= 1000) & (F.col("toxic") == 0), 1).otherwise(0)
    docs = t.documents.select("doc_id", "n_chars")
    return t.labels.join(docs, "doc_id").select(F.col("quality").alias("truth"), guess.alias("guess"))


@query("A01_counts", "SELECT l_shipdate, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    return t.lineitem.groupBy("l_shipdate", "l_returnflag").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(
    "A02_basic_summaries",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
              round(avg(l_quantity), 6) AS avg_qty, min(l_discount) AS min_disc, max(l_extendedprice) AS max_price, count(*) AS n
       FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.min("l_discount").alias("min_disc"),
        F.max("l_extendedprice").alias("max_price"),
        F.count("*").alias("n"),
    )


@query(
    "A03_spread",
    """SELECT event_type, round(var_samp(value), 5) AS variance, round(stddev_samp(value), 6) AS sd, round(sqrt(var_samp(value) / count(value)), 6) AS std_error
       FROM events GROUP BY 1""",
)
def _(t):
    return t.events.groupBy("event_type").agg(
        F.round(F.var_samp("value"), 5).alias("variance"),
        F.round(F.stddev_samp("value"), 6).alias("sd"),
        F.round(ag.standard_error("value"), 6).alias("std_error"),
    )


@query(
    "A04_six_numbers",
    """SELECT l_returnflag, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
              round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS max FROM lineitem GROUP BY 1""",
)
def _(t):
    out = ag.six_numbers(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "mean")})


@query("A05_quantile", "SELECT round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders")
def _(t):
    out = exact_quantiles(t.orders.select("o_totalprice"), [], "o_totalprice", {"p10": 0.1, "p99": 0.99})
    return out.select(*[F.round(c, 4).alias(c) for c in ("p10", "p99")])


@query(
    "A06_distinct_sum",
    "SELECT l_returnflag, CAST(sum(k) AS BIGINT) AS total FROM (SELECT l_returnflag, l_suppkey, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def _(t):
    per = ag.distinct_per_group(t.lineitem, ["l_returnflag", "l_suppkey"], "l_partkey", "k")
    return per.groupBy("l_returnflag").agg(F.sum("k").alias("total"))


@query(
    "A07_held_by_all",
    """WITH f AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(month(l_shipdate) AS INTEGER) AS mon, l_suppkey FROM lineitem),
         m AS (SELECT yr, count(DISTINCT mon) AS n_members FROM f GROUP BY 1)
       SELECT yr, l_suppkey, n_members FROM (SELECT yr, l_suppkey, count(*) AS n FROM f GROUP BY 1, 2) JOIN m USING (yr) WHERE n = n_members""",
)
def _(t):
    facts = t.lineitem.select(F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mon"), "l_suppkey")
    return ag.held_by_all(facts, "yr", "mon", "l_suppkey")


@query(
    "A08_conditional_counts",
    "SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS high, count(*) FILTER (l_tax = 0) AS untaxed FROM lineitem GROUP BY 1",
)
def _(t):
    conds = {"high": F.col("l_discount") > 0.05, "untaxed": F.col("l_tax") == 0}
    return t.lineitem.groupBy("l_returnflag").agg(*ag.count_where(conds))


@query(
    "A09_product",
    "SELECT l_orderkey, round(product(1 + l_tax), 8) AS factor FROM lineitem GROUP BY 1",
)
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.product(1 + F.col("l_tax")), 8).alias("factor"))


@query(
    "A10_weighted_score",
    """SELECT user_id, count(*) AS total, round(sum(CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END) /
         sum(CASE WHEN event_type <> 'signup' THEN 1 END), 6) AS score FROM events GROUP BY 1""",
)
def _(t):
    tally = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("votes"))
    coded = tally.withColumn("code", level_code("event_type", ["error", "view", "click", "purchase"]))
    return ag.weighted_score(coded, ["user_id"], "code", "votes").withColumn("score", F.round("score", 6))


@query("A11_add_group_count", "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(t):
    return ag.add_group_count(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("A12_most_frequent", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 1")
def _(t):
    return ag.most_frequent(t.lineitem, "l_suppkey")


@query("A13_confusion_counts", f"SELECT truth, guess, count(*) AS n FROM {GUESS} GROUP BY 1, 2")
def _(t):
    return ag.confusion_counts(guesses(t), "truth", "guess")


@query(
    "A13_confusion_summary",
    f"""WITH g AS {GUESS}, c AS (SELECT count(*) AS n, avg((truth = guess)::INT) AS acc, avg(truth) AS t1, avg(guess) AS g1 FROM g)
        SELECT n, round(acc, 6) AS accuracy, round((acc - (t1 * g1 + (1 - t1) * (1 - g1))) / (1 - (t1 * g1 + (1 - t1) * (1 - g1))), 6) AS kappa,
               round(greatest(t1, 1 - t1), 6) AS no_information_rate FROM c""",
)
def _(t):
    out = ag.confusion_summary(ag.confusion_counts(guesses(t), "truth", "guess"), "truth", "guess")
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "kappa", "no_information_rate")})


@query(
    "A13_worst_confusions",
    f"""SELECT truth, guess, count(*) AS n FROM {GUESS} WHERE truth <> guess GROUP BY 1, 2 QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1""",
)
def _(t):
    return ag.worst_confusions(ag.confusion_counts(guesses(t), "truth", "guess"), "truth", "guess")


@query(
    "A14_mean_vectors",
    """SELECT label, dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2""",
)
def _(t):
    cents = ag.mean_vectors(t.embeddings, ["label"], "embedding")
    long = cents.select("label", F.posexplode("centroid").alias("dim", "mean"))
    return long.withColumn("mean", F.round("mean", 6))


@query(
    "A15_sum_vectors",
    """SELECT label, dim, round(sum(x), 6) AS total FROM (SELECT label, unnest(range(64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2""",
)
def _(t):
    rows = t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("e"))
    return ag.sum_vectors(rows, ["label"], "e").withColumn("total", F.round("total", 6))


@query(
    "A16_radius_counts",
    """WITH p AS (SELECT l_quantity AS x, l_discount * 500 AS y, l_tax * 500 AS z FROM lineitem),
         r AS (SELECT unnest(range(1, 61))::INTEGER AS radius),
         d AS (SELECT sqrt(pow(x - 25, 2)) AS d1, sqrt(pow(x - 25, 2) + pow(y - 25, 2)) AS d2,
                      sqrt(pow(x - 25, 2) + pow(y - 25, 2) + pow(z - 25, 2)) AS d3 FROM p)
       SELECT 1 AS dims, radius, count(*) FILTER (d1 <= radius) AS points FROM d, r GROUP BY 2
       UNION ALL SELECT 2, radius, count(*) FILTER (d2 < radius) FROM d, r GROUP BY 2
       UNION ALL SELECT 3, radius, count(*) FILTER (d3 < radius) FROM d, r GROUP BY 2""",
)
def _(t):
    p = t.lineitem.select(
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y"), (F.col("l_tax") * 500).alias("z")
    )
    return ag.radius_counts(p, ["x", "y", "z"], 25.0, 60)


@query(
    "A17_histogram",
    """SELECT l_returnflag, CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 41
         ELSE CAST(floor(l_extendedprice / 100000 * 40) + 1 AS INTEGER) END AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return ag.histogram(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.0, 100000.0, 40)


@query(
    "A17_histogram_log",
    """SELECT CASE WHEN x < 3 THEN 0 WHEN x >= 6 THEN 31 ELSE CAST(floor((x - 3) / 3 * 30) + 1 AS INTEGER) END AS bin, count(*) AS n
       FROM (SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0) GROUP BY 1""",
)
def _(t):
    return ag.histogram(t.orders, [], "o_totalprice", 3.0, 6.0, 30, log10=True)


BOX = """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)"""


@query(
    "A18_box_stats",
    f"""WITH {BOX} SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
          max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3""",
)
def _(t):
    out = ag.box_stats(t.events.select("event_type", "value"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    "A18_box_outliers",
    f"""WITH {BOX} SELECT event_id, event_type, value FROM events JOIN q USING (event_type)
        WHERE value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def _(t):
    return ag.box_outliers(t.events.select("event_id", "event_type", "value"), ["event_type"], "value")


@query(
    "A19_central_intervals",
    """SELECT event_type, 0.5::DOUBLE AS width, round(quantile_cont(value, 0.25), 6) AS low, round(quantile_cont(value, 0.75), 6) AS high FROM events GROUP BY 1
       UNION ALL SELECT event_type, 0.95::DOUBLE, round(quantile_cont(value, 0.025), 6), round(quantile_cont(value, 0.975), 6) FROM events GROUP BY 1""",
)
def _(t):
    out = ag.central_intervals(t.events.select("event_type", "value"), ["event_type"], "value", [0.5, 0.95])
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query(
    "A20_density_grid",
    """WITH h AS (SELECT l_returnflag, CAST(floor(l_quantity / 51 * 51) + 1 AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 51 GROUP BY 1, 2),
         g AS (SELECT unnest(range(1, 52)) AS g), tot AS (SELECT l_returnflag, sum(n) AS t FROM h GROUP BY 1)
       SELECT l_returnflag, g - 0.5::DOUBLE AS x, round(sum(n * exp(-0.5 * pow((g - bin) / 2.0, 2)) / (2.0 * 2.5066282746310002)) / any_value(t), 8) AS density
       FROM h JOIN tot USING (l_returnflag), g GROUP BY 1, 2""",
)
def _(t):
    out = ag.density_grid(t.lineitem, ["l_returnflag"], "l_quantity", 0.0, 51.0, 51, 2.0)
    return out.withColumn("density", F.round("density", 8))
