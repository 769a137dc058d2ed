"""Joins (J), sorts and limits (O), set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import relational as rel
from tallyloom.operators import reshape as rs
from tallyloom.operators.sequence import sequence_columns
from tallyloom.plans.registry import query


@query(
    "J01_inner_join",
    "SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", "c_custkey", "c_mktsegment", "o_totalprice")


@query(
    "J02_left_join",
    """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
)
def _(t):
    orders = t.orders.select("o_custkey", "o_orderkey")
    return t.customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query(
    "J03_anti_join",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)",
)
def _(t):
    used = t.lineitem.filter("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(used, "p_partkey", "left_anti")


@query(
    "J04_semi_join",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)",
)
def _(t):
    picked = t.orders.filter("o_orderstatus = 'P' AND o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_acctbal").join(picked, "c_custkey", "left_semi")


@query(
    "J05_natural_join",
    "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)",
)
def _(t):
    return rel.natural_join(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"))


@query(
    "J06_parameter_grid",
    """SELECT s_suppkey, k, rate, round(s_acctbal * rate / k, 6) AS v FROM supplier, (SELECT unnest([1, 3, 5]) AS k), (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE]) AS rate)""",
)
def _(t):
    grid = rel.crossing(t.supplier.select("s_suppkey", "s_acctbal"), k=[1, 3, 5], rate=[0.1, 0.5])
    return grid.select("s_suppkey", "k", "rate", F.round(F.col("s_acctbal") * F.col("rate") / F.col("k"), 6).alias("v"))


@query(
    "J07_sum_pairs",
    """WITH c AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1)
       SELECT a.v AS a, b.v AS b, CASE WHEN a.v = b.v THEN CAST(a.n * (a.n - 1) / 2 AS BIGINT) ELSE a.n * b.n END AS n_pairs, a.v * b.v AS product
       FROM c a JOIN c b ON b.v = 60 - a.v WHERE a.v <= b.v AND (a.v < b.v OR a.n > 1)""",
)
def _(t):
    return rel.sum_pairs(t.part.select("p_size"), "p_size", 60)


@query(
    "J07_sum_triples",
    """WITH c AS (SELECT CAST(p_size AS BIGINT) AS v, count(*) AS n FROM part GROUP BY 1)
       SELECT * FROM (SELECT a.v AS a, b.v AS b, c.v AS c, CAST(CASE WHEN a.v = b.v AND b.v = c.v THEN a.n * (a.n - 1) * (a.n - 2) / 6
           WHEN a.v = b.v THEN a.n * (a.n - 1) / 2 * c.n WHEN b.v = c.v THEN a.n * (b.n * (b.n - 1) / 2) ELSE a.n * b.n * c.n END AS BIGINT) AS n_triples,
           a.v * b.v * c.v AS product FROM c a JOIN c b ON a.v <= b.v JOIN c c ON c.v = 75 - a.v - b.v AND b.v <= c.v) WHERE n_triples > 0""",
)
def _(t):
    return rel.sum_triples(t.part.select("p_size"), "p_size", 75)


@query(
    "J08_cooccurring_pairs",
    """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
       SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM m a JOIN m b USING (l_orderkey)
       WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(t):
    return rel.pair_counts(t.lineitem, "l_orderkey", "l_suppkey", min_count=2)


@query(
    "J09_dictionary_repair",
    """WITH raw AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN CAST(n_nationkey AS VARCHAR) ELSE 'unknown' END AS place
         FROM customer JOIN nation ON c_nationkey = n_nationkey),
       d AS (SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS code FROM nation)
       SELECT r.c_custkey, d2.name, d2.code FROM raw r LEFT JOIN d d1 ON r.place = d1.name JOIN d d2 ON coalesce(d1.code, r.place) = d2.code""",
)
def _(t):
    n = F.col("c_custkey") % 3
    place = F.when(n == 0, F.col("n_name")).when(n == 1, F.col("n_nationkey").cast("string")).otherwise("unknown")
    raw = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", place.alias("place"))
    dictionary = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("code"))
    return rel.dictionary_repair(raw, "place", dictionary, "name", "code").select("c_custkey", "name", "code")


@query(
    "J10_first_match_lookup",
    """SELECT c_custkey, o_totalprice AS first_price FROM customer LEFT JOIN
         (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def _(t):
    prices = t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("first_price"))
    return rel.lookup_first(t.customer.select("c_custkey"), "c_custkey", prices, "o_custkey", "first_price", ["o_orderkey"])


@query(
    "J11_bind_columns",
    """SELECT row_no, s_suppkey, p_partkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS row_no FROM supplier)
       FULL JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS row_no FROM part) USING (row_no)""",
)
def _(t):
    out = rel.bind_columns(
        t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"],
        t.part.select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"],
    )
    return out.select("row_no", "s_suppkey", "p_partkey")


@query(
    "J12_role_join",
    """WITH d AS (SELECT o_orderdate AS day, round(avg(o_totalprice), 6) AS price FROM orders GROUP BY 1),
         s AS (SELECT o_custkey, min(o_orderdate) AS open_day, max(o_orderdate) AS close_day FROM orders GROUP BY 1)
       SELECT o_custkey, open_day, close_day, a.price AS open_price, b.price AS close_price
       FROM s JOIN d a ON a.day = open_day JOIN d b ON b.day = close_day""",
)
def _(t):
    days = t.orders.groupBy(F.col("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 6).alias("price"))
    spans = t.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("open_day"), F.max("o_orderdate").alias("close_day")
    )
    return rel.role_join(spans, days, "day", {"open": "open_day", "close": "close_day"})


@query(
    "J13_id_crosswalk",
    """SELECT n_name, count(*) AS n_suppliers, round(sum(points), 2) AS points FROM (
         SELECT n_name, s_name, coalesce(sum(l_quantity), 0) AS points FROM nation JOIN supplier ON s_nationkey = n_nationkey
         LEFT JOIN lineitem ON l_suppkey = CAST(substr(s_name, 10) AS BIGINT) GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    ids = t.supplier.select("s_name", F.substring("s_name", 10, 20).cast("long").alias("src_id"))
    points = t.lineitem.groupBy(F.col("l_suppkey").alias("src_id")).agg(
        F.sum("l_quantity").alias("points")
    )
    roster = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name")
    flat = roster.join(ids, "s_name").join(points, "src_id", "left").select(
        "n_name", "s_name", F.coalesce("points", F.lit(0.0)).alias("points")
    )
    nested = rs.nest(flat, ["n_name"], ["s_name", "points"], "roster")
    total = F.aggregate("roster", F.lit(0.0), lambda s, r: s + r["points"])
    per_chunk = nested.select("n_name", F.size("roster").cast("long").alias("k"), total.alias("p"))
    return per_chunk.groupBy("n_name").agg(
        F.sum("k").alias("n_suppliers"), F.round(F.sum("p"), 2).alias("points")
    )


@query(
    "J14_successors_within",
    """WITH v AS (SELECT DISTINCT p_brand, p_size FROM part)
       SELECT a.p_brand, a.p_size AS from_value, b.p_size AS to_value FROM v a JOIN v b ON a.p_brand = b.p_brand AND b.p_size BETWEEN a.p_size + 1 AND a.p_size + 3""",
)
def _(t):
    return rel.successors_within(t.part.select("p_brand", "p_size"), ["p_brand"], "p_size", 3)


@query(
    "J14_within_previous",
    """WITH s AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part)
       SELECT a.p_brand, a.pos, a.p_size, max(b.pos) AS seen_at FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_size = b.p_size
         AND b.pos BETWEEN a.pos - 10 AND a.pos - 1 GROUP BY 1, 2, 3""",
)
def _(t):
    placed = sequence_columns(
        t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], ["p_partkey"], position="pos"
    )
    return rel.within_previous(placed, ["p_brand"], "pos", "p_size", 10)


# --- sorts and limits -------------------------------------------------------------


@query("O01_sort", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC")
def _(t):
    return t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"))


@query("O02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("O03_last_rows", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def _(t):
    return rel.last_rows(t.events.select("event_id", "ts"), 25, ["ts", "event_id"])


@query(
    "O04_top_with_ties",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem QUALIFY rank() OVER (ORDER BY l_discount DESC) <= 50",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rel.top_with_ties(rows, 50, "l_discount")


@query(
    "O05_rank_bands",
    """SELECT user_id, n, CASE WHEN r <= 10 THEN 'top 10' WHEN r <= 20 THEN 'next 10' ELSE 'others' END AS band FROM (
         SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS r FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1))""",
)
def _(t):
    counts = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return rel.rank_bands(
        counts, [F.desc("n"), F.asc("user_id")], ["user_id"], [(10, "top 10"), (20, "next 10")], "others"
    )


# --- sets ----------------------------------------------------------------------------


@query(
    "U01_union_by_name",
    """SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def _(t):
    cust = t.customer.select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    supp = t.supplier.select(
        F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id")
    )
    return rel.union_by_name([cust, supp])


@query("U02_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t.part.select("p_brand", "p_type").distinct()


@query(
    "U03_missing_ids",
    """WITH k AS (SELECT CAST(o_totalprice / 100 AS BIGINT) AS id FROM orders)
       SELECT id FROM (SELECT unnest(range((SELECT min(id) FROM k), (SELECT max(id) FROM k) + 1)) AS id) WHERE id NOT IN (SELECT id FROM k)""",
)
def _(t):
    ids = t.orders.select(F.round(F.col("o_totalprice") / 100).cast("long").alias("id"))
    return rel.missing_ids(ids, "id", chunk=500)


@query(
    "U04_dense_calendar",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
         c AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1)
       SELECT c.user_id, c.day, d.n FROM c LEFT JOIN d USING (user_id, day)""",
)
def _(t):
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rel.dense_calendar(daily, ["user_id"], "day")
