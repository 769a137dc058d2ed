"""Scalar function families (X rows) and function mapping (F rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyloom.core import spread
from tallyloom.functions import columns as fc
from tallyloom.operators import apply as ap
from tallyloom.operators.reshape import nest
from tallyloom.plans.registry import query


@query(
    "X01_regex_family",
    r"""SELECT page_id, regexp_matches(url, '^https') AS secure, nullif(regexp_extract(url, '[0-9]+', 0), '') AS digits, len(regexp_extract_all(url, '[aeiou]')) AS vowels,
          regexp_replace(url, '[aeiou]', '_') AS first_masked, regexp_replace(url, '[aeiou]', '', 'g') AS removed FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id",
        F.col("url").rlike("^https").alias("secure"),
        F.regexp_substr("url", F.lit("[0-9]+")).alias("digits"),
        F.regexp_count("url", F.lit("[aeiou]")).cast("long").alias("vowels"),
        F.regexp_replace("url", "^([^aeiou]*)[aeiou]", "$1_").alias("first_masked"),
        F.regexp_replace("url", "[aeiou]", "").alias("removed"),
    )


@query(
    "X02_text_family",
    """SELECT c_custkey, substr(c_name, 10, 4) AS part, split_part(c_name, '#', 1) AS head, upper(lower(trim('  ' || c_mktsegment || ' '))) AS segment,
          CAST(length(c_name) AS INTEGER) AS len, concat_ws('/', c_mktsegment, c_name) AS joined FROM customer""",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        F.substring("c_name", 10, 4).alias("part"),
        fc.split_part_or_null("c_name", "#", 0).alias("head"),
        F.upper(F.lower(F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))))).alias("segment"),
        F.length("c_name").alias("len"),
        F.concat_ws("/", "c_mktsegment", "c_name").alias("joined"),
    )


@query(
    "X02_collapse_text",
    "SELECT p_brand, string_agg(p_type, '|' ORDER BY p_type) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY 1",
)
def _(t):
    kinds = t.part.select("p_brand", "p_type").distinct()
    return kinds.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_type")), "|").alias("types"))


@query(
    "X03_numbers_in_text",
    """SELECT o_orderkey, o_totalprice AS parsed, round(o_totalprice / 100, 8) AS pct, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level FROM orders""",
)
def _(t):
    money = F.concat(F.lit("R$ "), F.format_number("o_totalprice", 2), F.lit(" net"))
    percent = F.concat(F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ","), F.lit("%"))
    return t.orders.select(
        "o_orderkey",
        fc.parse_number(money).alias("parsed"),
        F.round(fc.parse_percent(percent), 8).alias("pct"),
        fc.parse_number("o_orderpriority").alias("level"),
    )


@query(
    "X04_date_parsing",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dmy, CAST(o_orderdate AS DATE) AS ymd, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_seconds, CAST(NULL AS DATE) AS bad FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        fc.day_month_year(F.date_format("o_orderdate", "d/M/yyyy")).alias("dmy"),
        F.try_to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ymd"),
        F.unix_timestamp(F.timestamp_seconds(F.unix_timestamp("o_orderdate"))).alias("epoch_seconds"),
        fc.day_month_year(F.concat(F.lit("99/99/"), F.col("o_orderkey").cast("string"))).alias("bad"),
    )


@query(
    "X05_date_arithmetic",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderdate - INTERVAL 2 HOUR AS earlier, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS days,
         CAST(CAST(o_orderdate AS DATE) + 31 AS DATE) AS later FROM orders""",
)
def _(t):
    day = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.trunc(day, "month").alias("month"),
        (F.col("o_orderdate") - F.expr("interval 2 hours")).alias("earlier"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
        F.date_add(day, 31).alias("later"),
    )


@query(
    "X05_three_minute_floor",
    "SELECT event_id, time_bucket(INTERVAL 3 MINUTE, ts) AS frame FROM events",
)
def _(t):
    return t.events.select("event_id", fc.floor_minutes("ts", 3).alias("frame"))


@query(
    "X06_maths",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity), 8) AS root, round(abs(l_discount - l_tax), 8) AS gap, round(exp(-l_tax), 8) AS e, round(ln(l_quantity), 8) AS log, round(sin(l_quantity), 8) AS sine,
          CAST(l_quantity AS BIGINT) % 7 AS rest, xor(CAST(l_quantity AS BIGINT), l_partkey) AS bits, round_even(l_quantity / 4, 0) AS half_even, pow(l_quantity, 2) AS square FROM lineitem""",
)
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(F.sqrt(q), 8).alias("root"),
        F.round(F.abs(F.col("l_discount") - F.col("l_tax")), 8).alias("gap"),
        F.round(F.exp(-F.col("l_tax")), 8).alias("e"),
        F.round(F.ln(q), 8).alias("log"),
        F.round(F.sin(q), 8).alias("sine"),
        (q.cast("long") % 7).alias("rest"),
        q.cast("long").bitwiseXOR(F.col("l_partkey")).alias("bits"),
        F.bround(q / 4, 0).alias("half_even"),
        F.pow(q, F.lit(2.0)).alias("square"),
    )


@query(
    "X07_centre_distance",
    """SELECT vec_id, round(sqrt(pow(a - 0.5, 2) + pow(b - 0.5, 2) + pow(c - 0.5, 2)), 8) AS distance, sqrt(pow(a - 0.5, 2) + pow(b - 0.5, 2) + pow(c - 0.5, 2)) < 0.8 AS inside
       FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)""",
)
def _(t):
    cols = [F.get("embedding", i).cast("double") for i in range(3)]
    d = fc.centre_distance(cols, 0.5)
    return t.embeddings.select("vec_id", F.round(d, 8).alias("distance"), (d < 0.8).alias("inside"))


@query(
    "X08_degree_text",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round((event_id % 90) / 1.0::DOUBLE, 6) ELSE
          round((CASE WHEN event_id % 3 = 1 THEN -1 ELSE 1 END) * ((event_id % 90) + (event_id % 60) / 60.0::DOUBLE + ((event_id % 50) + 0.5::DOUBLE) / 3600.0), 6) END AS degrees FROM events""",
)
def _(t):
    e = F.col("event_id")
    dms = F.format_string("%d°%d'%d.5\"", e % 90, e % 60, e % 50)
    text = (
        F.when(e % 3 == 0, F.concat((e % 90).cast("string"), F.lit(".0")))
        .when(e % 3 == 1, F.concat(dms, F.lit("S")))
        .otherwise(F.concat(dms, F.lit("N")))
    )
    return t.events.select("event_id", F.round(fc.dms_to_degrees(text), 6).alias("degrees"))


@query("X09_binary_code", "SELECT p_partkey, p_size % 8 AS code FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def _(t):
    bit = lambda shift, zero, one: F.when(F.shiftright("p_size", shift).bitwiseAND(F.lit(1)) == 1, one).otherwise(zero)
    text = F.concat(bit(2, "F", "B"), bit(1, "F", "B"), bit(0, "L", "R"))
    return t.part.select("p_partkey", fc.binary_code(text, zeros="FL", ones="BR").alias("code"))


@query(
    "X10_array_operations",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS top_index, round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda z: z[1]::DOUBLE - z[2]::DOUBLE)), 6) AS half_difference,
          round(embedding[(1 + ('0x' || substr(md5('5|' || vec_id), 1, 8))::UBIGINT % 64)::BIGINT]::DOUBLE, 8) AS drawn FROM embeddings""",
)
def _(t):
    e = F.col("embedding").cast("array<double>")
    diff = fc.elementwise_difference(F.slice(e, 1, 32), F.slice(e, 33, 32))
    return t.embeddings.select(
        "vec_id",
        fc.argmax_index("embedding").alias("top_index"),
        F.round(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x), 6).alias("half_difference"),
        F.round(F.get(e, (fc.hash_draw(5, "vec_id") % 64).cast("int")), 8).alias("drawn"),
    )


@query(
    "X11_null_handling",
    """SELECT event_type, count(*) FILTER (v IS NULL) AS missing, count(v) AS present, round(avg(v), 8) AS mean, round(sum(coalesce(v, 0)), 4) AS filled
       FROM (SELECT event_type, CASE WHEN value >= 1 THEN value END AS v FROM events) GROUP BY 1""",
)
def _(t):
    rows = t.events.select("event_type", F.when(F.col("value") >= 1, F.col("value")).alias("v"))
    return rows.groupBy("event_type").agg(
        F.count_if(F.col("v").isNull()).alias("missing"),
        F.count("v").alias("present"),
        F.round(F.avg("v"), 8).alias("mean"),
        F.round(F.sum(F.coalesce("v", F.lit(0.0))), 4).alias("filled"),
    )


@query(
    "X12_safe_casts",
    "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS digit, CAST(NULL AS INTEGER) AS word, CAST(trunc(o_totalprice) AS INTEGER) AS truncated FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        fc.to_int_truncating(F.substring("o_orderpriority", 1, 1)).alias("digit"),
        fc.to_int_truncating("o_orderpriority").alias("word"),
        fc.to_int_truncating(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("truncated"),
    )


@query("X13_plain_ascii", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def _(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", fc.strip_accents("text").alias("plain"))


@query(
    "X14_url_parts",
    r"""SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path, regexp_replace(url, '[?#].*$', '') AS bare,
           nullif(regexp_extract(url, 'example\.([a-z]+)', 1), '') AS domain FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id",
        fc.url_host("url").alias("host"),
        fc.url_path("url").alias("path"),
        fc.drop_query("url").alias("bare"),
        F.regexp_substr("url", F.lit(r"(?<=example\.)[a-z]+")).alias("domain"),
    )


# --- mapping functions over nested values, groups and tables -----------------------------


@query(
    "F01_map_over_nested",
    """SELECT o_custkey, round(sum(o_totalprice * 1.1), 4) AS raised, max(o_totalprice) > 400000 AS any_big FROM orders GROUP BY 1""",
)
def _(t):
    nested = nest(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "rows")
    raised = F.transform("rows", lambda r: r["o_totalprice"] * 1.1)
    per_chunk = nested.select(
        "o_custkey",
        F.aggregate(raised, F.lit(0.0), lambda s, x: s + x).alias("s"),
        F.exists("rows", lambda r: r["o_totalprice"] > 400000).alias("b"),
    )
    return per_chunk.groupBy("o_custkey").agg(F.round(F.sum("s"), 4).alias("raised"), F.bool_or("b").alias("any_big"))


@query(
    "F02_function_per_group",
    "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(ln(value)) / count(*), 6) AS mean_log, max(value) AS best FROM events GROUP BY 1, 2",
)
def _(t):
    rows = t.events.select("event_type", F.to_date("ts").alias("day"), "event_id", "value")

    def logs(pdf):
        return {"n": len(pdf), "s": float(np.log(pdf["value"]).sum()), "best": float(pdf["value"].max())}

    merge = {"n": F.sum("n"), "s": F.sum("s"), "best": F.max("best")}
    out = ap.per_group(rows, ["event_type", "day"], ["event_id"], logs, "n long, s double, best double", merge)
    return out.select("event_type", "day", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean_log"), "best")


@query(
    "F03_table_per_input",
    """SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS n FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)""",
)
def _(t):
    lines = spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("doc_id", (F.col("p") + 1).alias("line_no"), F.length("line").alias("n"))


@query(
    "F04_safe_function_per_group",
    """SELECT p_brand, CASE WHEN max(p_size) >= 50 THEN NULL ELSE round(sum(1.0::DOUBLE / (50 - p_size)), 6) END AS inverse, max(p_size) >= 50 AS failed FROM part GROUP BY 1""",
)
def _(t):
    def inverse(pdf):
        if (pdf["p_size"] >= 50).any():
            raise ZeroDivisionError("size reaches the limit")
        return {"inverse": float((1.0 / (50 - pdf["p_size"])).sum())}

    out = ap.per_group(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], ["p_partkey"], inverse, "inverse double", {"inverse": F.sum("inverse")})
    return out.select("p_brand", F.round("inverse", 6).alias("inverse"), F.col("error").isNotNull().alias("failed"))


@query(
    "F05_composed_steps",
    "SELECT upper(n_name) AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1",
)
def _(t):
    positive = lambda df: df.filter("c_acctbal > 0")
    named = lambda df: df.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    counted = lambda df: df.groupBy(F.upper("n_name").alias("nation")).agg(F.count("*").alias("n"))
    return ap.compose(positive, named, counted)(t.customer)
