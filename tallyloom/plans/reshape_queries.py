"""Projections, filters and reshaping (P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import columns as fc
from tallyloom.operators import reshape as rs
from tallyloom.plans.registry import query

SIZES = "SELECT p_partkey, p_size, p_retailprice FROM part"


@query("P01_pick_rename", "SELECT s_suppkey AS id, s_acctbal AS balance, s_nationkey FROM supplier")
def _(t):
    return t.supplier.drop("s_name").withColumnsRenamed({"s_suppkey": "id", "s_acctbal": "balance"}).select(
        "id", "balance", "s_nationkey"
    )


@query("P02_pick_by_pattern", "SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate FROM lineitem")
def _(t):
    return t.lineitem.select(*rs.pick(t.lineitem, "key$|^l_ship"))


@query("P03_rename_all", "SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation")
def _(t):
    return rs.rename_all(t.nation, lambda c: c.removeprefix("n_"))


@query(
    "P04_add_columns",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net,
              round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 8) AS charge FROM lineitem""",
)
def _(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = t.lineitem.withColumns({"net": F.round(net, 6), "charge": F.round(net * (1 + F.col("l_tax")), 8)})
    return out.select("l_orderkey", "l_linenumber", "net", "charge")


@query(
    "P05_change_many",
    "SELECT s_suppkey / 10.0::DOUBLE AS s_suppkey, s_name, s_nationkey / 10.0::DOUBLE AS s_nationkey, s_acctbal / 10.0::DOUBLE AS s_acctbal FROM supplier",
)
def _(t):
    return rs.change_columns(t.supplier, rs.numeric_columns(t.supplier), lambda c: c.cast("double") / 10.0)


@query(
    "P06_filter",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000 AND nullif(o_orderpriority, '5-LOW') <> '1-URGENT'",
)
def _(t):
    cond = (
        (F.col("o_orderstatus") == "F")
        & (F.col("o_totalprice") > 250000)
        & (F.nullif("o_orderpriority", F.lit("5-LOW")) != "1-URGENT")
    )
    return t.orders.filter(cond).select("o_orderkey", "o_totalprice")


@query(
    "P07_first_match",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 9000 THEN 'rich'
              WHEN c_mktsegment LIKE 'B%' THEN 'b-segment' END AS kind FROM customer""",
)
def _(t):
    kind = fc.first_match(
        [
            (F.col("c_acctbal") < 0, "debt"),
            (F.col("c_acctbal") > 9000, "rich"),
            (F.col("c_mktsegment").startswith("B"), "b-segment"),
        ]
    )
    return t.customer.select("c_custkey", kind.alias("kind"))


@query(
    "P08_drop_incomplete",
    "SELECT * FROM (SELECT e.event_id, nullif(event_type, 'view') AS kind, CASE WHEN value > 1 THEN value END AS value FROM events e) WHERE kind IS NOT NULL AND value IS NOT NULL",
)
def _(t):
    ev = t.events.select(
        "event_id",
        F.nullif("event_type", F.lit("view")).alias("kind"),
        F.when(F.col("value") > 1, F.col("value")).alias("value"),
    )
    return ev.na.drop()


@query(
    "P09_wide_counts_zero",
    """SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS economy, count(*) FILTER (p_type = 'LARGE') AS large, count(*) FILTER (p_type = 'MEDIUM') AS medium,
              count(*) FILTER (p_type = 'PROMO') AS promo, count(*) FILTER (p_type = 'SMALL') AS small, count(*) FILTER (p_type = 'STANDARD') AS standard FROM part GROUP BY 1""",
)
def _(t):
    counts = t.part.groupBy("p_brand", F.lower("p_type").alias("kind")).agg(F.count("*").alias("n"))
    return rs.to_wide(counts, ["p_brand"], "kind", "n", ["economy", "large", "medium", "promo", "small", "standard"], fill=0)


@query(
    "P10_first_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
       ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return rs.first_per_key(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(
    "P11_split_columns",
    """SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS level,
              CASE WHEN strpos(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) END AS label,
              CAST(NULL AS VARCHAR) AS rest FROM orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    out = rs.split_columns(rows, "o_orderpriority", {"level": "int", "label": "string"}, "-")
    return out.withColumn("rest", fc.split_part_or_null("label", "-", 1))


@query(
    "P12_split_rows",
    "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
)
def _(t):
    return rs.split_rows(t.part.select("p_partkey", F.col("p_name").alias("word")), "word", " ")


@query(
    "P13_extract_columns",
    r"""SELECT url, nullif(regexp_extract(url, '^(https?)://', 1), '') AS scheme,
               TRY_CAST(nullif(regexp_extract(url, '/([a-z]{2})/(\d+)', 2), '') AS INTEGER) AS number,
               nullif(regexp_extract(url, '/([a-z]{2})/(\d+)', 1), '') AS lang FROM pages""",
)
def _(t):
    out = rs.extract_columns(t.pages.select("url"), "url", {"scheme": "string"}, "^(https?)://")
    return rs.extract_columns(out, "url", {"lang": "string", "number": "int"}, r"/([a-z]{2})/(\d+)")


@query(
    "P14_unite",
    "SELECT p_partkey, concat_ws(': ', p_brand, p_type, CAST(p_size AS VARCHAR)) AS feature FROM part",
)
def _(t):
    rows = t.part.select("p_partkey", "p_brand", "p_type", "p_size")
    return rs.unite(rows, "feature", ["p_brand", "p_type", "p_size"], ": ")


@query(
    "P15_to_long",
    """SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
       UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax))""",
)
def _(t):
    return rs.to_long(
        t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value"
    )


@query(
    "P16_to_wide",
    """SELECT CAST(ts AS DATE) AS day, round(sum(value) FILTER (event_type = 'click'), 4) AS click,
              round(sum(value) FILTER (event_type = 'view'), 4) AS view, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase,
              round(sum(value) FILTER (event_type = 'signup'), 4) AS signup, round(sum(value) FILTER (event_type = 'error'), 4) AS error FROM events GROUP BY 1""",
)
def _(t):
    levels = ["click", "view", "purchase", "signup", "error"]
    sums = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return rs.to_wide(sums, ["day"], "event_type", "v", levels)


@query(
    "P17_nest",
    "SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS best, min(o_orderkey) AS first_key FROM orders GROUP BY 1",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    nested = rs.nest(rows, ["o_custkey"], ["o_orderkey"], "orders")
    per_chunk = nested.select(
        "o_custkey",
        F.size("orders").cast("long").alias("n"),
        F.array_max(F.transform("orders", lambda o: o["o_totalprice"])).alias("best"),
        F.get("orders", 0)["o_orderkey"].alias("first_key"),
    )
    return per_chunk.groupBy("o_custkey").agg(
        F.sum("n").alias("n"), F.round(F.max("best"), 2).alias("best"), F.min("first_key").alias("first_key")
    )


@query(
    "P17_unnest",
    'SELECT l_suppkey, l_orderkey AS "lines.l_orderkey", l_linenumber AS "lines.l_linenumber", l_quantity AS "lines.l_quantity" FROM lineitem',
)
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    nested = rs.nest(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity"], "lines", chunk_rows=100)
    return rs.unnest(nested, "lines", sep=".")


@query(
    "P18_key_value_columns",
    "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nat, c_mktsegment AS seg, CAST(NULL AS VARCHAR) AS cid FROM customer",
)
def _(t):
    text = F.concat(F.lit("seg:"), "c_mktsegment", F.lit(" nat:"), F.col("c_nationkey").cast("string"))
    return rs.key_value_columns(t.customer.select("c_custkey", text.alias("r")), "r", ["nat", "seg", "cid"])


@query(
    "P19_range_by_unit",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 5 BETWEEN 150 AND 193 WHEN 1 THEN p_size + 40 BETWEEN 59 AND 76 ELSE FALSE END AS ok FROM part""",
)
def _(t):
    size, kind = F.col("p_size"), F.col("p_partkey") % 3
    height = F.when(kind == 0, F.format_string("%dcm", size * 5)).when(kind == 1, F.format_string("%din", size + 40)).otherwise(size.cast("string"))
    ok = fc.range_by_unit(F.col("height"), {"cm": (150, 193), "in": (59, 76)})
    return t.part.select("p_partkey", height.alias("height")).select("p_partkey", F.coalesce(ok, F.lit(False)).alias("ok"))


@query(
    "P19_validate_records",
    r"""SELECT o_orderkey, ok_presence, ok_price, ok_priority, ok_status, ok_one_of, ok_presence AND ok_price AND ok_priority AND ok_status AS ok FROM (
         SELECT o_orderkey, nullif(o_orderstatus, 'P') IS NOT NULL AS ok_presence,
           coalesce(o_totalprice BETWEEN 1000 AND 300000, FALSE) AS ok_price,
           regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$') AS ok_priority,
           o_orderstatus IN ('F', 'O') AS ok_status,
           (substr(o_orderpriority, 3, 1) = 'L') <> (substr(o_orderpriority, 4, 1) = 'R') AS ok_one_of FROM orders)""",
)
def _(t):
    checks = {
        "ok_presence": F.nullif("o_orderstatus", F.lit("P")).isNotNull(),
        "ok_price": fc.in_range("o_totalprice", 1000, 300000),
        "ok_priority": fc.has_format("o_orderpriority", "^[1-5]-[A-Z ]+$"),
        "ok_status": fc.one_of("o_orderstatus", ["F", "O"]),
        "ok_one_of": fc.exactly_one(
            fc.char_at_is("o_orderpriority", F.lit(3), F.lit("L")),
            fc.char_at_is("o_orderpriority", F.lit(4), F.lit("R")),
        ),
    }
    out = t.orders.withColumns(checks)
    ok = F.col("ok_presence") & F.col("ok_price") & F.col("ok_priority") & F.col("ok_status")
    return out.select("o_orderkey", *checks, ok.alias("ok"))


@query(
    "P19_count_valid",
    """SELECT p_brand, count(*) FILTER (n_a BETWEEN 1 AND 2) AS valid_count, count(*) FILTER ((c1 = 'r') <> (c3 = 'r')) AS valid_position FROM (
         SELECT p_brand, length(p_name) - length(replace(p_name, 'e', '')) AS n_a, substr(p_name, 1, 1) AS c1, substr(p_name, 3, 1) AS c3 FROM part)
       GROUP BY 1""",
)
def _(t):
    counts = fc.char_count("p_name", F.lit("e")).between(1, 2)
    places = fc.exactly_one(
        fc.char_at_is("p_name", F.lit(1), F.lit("r")), fc.char_at_is("p_name", F.lit(3), F.lit("r"))
    )
    return t.part.groupBy("p_brand").agg(
        F.count_if(counts).alias("valid_count"), F.count_if(places).alias("valid_position")
    )


@query(
    "P20_lump_rare",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM c)
       SELECT brand, count(*) AS n FROM (SELECT CASE WHEN r <= 5 THEN p_brand ELSE 'Other' END AS brand FROM part JOIN r USING (p_brand)) GROUP BY 1""",
)
def _(t):
    out = rs.lump_rare(t.part.select("p_brand"), "p_brand", 5, name="brand")
    return out.groupBy("brand").agg(F.count("*").alias("n"))


@query(
    "P21_order_by_median",
    """SELECT p_brand, median, dense_rank() OVER (ORDER BY median) AS place FROM (
         SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS median FROM part GROUP BY 1)""",
)
def _(t):
    return rs.order_by_median(t.part.select("p_brand", "p_retailprice"), "p_brand", "p_retailprice", "place")


@query(
    "P22_level_codes",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS code_null,
              CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS code_last FROM events""",
)
def _(t):
    levels = ["view", "click", "signup", "purchase"]
    return t.events.select(
        "event_id",
        fc.level_code("event_type", levels).alias("code_null"),
        fc.level_code("event_type", levels, unlisted="last").alias("code_last"),
    )


@query(
    "P23_surrogate_ids",
    """SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) AS id FROM (SELECT DISTINCT p_brand, p_type FROM part)""",
)
def _(t):
    return rs.surrogate_ids(t.part, ["p_brand", "p_type"], "id")


@query(
    "P24_sample_rows",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY ('0x' || substr(md5('7|' || o_orderkey), 1, 8))::UBIGINT, o_orderkey LIMIT 200""",
)
def _(t):
    return rs.sample_rows(t.orders.select("o_orderkey", "o_totalprice"), 200, 7, "o_orderkey")
