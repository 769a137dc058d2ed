"""Sources and sinks (S rows). File formats are written from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.core import scratch_path, spread, store_and_reload
from tallyloom.functions.columns import hash_normal, hash_uniform
from tallyloom.operators.reshape import key_value_columns
from tallyloom.plans.registry import query
from tallyloom.sources import documents as docs
from tallyloom.sources import files


@query("S01_header_csv", "SELECT * FROM part")
def _(t):
    path = scratch_path(t.spark, "csv")
    t.part.write.option("header", True).option("escape", '"').csv(path)
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    return files.read_header_csv(t.spark, path, schema)


@query("S02_single_column", "SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "onecol")
    t.part.select("p_size").write.csv(path)
    return files.read_single_column(t.spark, path, "v int").groupBy("v").agg(F.count("*").alias("n"))


@query(
    "S03_delimited_parts",
    """SELECT o_orderpriority AS token, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n
       FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1, 2""",
)
def _(t):
    path = scratch_path(t.spark, "tsv")
    rows = t.orders.select(
        F.col("o_orderkey").alias("#key"), "o_orderpriority", F.year("o_orderdate").alias("y")
    )
    rows.write.option("sep", "\t").option("header", True).csv(path)
    read = files.read_delimited_parts(t.spark, path, "key long, token string, year int", comment="#")
    return read.filter("year >= 1997").groupBy("token", "year").agg(F.count("*").alias("n"))


@query(
    "S04_messy_header",
    "SELECT CAST(s_suppkey AS VARCHAR) AS supp_key, s_name AS supplier_name, CAST(s_nationkey AS VARCHAR) AS nation_key_id FROM supplier",
)
def _(t):
    path = scratch_path(t.spark, "messy")
    messy = t.supplier.select(
        F.col("s_suppkey").alias("SuppKey"),
        F.col("s_name").alias("Supplier Name "),
        F.col("s_nationkey").alias("Nation.Key (id)"),
    )
    messy.write.option("sep", "\t").option("header", True).csv(path)
    return files.read_messy_header(t.spark, path)


@query(
    "S05_ragged_records",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS match_count,
              count(DISTINCT o_custkey) AS volume_count
       FROM orders GROUP BY 1""",
)
def _(t):
    path = scratch_path(t.spark, "ragged")
    year = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("c")
    )
    record = F.concat_ws(",", "y", "n", "c")
    # one line of records per decade; the number of years limits its length
    line = year.groupBy(F.floor(F.col("y") / 10).alias("d")).agg(F.listagg(record, F.lit("\t")).alias("value"))
    line.select(F.concat(F.lit(" \t"), "value").alias("value")).write.text(path)
    return files.read_ragged_records(
        t.spark, path, {"year": "int", "match_count": "long", "volume_count": "long"}
    )


@query("S06_typed_lines", "SELECT o_totalprice AS v FROM orders")
def _(t):
    path = scratch_path(t.spark, "lines")
    t.orders.select(F.col("o_totalprice").cast("string")).write.text(path)
    return files.read_typed_lines(t.spark, path, "double")


@query(
    "S07_blank_line_records",
    "SELECT CAST(c_custkey AS VARCHAR) AS cid, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer",
)
def _(t):
    path = scratch_path(t.spark, "records")
    text = F.format_string("cid:%d nation:%d\nsegment:%s", "c_custkey", "c_nationkey", "c_mktsegment")
    t.customer.select(text.alias("value")).write.option("lineSep", "\n\n").text(path)
    return key_value_columns(files.read_blank_line_records(t.spark, path), "record", ["cid", "nation", "segment"])


@query(
    "S07_marker_groups",
    """SELECT user_id, group_id, count(*) AS n FROM (
         SELECT user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS group_id FROM events)
       GROUP BY 1, 2""",
)
def _(t):
    ev = t.events.select("user_id", "ts", "event_id", "event_type")
    out = files.marker_groups(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "group_id")
    return out.groupBy("user_id", "group_id").agg(F.count("*").alias("n"))


@query(
    "S08_xml_track_points",
    """SELECT user_id AS track, CAST(event_id % 180 - 90 AS DOUBLE) AS lat, CAST(event_id % 360 - 180 AS DOUBLE) AS lon,
              value AS alt, CAST(60 + event_id % 100 AS INTEGER) AS hr, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""",
)
def _(t):
    path = scratch_path(t.spark, "gpx")
    points = t.events.select(
        (F.col("event_id") % 180 - 90).cast("double").alias("_lat"),
        (F.col("event_id") % 360 - 180).cast("double").alias("_lon"),
        F.col("value").alias("ele"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        (F.lit(60) + F.col("event_id") % 100).cast("int").alias("hr"),
        F.col("user_id").alias("track"),
    )
    points.write.format("xml").option("rowTag", "trkpt").option("rootTag", "gpx").save(path)
    read = docs.read_track_points(t.spark, path)
    return read.select("track", "lat", "lon", "alt", "hr", F.unix_timestamp("ts").alias("seconds"))


@query(
    "S09_json_fields",
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
def _(t):
    return docs.json_rows(t.events.select("event_id", "event_type", "props"), "props", "k int")


@query(
    "S09_nested_json",
    """SELECT l_orderkey AS key, l_linenumber AS "line.no", m AS "item.measure", v AS "item.value.amount" FROM (
         SELECT l_orderkey, l_linenumber, 'quantity' AS m, l_quantity AS v FROM lineitem
         UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem)""",
)
def _(t):
    item = lambda name, c: F.struct(F.lit(name).alias("measure"), F.struct(F.col(c).alias("amount")).alias("value"))
    doc = F.to_json(
        F.struct(
            F.col("l_orderkey").alias("key"),
            F.struct(F.col("l_linenumber").alias("no")).alias("line"),
            F.array(item("quantity", "l_quantity"), item("tax", "l_tax")).alias("item"),
        )
    )
    path = scratch_path(t.spark, "json")
    t.lineitem.select(doc.alias("value")).write.text(path)
    schema = "key long, line struct<no:int>, item array<struct<measure:string,value:struct<amount:double>>>"
    return docs.json_rows(t.spark.read.text(path), "value", schema, array_field="item")


@query(
    "S10_html_fields",
    r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title(?: [^>]*)?>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g')), '') AS title,
         nullif(regexp_extract(html, '<html [^>]*?lang="([^"]*)"', 1), '') AS lang,
         nullif(regexp_extract(html, '<img [^>]*?src="([^"]*)"', 1), '') AS image,
         len(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS n_links,
         length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
           '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_length FROM pages""",
)
def _(t):
    return docs.html_fields(
        spread(t.pages.select("page_id", "html")),
        "html",
        {
            "title": F.nullif(docs.tag_text("html", "title"), F.lit("")),
            "lang": docs.tag_attribute("html", "html", "lang"),
            "image": docs.tag_attribute("html", "img", "src"),
            "n_links": F.size(docs.tag_attributes("html", "a", "href")).cast("long"),
            "text_length": F.length(docs.visible_text("html")).cast("long"),
        },
    )


@query(
    "S10_html_links",
    """SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1""",
)
def _(t):
    links = spread(t.pages.select("html")).select(F.explode(docs.tag_attributes("html", "a", "href")).alias("link"))
    return links.groupBy("link").agg(F.count("*").alias("n"))


def supplier_pages(t):
    """A page per nation with a table of its suppliers and labelled lines, written as untidily as pages are."""
    row = F.format_string("<TR class='s'><td>%d<td><b>%s</b> &amp; co.</td>", "s_suppkey", "s_name")
    rows = t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("rows"), F.count("*").alias("n"))
    rows = rows.withColumn("rows", F.array_join("rows.row", "\n"))
    head = "<HTML><script>var t = '<td>no</td>: no';</script><Div>Nation: %s &lt;%d&gt;.<br>Suppliers: %d.</div><!-- Size: 0 -->"
    html = F.format_string(head + "<table id=x><tr><th>Key</th><TH>Name</TH></tr>%s</TABLE></html>", "n_name", "s_nationkey", "n", "rows")
    return rows.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_nationkey", html.alias("html"))


@query(
    "S10_html_cells",
    """WITH r AS (SELECT s_nationkey, s_suppkey, s_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS row_no FROM supplier JOIN nation ON n_nationkey = s_nationkey),
       c AS (SELECT s_nationkey, row_no, 0 AS col_no, s_suppkey::VARCHAR AS cell, false AS header FROM r UNION ALL SELECT s_nationkey, row_no, 1, s_name || ' & co.', false FROM r
         UNION ALL SELECT DISTINCT s_nationkey, 0, 0, 'Key', true FROM r UNION ALL SELECT DISTINCT s_nationkey, 0, 1, 'Name', true FROM r)
       SELECT s_nationkey, 0 AS table_no, row_no, col_no, header, cell FROM c""",
)
def _(t):
    return docs.table_cells(supplier_pages(t), "html")


@query(
    "S10_labelled_lines",
    """WITH r AS (SELECT s_nationkey, any_value(n_name) AS n_name, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
       SELECT s_nationkey, 'Nation' AS label, n_name || ' <' || s_nationkey || '>' AS value FROM r UNION ALL SELECT s_nationkey, 'Suppliers', n::VARCHAR FROM r""",
)
def _(t):
    return docs.labelled_lines(supplier_pages(t), "html").drop("line_no")


@query(
    "S08_tcx_points",
    """SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'Biking' ELSE 'Running' END AS sport, event_id % 3 AS lap, CAST(floor(epoch(ts)) AS BIGINT) AS seconds,
              CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 180 - 90 AS DOUBLE) END AS lat, value AS alt, CAST(60 + event_id % 100 AS INTEGER) AS hr FROM events""",
)
def _(t):
    path = scratch_path(t.spark, "tcx")
    degrees = (F.col("event_id") % 180 - 90).cast("double")
    place = F.when(F.col("event_id") % 5 != 0, F.struct(degrees.alias("LatitudeDegrees"), F.lit(0.0).alias("LongitudeDegrees")))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Time")
    pulse = F.struct((F.lit(60) + F.col("event_id") % 100).cast("int").alias("Value"))
    point = F.struct(time, place.alias("Position"), F.col("value").alias("AltitudeMeters"), F.lit(0.0).alias("DistanceMeters"), pulse.alias("HeartRateBpm"))
    # an activity per user with three laps
    laps = t.events.groupBy("user_id", (F.col("event_id") % 3).alias("lap")).agg(F.collect_list(point).alias("Trackpoint"))
    track = F.array(F.struct("Trackpoint")).alias("Track")
    lap = F.struct("lap", F.struct(F.format_string("2020-01-01T00:00:0%dZ", "lap").alias("_StartTime"), track).alias("l"))
    start = F.date_format(F.timestamp_seconds(F.col("user_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Id")
    sport = F.when(F.col("user_id") % 2 == 0, "Biking").otherwise("Running").alias("_Sport")
    files_ = laps.groupBy("user_id").agg(F.array_sort(F.collect_list(lap)).alias("x")).select(sport, start, F.col("x.l").alias("Lap"))
    files_.write.format("xml").option("rowTag", "Activity").option("rootTag", "Activities").save(path)
    read = docs.read_tcx_points(t.spark, path)
    seconds = F.unix_timestamp
    return read.select(
        seconds("activity").alias("user_id"), "sport", F.col("lap").cast("long").alias("lap"), seconds("ts").alias("seconds"), "lat", "alt", "hr"
    )


@query(
    "S11_drifting_layouts",
    """SELECT CASE WHEN s_nationkey < 12 THEN DATE '2019-11-01' ELSE DATE '2019-11-02' END AS file_date,
              s_suppkey AS key, s_name AS local, CASE WHEN s_nationkey < 12 THEN NULL ELSE s_acctbal END AS balance FROM supplier""",
)
def _(t):
    base = scratch_path(t.spark, "layouts")
    sup = t.supplier
    sup.filter("s_nationkey < 12").select(
        F.col("s_suppkey").alias("Supp Key"), F.col("s_name").alias("Localidade")
    ).write.option("header", True).csv(f"{base}/file_2019-11-01")
    sup.filter("s_nationkey >= 12").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("Name"), F.col("s_acctbal").alias("Balance")
    ).write.option("header", True).csv(f"{base}/file_2019-11-02")
    frames = [
        t.spark.read.option("header", True).csv(f"{base}/file_{d}").withColumn("file_date", files.file_date(r"file_(\d{4}-\d{2}-\d{2})"))
        for d in ("2019-11-01", "2019-11-02")
    ]
    renames = [{"supp_key": "key", "localidade": "local"}, {"name": "local"}]
    out = files.stack_layouts(frames, renames, ["file_date", "key", "local", "balance"])
    return out.withColumns({"key": F.col("key").cast("long"), "balance": F.col("balance").cast("double")})


@query(
    "S12_word_lists",
    """SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part
       UNION ALL SELECT lower(p_type) FROM part) WHERE word <> ''""",
)
def _(t):
    base = scratch_path(t.spark, "words")
    t.part.select("p_name").write.text(f"{base}/a")
    t.part.select(F.lower("p_type")).write.text(f"{base}/b")
    a, b = (files.read_word_list(t.spark, f"{base}/{x}") for x in "ab")
    return a.unionByName(b).distinct()


@query(
    "S13_synthetic_noise",
    """WITH d AS (SELECT c_custkey,
           ('0x' || substr(md5('1|' || c_custkey), 1, 8))::UBIGINT AS a, ('0x' || substr(md5('2|' || c_custkey), 1, 8))::UBIGINT AS b,
           ('0x' || substr(md5('3|' || c_custkey), 1, 8))::UBIGINT AS c FROM customer)
       SELECT c_custkey, round(100 * (a / 4294967296.0), 6) AS uniform,
              round(sqrt(-2 * ln((b + 1) / 4294967297.0)) * cos(6.283185307179586 * (c / 4294967296.0)), 6) AS noise FROM d""",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        F.round(100 * hash_uniform(1, "c_custkey"), 6).alias("uniform"),
        F.round(hash_normal(2, "c_custkey"), 6).alias("noise"),
    )


@query(
    "S14_store_and_reload",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1, 2",
)
def _(t):
    out = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )
    return store_and_reload(out, "pricing")
