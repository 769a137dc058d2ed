"""Graph operators (G rows).

The main graph links suppliers that serve the same orders unusually often; the
directed one is the containment region, nation, customer, order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import graph as gr
from tallyloom.operators.relational import pair_counts
from tallyloom.plans.registry import query


def edges_sql(sd):
    return f"""mm AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
      pc AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS n FROM mm a JOIN mm b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2),
      e AS (SELECT src, dst, n FROM pc{'' if sd is None else f' WHERE n > (SELECT avg(n) + {sd} * stddev_samp(n) FROM pc)'}),
      k AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), nd AS (SELECT DISTINCT src AS id FROM k)"""


EALL, E25 = edges_sql(None), edges_sql(2.5)


def supplier_edges(t, sd):
    counts = gr.keep(pair_counts(t.lineitem, "l_orderkey", "l_suppkey"))
    return counts.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n") if sd is None else gr.keep(gr.connected_pairs(counts, sd))


def levels_sql(depth=12):
    """Breadth-first levels with path counts, written out level by level."""
    parts = ["l0 AS (SELECT id AS s, id AS v, 1::DOUBLE AS p FROM nd)"]
    for i in range(1, depth + 1):
        seen = " AND ".join(f"(a.s, k.dst) NOT IN (SELECT (s, v) FROM l{j})" for j in range(i))
        parts.append(f"l{i} AS MATERIALIZED (SELECT a.s, k.dst AS v, sum(a.p) AS p FROM l{i - 1} a JOIN k ON k.src = a.v WHERE {seen} GROUP BY 1, 2)")
    union = " UNION ALL ".join(f"SELECT s, v, {i} AS d, p FROM l{i}" for i in range(depth + 1))
    return ", ".join(parts) + f", sp AS MATERIALIZED ({union})"


PATHS = f"{EALL}, {levels_sql()}"


@query("G01_node_table", f"WITH {EALL} SELECT id, s_name, s_nationkey FROM nd LEFT JOIN supplier ON s_suppkey = id")
def _(t):
    attrs = t.supplier.select(F.col("s_suppkey").alias("id"), "s_name", "s_nationkey")
    return gr.node_table(supplier_edges(t, None), attrs)


@query("G02_degrees", f"WITH {EALL} SELECT src AS id, count(*) AS degree FROM k GROUP BY 1")
def _(t):
    return gr.degrees(supplier_edges(t, None))


def comp_sql(e):
    return f"""WITH RECURSIVE {e}, rc(id, root) AS (SELECT id, id FROM nd UNION SELECT k.dst, rc.root FROM rc JOIN k ON k.src = rc.id),
      co AS (SELECT id, min(root) AS component FROM rc GROUP BY 1)"""


@query("G03_components", f"{comp_sql(EALL)} SELECT id, component FROM co")
def _(t):
    return gr.components(supplier_edges(t, None))


@query("G03_component_sizes", f"{comp_sql(EALL)} SELECT component, count(*) AS n_nodes FROM co GROUP BY 1")
def _(t):
    return gr.component_sizes(gr.components(supplier_edges(t, None)))


@query(
    "G04_largest_component",
    f"""{comp_sql(E25)}, b AS (SELECT component FROM co GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
        SELECT e.src, e.dst, e.n FROM e JOIN co a ON a.id = e.src JOIN b USING (component)""",
)
def _(t):
    return gr.largest_component(supplier_edges(t, 2.5)).select("src", "dst", "n")


@query(
    "G05_density",
    f"""WITH {EALL} SELECT count(DISTINCT src) AS n_nodes, CAST(count(*) / 2 AS BIGINT) AS n_edges, round(count(*)::DOUBLE / (count(DISTINCT src)::DOUBLE * (count(DISTINCT src) - 1)), 8) AS density FROM k""",
)
def _(t):
    return gr.density(supplier_edges(t, None)).withColumn("density", F.round("density", 8))


@query("G06_shortest_paths", f"WITH {PATHS} SELECT s AS source, v AS id, CAST(d AS INTEGER) AS dist, p AS paths FROM sp")
def _(t):
    return gr.shortest_paths(supplier_edges(t, None))


@query(
    "G06_diameter",
    f"WITH {PATHS}, ec AS (SELECT s, max(d) AS x FROM sp GROUP BY 1) SELECT CAST(max(x) AS INTEGER) AS diameter, round(max(x)::DOUBLE / min(x), 8) AS eccentricity_ratio FROM ec",
)
def _(t):
    out = gr.diameter(gr.distance_profile(supplier_edges(t, None)))
    return out.withColumn("eccentricity_ratio", F.round("eccentricity_ratio", 8))


@query(
    "G07_closeness",
    f"WITH {PATHS} SELECT s AS id, round((count(*) - 1)::DOUBLE / nullif(sum(d), 0), 8) AS closeness FROM sp GROUP BY 1",
)
def _(t):
    return gr.closeness(gr.distance_profile(supplier_edges(t, None))).withColumn("closeness", F.round("closeness", 8))


NODE_BC = """nb AS (SELECT id, coalesce(b, 0) AS b FROM nd LEFT JOIN (SELECT x.v AS id, sum(x.p * y.p / st.p) / 2 AS b FROM sp x JOIN sp y ON x.v = y.s JOIN sp st ON st.s = x.s AND st.v = y.v AND st.d = x.d + y.d
   WHERE x.s <> x.v AND y.v <> x.v GROUP BY 1) USING (id))"""


@query("G08_betweenness", f"WITH {PATHS}, {NODE_BC} SELECT id, round(b, 6) AS betweenness FROM nb")
def _(t):
    nodes, _ = gr.betweenness(supplier_edges(t, None))
    return nodes.withColumn("betweenness", F.round("betweenness", 6))


@query(
    "G08_edge_betweenness",
    f"""WITH {PATHS} SELECT least(k.src, k.dst) AS src, greatest(k.src, k.dst) AS dst, round(sum(x.p * y.p / st.p) / 2, 6) AS betweenness
        FROM k JOIN sp x ON x.v = k.src JOIN sp y ON y.s = k.dst JOIN sp st ON st.s = x.s AND st.v = y.v AND st.d = x.d + 1 + y.d GROUP BY 1, 2""",
)
def _(t):
    _, scores = gr.betweenness(supplier_edges(t, None))
    return scores.withColumn("betweenness", F.round("betweenness", 6))


EIGEN = """lk AS (SELECT src, dst FROM k UNION ALL SELECT id, id FROM nd),
  pw(i, id, x) AS (SELECT 0, id, 1::DOUBLE FROM nd UNION ALL SELECT any_value(i) + 1, lk.dst, sum(x) FROM pw JOIN lk ON lk.src = pw.id WHERE i < 80 GROUP BY lk.dst),
  eg AS (SELECT id, x / (SELECT max(x) FROM pw WHERE i = 80) AS x FROM pw WHERE i = 80)"""


@query("G09_eigenvector", f"WITH RECURSIVE {EALL}, {EIGEN} SELECT id, round(x, 8) AS eigen FROM eg")
def _(t):
    return gr.eigenvector(supplier_edges(t, None)).withColumn("eigen", F.round("eigen", 8))


@query(
    "G10_label_communities",
    f"""WITH RECURSIVE {EALL}, vt AS (SELECT src, dst FROM k UNION ALL SELECT id, id FROM nd),
        lp(i, id, c) AS (SELECT 0, id, id FROM nd UNION ALL
          SELECT i + 1, dst, arg_min(c, (-n, c)) FROM (SELECT any_value(lp.i) AS i, vt.dst, lp.c, count(*) AS n FROM lp JOIN vt ON vt.src = lp.id WHERE lp.i < 40 GROUP BY vt.dst, lp.c) GROUP BY i, dst)
        SELECT id, c AS community FROM lp WHERE i = 40""",
)
def _(t):
    return gr.label_communities(supplier_edges(t, None))


def louvain(t):
    """Communities of the suppliers by the number of orders that two of them serve."""
    return gr.louvain_communities(supplier_edges(t, None), "n", least=2e-3)


@query("G10_communities")
def _(t):
    return louvain(t)[0]


@query("G10_community_sizes")
def _(t):
    return gr.community_sizes(louvain(t)[0])


@query("G10_modularity_levels")
def _(t):
    return louvain(t)[1]


@query(
    "G11_role_labels",
    f"""WITH RECURSIVE {PATHS}, {NODE_BC}, {EIGEN}, z AS (SELECT id, round(b, 6) AS b, round(x, 8) AS x FROM nb JOIN eg USING (id)),
        q AS (SELECT quantile_cont(b, 0.75) AS qb, quantile_cont(x, 0.75) AS qx FROM z)
        SELECT id, b AS betweenness, x AS eigen, CASE WHEN b >= qb AND x < qx THEN 'gatekeeper' WHEN b < qb AND x >= qx THEN 'accessor' ELSE 'other' END AS role FROM z, q""",
)
def _(t):
    e = supplier_edges(t, None)
    nodes, _ = gr.betweenness(e)
    scores = nodes.join(gr.eigenvector(e), "id").select(
        "id", F.round("betweenness", 6).alias("betweenness"), F.round("eigen", 8).alias("eigen")
    )
    return gr.role_labels(gr.keep(scores), "betweenness", "eigen")


TREE = """t AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 1::DOUBLE AS n FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 1 FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 1 FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, sum(l_quantity) FROM lineitem GROUP BY 1, 2)"""


def containment(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = F.lit(1.0).alias("n")
    parts = t.lineitem.groupBy(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).agg(
        F.sum("l_quantity").alias("n")
    )
    return (
        t.nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), one)
        .union(t.customer.select(name("n", "c_nationkey"), name("c", "c_custkey"), one))
        .union(t.orders.select(name("c", "o_custkey"), name("o", "o_orderkey"), one))
        .union(parts)
    )


def tree_sources(t):
    return t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))


@query(
    "G12_reachable",
    f"WITH RECURSIVE {TREE}, rc(source, id) AS (SELECT DISTINCT src, dst FROM t WHERE src LIKE 'r%' UNION SELECT rc.source, t.dst FROM rc JOIN t ON t.src = rc.id) SELECT source, id FROM rc",
)
def _(t):
    return gr.reachable(containment(t), tree_sources(t))


@query(
    "G13_contained_totals",
    f"""WITH RECURSIVE {TREE}, w(source, id, q) AS (SELECT src, dst, n FROM t WHERE src LIKE 'r%' UNION ALL SELECT w.source, t.dst, w.q * t.n FROM w JOIN t ON t.src = w.id)
        SELECT source, round(sum(q), 2) AS total FROM w GROUP BY 1""",
)
def _(t):
    out = gr.contained_totals(containment(t), tree_sources(t))
    return out.withColumn("total", F.round("total", 2))


@query(
    "G14_rule_edges",
    "SELECT 'order ' || l_orderkey AS src, 'part ' || l_partkey AS dst, CAST(l_quantity AS BIGINT) AS n FROM lineitem",
)
def _(t):
    item = F.format_string("%d part %d bag%s", F.col("l_quantity").cast("long"), "l_partkey", F.when(F.col("l_quantity") > 1, "s").otherwise(""))
    rules = t.lineitem.groupBy("l_orderkey").agg(F.listagg(item, F.lit(", ")).alias("items"))
    text = F.concat(F.format_string("order %d bags contain ", "l_orderkey"), "items", F.lit("."))
    empty = t.region.select(F.concat(F.col("r_name"), F.lit(" bags contain no other bags.")).alias("text"))
    return gr.rule_edges(rules.select(text.alias("text")).union(empty), "text")
