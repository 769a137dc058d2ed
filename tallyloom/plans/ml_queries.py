"""Machine learning and resampling (M13-M27)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tallyloom.core import cut_lineage, spread, store_and_reload
from tallyloom.functions.columns import one_hot
from tallyloom.operators import lasso, ml
from tallyloom.operators import resample as rsm
from tallyloom.operators import stats as st
from tallyloom.operators import text as tx
from tallyloom.operators.recipe import numeric_recipe
from tallyloom.operators.reshape import hash_split
from tallyloom.plans.registry import query

DRAW = "('0x' || substr(md5('3|' || vec_id), 1, 8))::UBIGINT % 1000"
SPLIT = f"tr AS (SELECT * FROM embeddings WHERE {DRAW} < 700), te AS (SELECT * FROM embeddings WHERE {DRAW} >= 700)"


def split_vectors(t):
    rows = cut_lineage(hash_split(t.embeddings, 0.7, 3, "vec_id"))
    return rows.filter("is_train").drop("is_train"), rows.filter("NOT is_train").drop("is_train")


def near_sql(dims=64, k=15):
    cut = "" if dims == 64 else f"[1:{dims}]"
    return f"""nn{dims} AS (SELECT te.vec_id, tr.vec_id AS neighbour, tr.label AS l, te.label AS t, list_distance((te.embedding::DOUBLE[]){cut}, (tr.embedding::DOUBLE[]){cut}) AS distance,
      row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance((te.embedding::DOUBLE[]){cut}, (tr.embedding::DOUBLE[]){cut}), tr.vec_id) AS rank FROM te, tr QUALIFY rank <= {k})"""


def vote_sql(source, k):
    return f"""(SELECT vec_id, any_value(t) AS t, arg_min(l, (-n, l)) AS predicted FROM (SELECT vec_id, t, l, count(*) AS n FROM {source} WHERE rank <= {k} GROUP BY 1, 2, 3) GROUP BY 1)"""


@query("M14_polynomial_errors")
def _(t):
    rows = hash_split(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), 0.5, 5, "l_orderkey", "l_linenumber")
    return ml.polynomial_errors(rows, "l_quantity", "l_extendedprice", [1, 2, 3, 5, 10], "is_train")


def quality_path(t, min_total=50):
    """Lasso of the quality label on the word counts of labelled documents."""
    labels = t.labels.select("doc_id", F.col("quality").cast("double").alias("quality"))
    rated = store_and_reload(spread(t.documents.select("doc_id", "text")).join(labels, "doc_id"), "rated-texts")
    counts = tx.document_terms(tx.tokens(rated.select("doc_id", "text"), "text"), "doc_id", min_total)
    return lasso.lasso_path(counts, rated.select("doc_id", "quality"), "doc_id", "word", "n", "quality", n_penalties=8, least_ratio=0.1)


@query("M15_lasso_path")
def _(t):
    return quality_path(t).errors


@query("M15_lasso_terms")
def _(t):
    return quality_path(t).terms.filter("is_min OR is_1se")


@query("M18_explained_variance")
def _(t):
    return ml.explained_variance(t.embeddings, "embedding", 10)


@query("M18_projection")
def _(t):
    _, rows = ml.principal_components(t.embeddings.select("vec_id", "embedding"), "embedding", 3)
    return rows.select("vec_id", *[F.get("components", i).alias(f"pc_{i + 1}") for i in range(3)])


CENTS = "c AS (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM {src}) GROUP BY 1, 2)"


@query(
    "M19_centroid_distances",
    f"WITH {CENTS.format(src='embeddings')} SELECT a.label AS label_a, b.label AS label_b, round(sqrt(avg(pow(a.x - b.x, 2))), 8) AS rms FROM c a JOIN c b USING (dim) WHERE a.label < b.label GROUP BY 1, 2",
)
def _(t):
    out = ml.centroid_distances(t.embeddings, "label", "embedding")
    return out.withColumn("rms", F.round("rms", 8))


@query(
    "M20_nearest_centroid",
    f"""WITH {SPLIT}, {CENTS.format(src='tr')}, d AS (SELECT vec_id, c.label AS l, sum(pow(e.x - c.x, 2)) AS d FROM (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM te) e JOIN c USING (dim) GROUP BY 1, 2)
        SELECT vec_id, arg_min(l, (d, l)) AS predicted FROM d GROUP BY 1""",
)
def _(t):
    train, test = split_vectors(t)
    return ml.nearest_centroid(train, "label", "embedding", test, "vec_id").select("vec_id", "predicted")


@query(
    "M21_nearest_neighbours",
    f"WITH {SPLIT}, {near_sql(k=5)} SELECT vec_id, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM nn64",
)
def _(t):
    train, test = split_vectors(t)
    out = ml.nearest_neighbours(train, test, "vec_id", "embedding", 5)
    return out.withColumn("distance", F.round("distance", 6))


@query("M21_knn_classify", f"WITH {SPLIT}, {near_sql(k=7)} SELECT vec_id, predicted FROM {vote_sql('nn64', 7)}")
def _(t):
    train, test = split_vectors(t)
    return ml.knn_classify(train, test, "vec_id", "embedding", "label", 7)


GRID = [(k, d) for d in (16, 64) for k in (1, 5, 15)]


GRID_SQL = " UNION ALL ".join(
    f"SELECT {k} AS k, {d} AS dims, round(avg((predicted = t)::INT), 8) AS accuracy FROM {vote_sql(f'nn{d}', k)}" for k, d in GRID
)


def accuracy_grid(t):
    train, test = split_vectors(t)
    out = ml.knn_grid(train, test, "vec_id", "embedding", "label", [1, 5, 15], [16, 64])
    return out.withColumn("accuracy", F.round("accuracy", 8))


@query("M22_knn_grid", f"WITH {SPLIT}, {near_sql(16)}, {near_sql(64)} {GRID_SQL}")
def _(t):
    return accuracy_grid(t)


@query(
    "M22_best_rows",
    f"WITH {SPLIT}, {near_sql(16)}, {near_sql(64)}, g AS ({GRID_SQL}) SELECT * FROM g WHERE accuracy = (SELECT max(accuracy) FROM g)",
)
def _(t):
    return ml.best_rows(store_and_reload(accuracy_grid(t), "accuracy-grid"), "accuracy")


@query(
    "M23_one_hot_scaled",
    """SELECT c_custkey, [CASE WHEN c_mktsegment = s THEN 1 ELSE 0 END FOR s IN ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']] AS hot, c_acctbal / 255.0::DOUBLE AS scaled FROM customer""",
)
def _(t):
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return t.customer.select("c_custkey", one_hot("c_mktsegment", levels).alias("hot"), (F.col("c_acctbal") / 255.0).alias("scaled"))


NUMERIC = ["l_quantity", "p_retailprice", "p_size", "unit"]


def priced_parts(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), "p_retailprice",
        F.col("p_size").cast("double").alias("p_size"), F.lit(1.0).alias("unit"), "p_type", "l_extendedprice",
    )


def box_cox_sql(columns):
    """Powers by the same three grids, column by column, and the transformed rows."""
    parts = ["z AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, p_retailprice, p_size::DOUBLE AS p_size FROM lineitem JOIN part ON l_partkey = p_partkey)"]
    for c in columns:
        before, steps = "0", (1, 20, 400)
        for i, steps_of in enumerate(steps):
            at = f"({before}) * {20 if i else 1} + d" if i else "d"
            power = f"(k / {4.0 * steps_of}::DOUBLE)"
            parts.append(f"""g{c}{i} AS (SELECT arg_max(k, (ll, -k)) AS k FROM (SELECT k, -count(*) / 2.0 * ln(var_pop(CASE WHEN k = 0 THEN ln({c}) ELSE (pow({c}, {power}) - 1) / {power} END)) + ({power} - 1) * sum(ln({c})) AS ll
              FROM z, (SELECT {at} AS k FROM (SELECT unnest(range(-20, 21)) AS d)) GROUP BY k))""")
            before = f"SELECT k FROM g{c}{i}"
    power = {c: f"((SELECT k FROM g{c}2) / 1600.0::DOUBLE)" for c in columns}
    changed = [f"CASE WHEN {p} = 0 THEN ln({c}) ELSE (pow({c}, {p}) - 1) / {p} END AS {c}" for c, p in power.items()]
    return ", ".join([*parts, f"t AS (SELECT l_orderkey, l_linenumber, {', '.join(changed)} FROM z)"])


@query(
    "M24_recipe_columns",
    f"""WITH {box_cox_sql(NUMERIC[:3])}
        SELECT l_orderkey, l_linenumber, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in NUMERIC[:3])} FROM t""",
)
def _(t):
    rows = priced_parts(t).select("l_orderkey", "l_linenumber", *NUMERIC)
    out = Pipeline(stages=numeric_recipe(NUMERIC)).fit(rows).transform(rows)  # drops the column that never varies
    return out.withColumns({c: F.round(c, 6) for c in out.columns[2:]})


@query("M24_forest_metrics")
def _(t):
    split = hash_split(priced_parts(t), 0.75, 9, "l_orderkey", "l_linenumber")
    model = ml.forest_fit(split.filter("is_train"), NUMERIC, ["p_type"], "l_extendedprice", trees=10, stages=numeric_recipe(NUMERIC))
    return st.regression_metrics(model.transform(split.filter("NOT is_train")), "l_extendedprice", "prediction")


SIMS = """obs AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
  sz AS (SELECT DISTINCT o_custkey, size FROM obs), r AS (SELECT c_custkey, c_mktsegment AS match, CASE WHEN c_nationkey % 2 = 0 THEN 'home' ELSE 'away' END AS role FROM customer),
  dr AS (SELECT match, role, c_custkey, sim, ('0x' || substr(md5('21|' || c_custkey || '|' || sim), 1, 8))::UBIGINT % size + 1 AS pos
         FROM r LEFT JOIN sz ON o_custkey = c_custkey, (SELECT unnest(range(1, 101)) AS sim)),
  su AS (SELECT match, role, sim, sum(coalesce(o_totalprice, 0)) AS points FROM dr LEFT JOIN obs ON obs.o_custkey = dr.c_custkey AND obs.pos = dr.pos GROUP BY 1, 2, 3),
  ha AS (SELECT match, sim, sum(CASE WHEN role = 'home' THEN points ELSE 0 END) AS h, sum(CASE WHEN role = 'away' THEN points ELSE 0 END) AS a FROM su GROUP BY 1, 2)"""


def simulated(t):
    observed = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    role = F.when(F.col("c_nationkey") % 2 == 0, "home").otherwise("away")
    roster = t.customer.select("c_custkey", F.col("c_mktsegment").alias("match"), role.alias("role"))
    return rsm.simulated_sums(
        observed, "c_custkey", "o_totalprice", ["o_orderkey"], roster, ["match", "role"], sims=100, seed=21
    )


@query(
    "M27_outcome_shares",
    f"""WITH {SIMS} SELECT match, round(avg((h > a)::INT), 8) AS home_win, round(avg((h < a)::INT), 8) AS away_win, round(avg((h = a)::INT), 8) AS tie,
          round(avg(h - a), 3) AS mean_difference, round(stddev_samp(h - a), 3) AS sd_difference FROM ha GROUP BY 1""",
)
def _(t):
    out = rsm.outcome_shares(simulated(t), "match", "role", "home", "away")
    digits = {"home_win": 8, "away_win": 8, "tie": 8, "mean_difference": 3, "sd_difference": 3}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("M27_simulated_differences", f"WITH {SIMS} SELECT match, CAST(sim AS INTEGER) AS sim, round(h - a, 2) AS difference FROM ha")
def _(t):
    out = rsm.simulated_differences(simulated(t), "match", "role", "home")
    return out.withColumn("difference", F.round("difference", 2))
