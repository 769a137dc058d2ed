"""Classical machine learning on DataFrames and MLlib."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    PCA,
    PolynomialExpansion,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import cut_lineage, hot_rows, with_table_scalars
from tallyloom.operators.aggregate import mean_vectors
from tallyloom.operators.recipe import KeptColumns


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two double arrays."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(sq, F.lit(0.0), lambda s, v: s + v)


def as_doubles(array: str) -> Column:
    return F.col(array).cast("array<double>")


# --- centroids -----------------------------------------------------------------------


def centroid_distances(df: DataFrame, label: str, array: str) -> DataFrame:
    """Root mean squared difference between the centroids of all label pairs.

    Works on the centroid table (one row per label and dimension), not on rows.
    """
    cents = mean_vectors(df, [label], array)
    long = cents.select(label, F.size("centroid").alias("d"), F.posexplode("centroid").alias("dim", "x"))
    a = long.select(F.col(label).alias("label_a"), "dim", "d", F.col("x").alias("xa"))
    b = long.select(F.col(label).alias("label_b"), "dim", F.col("x").alias("xb"))
    diff = F.col("xa") - F.col("xb")
    pairs = a.join(b, "dim").filter("label_a < label_b")
    return pairs.groupBy("label_a", "label_b").agg(F.sqrt(F.avg(diff * diff)).alias("rms"))


def nearest_centroid(
    df: DataFrame, label: str, array: str, test: DataFrame, key: str, few: int = 1000
) -> DataFrame:
    """Label of the closest centroid; ties go to the smallest label.

    The centroid table has one row per label. Up to ``few`` labels travel as
    one array value; more labels are found by the exact neighbour search.
    """
    cents = cut_lineage(mean_vectors(df, [label], array))
    if cents.count() > few:
        marks = cents.select(F.col(label).alias(key), F.col("centroid").alias(array))
        near = nearest_neighbours(marks, test.select(key, array), key, array, 1)
        return test.join(near.select(key, F.col("neighbour").alias("predicted")), key)
    packed = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "centroid"))).alias("__c"))
    rows = with_table_scalars(test, packed)
    scored = F.transform(
        "__c", lambda c: F.struct(squared_distance(as_doubles(array), c["centroid"]).alias("d"), c["l"].alias("l"))
    )
    return rows.withColumn("predicted", F.array_min(scored)["l"]).drop("__c")


# --- nearest neighbours ------------------------------------------------------------------

#: Rows of a cell and queries that meet in one task, and distances that a task holds at a time.
CELL_ROWS = 16_384
BLOCK_QUERIES = 32_768
BLOCK_CELLS = 4_000_000


def nearest_neighbours(
    train: DataFrame, test: DataFrame, key: str, array: str, k: int, pivots: int = 32, limit: int | None = None
) -> DataFrame:
    """Exact k nearest training rows of every test row, without a cross join.

    Training rows belong to the cell of their closest pivot. The triangle
    inequality gives each test row an upper bound on its k-th distance from
    the pivot distances alone, and rules out all cells (and rows inside a
    cell) that are farther; what is left meets on the cell, as blocks of queries
    against blocks of rows. Cells with many rows are salted.
    """
    tr = train.select(F.col(key).alias("__tk"), as_doubles(array).alias("__tv"))
    te = test.select(F.col(key).alias("__qk"), as_doubles(array).alias("__qv"))
    chosen = tr.withColumn("__d", F.xxhash64("__tk")).orderBy("__d", "__tk").limit(pivots)
    packed = cut_lineage(chosen.agg(F.collect_list("__tv").alias("__p")))

    def pivot_distances(df, vec):
        dist = F.transform("__p", lambda p: F.sqrt(squared_distance(F.col(vec), p)))
        return with_table_scalars(df, packed).withColumn("__pd", dist).drop("__p")

    cell = F.array_position("__pd", F.array_min("__pd")).cast("int") - 1
    tr = cut_lineage(
        pivot_distances(tr, "__tv").withColumn("__cell", cell).withColumn("__r", F.array_min("__pd")).drop("__pd")
    )
    # per cell: rows, radius, and the k smallest pivot distances
    w = Window.partitionBy("__cell").orderBy("__r")
    near = tr.select("__cell", "__r").withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= k)
    near = near.groupBy("__cell").agg(F.collect_list("__r").alias("near"))
    stats = tr.groupBy("__cell").agg(F.count("*").alias("n"), F.max("__r").alias("radius")).join(near, "__cell")
    per_task = limit or min(CELL_ROWS, hot_rows(tr.sparkSession))
    salts = F.ceil(F.col("n") / per_task).cast("int")
    cells = stats.agg(
        F.collect_list(F.struct("__cell", "radius", "near", salts.alias("salts"))).alias("__cells")
    )
    cells = cut_lineage(cells)

    te = with_table_scalars(pivot_distances(te, "__qv"), cells)
    to_cell = lambda c: F.get(F.col("__pd"), c["__cell"])
    bounds = F.flatten(F.transform("__cells", lambda c: F.transform(c["near"], lambda r: to_cell(c) + r)))
    upper = F.coalesce(F.get(F.array_sort(bounds), k - 1), F.lit(float("inf"))) * (1 + 1e-12)
    te = te.withColumn("__ub", upper)
    open_cells = F.filter("__cells", lambda c: to_cell(c) - c["radius"] <= F.col("__ub"))
    visits = te.withColumn("__c", F.explode(open_cells)).select(
        "__qk", "__qv", "__ub", F.col("__c")["__cell"].alias("__cell"),
        F.get("__pd", F.col("__c")["__cell"]).alias("__qp"),
        F.explode(F.sequence(F.lit(0), F.col("__c")["salts"] - 1)).alias("__salt"),
    )
    salted = with_table_scalars(tr, cells).withColumn(
        "__salts", F.get(F.filter("__cells", lambda c: c["__cell"] == F.col("__cell")), 0)["salts"]
    ).withColumn("__salt", F.pmod(F.xxhash64("__tk"), F.col("__salts")).cast("int")).drop("__cells", "__salts")
    # blocks of queries meet the rows of a cell; distances cost far more than their bytes, so keep the full parallelism
    n_blocks = max(1, math.ceil(te.count() / BLOCK_QUERIES))
    visits = visits.select("*", F.pmod(F.xxhash64("__qk"), F.lit(n_blocks)).alias("__block"))
    salted = salted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    visits, salted = _no_null(visits, "__qk"), _no_null(salted, "__tk")
    n = int(tr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ["__cell", "__salt", "__block"]
    visits, salted = visits.repartition(n, *at), salted.withColumnsRenamed({c: f"{c}_t" for c in at}).repartition(n, *[f"{c}_t" for c in at])
    types = [df.schema[c].dataType.simpleString() for df, c in ((visits, "__qk"), (salted, "__tk"))]
    scored = visits.groupBy(*at).cogroup(salted.groupBy(*[f"{c}_t" for c in at])).applyInPandas(
        _nearest_of(k), f"__qk {types[0]}, __qk_null boolean, __tk {types[1]}, __tk_null boolean, distance double"
    ).select(
        F.when(~F.col("__qk_null"), F.col("__qk")).alias(key), F.when(~F.col("__tk_null"), F.col("__tk")).alias("neighbour"), "distance"
    )
    wq = Window.partitionBy(key).orderBy("distance", "neighbour")
    return scored.withColumn("rank", F.row_number().over(wq)).filter(F.col("rank") <= k)


def _no_null(df: DataFrame, key: str) -> DataFrame:
    """NULL keys as a flag and a zero, so that pandas keeps whole numbers whole."""
    zero = F.lit(0).cast(df.schema[key].dataType)
    return df.withColumns({f"{key}_null": F.col(key).isNull(), key: F.coalesce(F.col(key), zero)})


def _nearest_of(k: int):
    """The k nearest of a cell's rows for each query that visits it.

    A matrix product rules out what is farther than the k-th by more than its
    rounding; what is left is measured exactly, coordinate by coordinate.
    """

    def per_cell(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame(columns=["__qk", "__qk_null", "__tk", "__tk_null", "distance"])
        t = t.sort_values(["__tk_null", "__tk"], ascending=[False, True], kind="stable")
        to, r = np.stack(t["__tv"].to_numpy()), t["__r"].to_numpy()
        norm = (to * to).sum(axis=1)
        step = max(1, BLOCK_CELLS // len(t))
        out = []
        for lo in range(0, len(q), step):
            part = q.iloc[lo : lo + step]
            own, bound = np.stack(part["__qv"].to_numpy()), part["__ub"].to_numpy()[:, None]
            near = (np.abs(part["__qp"].to_numpy()[:, None] - r) <= bound) | np.isnan(bound)
            square = (own * own).sum(axis=1)[:, None]
            about = np.where(near, square + norm - 2 * (own @ to.T), np.inf)
            if len(t) > k:
                last = np.partition(about, k - 1, axis=1)[:, k - 1 : k]
                near &= ~(about > last + 1e-9 * (square + norm.max()))
            i, j = np.nonzero(near)
            total = np.zeros(len(i))
            for c in range(to.shape[1]):
                x = own[i, c] - to[j, c]
                total += x * x
            total = np.sqrt(total)
            by = np.lexsort((j, total, i))
            i, j, total = i[by], j[by], total[by]
            some = np.arange(len(i)) - np.searchsorted(i, i) < k
            a, b = part.iloc[i[some]], t.iloc[j[some]]
            out.append(pd.DataFrame({
                "__qk": a["__qk"].to_numpy(), "__qk_null": a["__qk_null"].to_numpy(), "__tk": b["__tk"].to_numpy(), "__tk_null": b["__tk_null"].to_numpy(),
                "distance": total[some],
            }))
        return pd.concat(out)

    return per_cell


def vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Majority label of the k nearest; ties go to the smallest label."""
    near = neighbours.filter(F.col("rank") <= k).join(
        labels.select(F.col(key).alias("neighbour"), F.col(label).alias("__l")), "neighbour"
    )
    votes = near.groupBy(key, "__l").agg(F.count("*").alias("__n"))
    return votes.groupBy(key).agg(F.min_by("__l", F.struct(-F.col("__n"), F.col("__l"))).alias("predicted"))


def knn_classify(train: DataFrame, test: DataFrame, key: str, array: str, label: str, k: int) -> DataFrame:
    near = nearest_neighbours(train, test, key, array, k)
    return vote(near, train, key, label, k)


def knn_grid(
    train: DataFrame, test: DataFrame, key: str, array: str, label: str, ks: Sequence[int], dims: Sequence[int]
) -> DataFrame:
    """Accuracy for each (k, number of leading dimensions).

    Neighbours are found once per dimension count at the largest k; smaller k
    reuse the ranks.
    """
    parts = []
    for d in dims:
        cut = lambda df: df.withColumn(array, F.slice(array, 1, d))
        near = cut_lineage(nearest_neighbours(cut(train), cut(test), key, array, max(ks)))
        truth = test.select(key, F.col(label).alias("__t"))
        for k in ks:
            hit = vote(near, train, key, label, k).join(truth, key)
            parts.append(
                hit.agg(F.avg((F.col("predicted") == F.col("__t")).cast("int")).alias("accuracy")).select(
                    F.lit(k).alias("k"), F.lit(d).alias("dims"), "accuracy"
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# --- components, polynomials, forests ------------------------------------------------


def principal_components(df: DataFrame, array: str, k: int):
    """Fitted PCA on centred (not scaled) columns: model and projected rows."""
    rows = df.withColumn("__v", array_to_vector(as_doubles(array)))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c")
    pipe = Pipeline(stages=[scaler, PCA(k=k, inputCol="__c", outputCol="__pc")]).fit(rows)
    projected = pipe.transform(rows).withColumn("components", vector_to_array("__pc")).drop("__v", "__c", "__pc")
    return pipe.stages[-1], projected


def explained_variance(df: DataFrame, array: str, k: int) -> DataFrame:
    """Share of variance per component and its running total."""
    model, _ = principal_components(df, array, k)
    shares = [float(v) for v in model.explainedVariance]
    rows, total = [], 0.0
    for i, s in enumerate(shares, start=1):
        total += s
        rows.append((i, s, total))
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def polynomial_errors(
    df: DataFrame, x: str, y: str, degrees: Sequence[int], is_train: str
) -> DataFrame:
    """Train and test mean squared error of polynomial fits, x scaled to [0, 1]."""
    span = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    scaled = with_table_scalars(df.select(x, y, is_train), span).withColumn(
        "__x", (F.col(x) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    )
    rows = VectorAssembler(inputCols=["__x"], outputCol="__v").transform(scaled).persist()
    found = []
    for d in degrees:
        expand = PolynomialExpansion(degree=d, inputCol="__v", outputCol="__p")
        lr = LinearRegression(featuresCol="__p", labelCol=y, solver="normal", predictionCol="__hat")
        model = Pipeline(stages=[expand, lr]).fit(rows.filter(is_train))
        e = F.pow(F.col(y) - F.col("__hat"), F.lit(2.0))
        means = model.transform(rows).agg(F.avg(F.when(F.col(is_train), e)), F.avg(F.when(~F.col(is_train), e))).first()
        found.append((d, *means))  # one row per degree
    rows.unpersist()
    return df.sparkSession.createDataFrame(found, "degree int, train_mse double, test_mse double")


def forest_fit(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str, trees: int = 20, seed: int = 5, stages: Sequence = ()
):
    """Preprocessing (``stages`` in front) and random-forest regression as one fitted pipeline.

    There are at least 32 bins, and as many as the largest factor has levels.
    Stages may drop numeric columns.
    """
    levels = train.agg(*[F.count_distinct(c) for c in categorical]).first() if categorical else [0]
    bins = max(32, *levels) + 1  # one more for levels that appear later
    coded = [f"__i_{c}" for c in categorical]
    coding = [
        StringIndexer(inputCols=list(categorical), outputCols=coded, handleInvalid="keep", stringOrderType="alphabetAsc")
    ] if categorical else []
    return Pipeline(stages=[
        *stages, *coding, KeptColumns(inputCols=list(numeric), outputCol="__n"), VectorAssembler(inputCols=["__n", *coded], outputCol="__f"),
        RandomForestRegressor(featuresCol="__f", labelCol=y, predictionCol="prediction", numTrees=trees, seed=seed, maxBins=bins),
    ]).fit(train)


def best_rows(table: DataFrame, by: str) -> DataFrame:
    """Rows with the highest value, ties kept."""
    return table.filter(F.col(by) == table.agg(F.max(by)).scalar())
