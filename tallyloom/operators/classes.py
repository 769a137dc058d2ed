"""Grouping and mapping of classes by their terms: Gram matrix, Ward groups, classical scaling.

The vocabulary is used whole. What is left of it is one small row per pair of
classes; merging and scaling then work on these rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.core import store_and_reload, with_table_scalars

#: Columns that the search for axes carries besides those asked for.
SPARE_AXES = 16


def class_gram(shares: DataFrame, class_col: str, value: str = "p", term: str = "word") -> DataFrame:
    """(class_a, class_b, dot): sums of products over shared terms, for class_a <= class_b.

    A join on the term; a term has one row per class at most. Pairs without a
    shared term have no row.
    """
    side = lambda s: shares.select(term, F.col(class_col).alias(f"class_{s}"), F.col(value).alias(f"__{s}"))
    pairs = side("a").join(side("b"), term).filter("class_a <= class_b")
    return pairs.groupBy("class_a", "class_b").agg(F.sum(F.col("__a") * F.col("__b")).alias("dot"))


def _full(gram: DataFrame) -> DataFrame:
    """All ordered pairs of classes, 0 for pairs without a shared term. One row per pair of classes."""
    both = gram.union(gram.filter("class_a <> class_b").select("class_b", "class_a", "dot"))
    names = gram.filter("class_a = class_b").select(F.col("class_a").alias("c"))
    other = names.agg(F.collect_set("c").alias("class_b"))  # the classes, whose pairs are the result
    pairs = with_table_scalars(names.withColumnRenamed("c", "class_a"), other).select("class_a", F.explode("class_b").alias("class_b"))
    return pairs.join(both, ["class_a", "class_b"], "left").select("class_a", "class_b", F.coalesce("dot", F.lit(0.0)).alias("dot"))


# --- groups -------------------------------------------------------------------------


def ward_merges(gram: DataFrame) -> DataFrame:
    """(kept, merged, height): Ward's hierarchy of classes from the Gram matrix of their vectors.

    In each round all pairs of clusters that are each other's nearest merge;
    Ward's distance is reducible, so these are merges of the whole hierarchy.
    A cluster is named by its smallest class. The distance of two clusters,
    n_a n_b / (n_a + n_b) times the squared distance of their centres, is what
    the merge adds to the squares within clusters; it follows from summed dots.
    """
    state = store_and_reload(_full(gram).toDF("a", "b", "dot"), "ward")
    sizes = store_and_reload(state.filter("a = b").select("a", F.lit(1).cast("long").alias("n")), "ward-sizes")
    merges = None
    while True:
        own = state.filter("a = b").join(sizes, "a").select("a", "n", (F.col("dot") / (F.col("n") * F.col("n"))).alias("sq"))
        d = state.filter("a <> b").join(own.toDF("a", "na", "sq_a"), "a").join(own.toDF("b", "nb", "sq_b"), "b")
        na, nb = F.col("na"), F.col("nb")
        d = d.withColumn("d", na * nb / (na + nb) * (F.col("sq_a") + F.col("sq_b") - 2 * F.col("dot") / (na * nb)))
        near = d.groupBy("a").agg(F.min(F.struct("d", F.least("a", "b").alias("kept"), F.greatest("a", "b").alias("merged"))).alias("m"))
        both = near.groupBy("m.kept", "m.merged").agg(F.count("*").alias("n"), F.min("m.d").alias("height")).filter("n = 2")
        both = store_and_reload(both.select("kept", "merged", "height"), "ward-merges")
        if both.isEmpty():
            break
        merges = both if merges is None else merges.union(both)

        def renamed(table, end, both=both):
            up = both.select(F.col("merged").alias(end), F.col("kept").alias("__up"))
            return table.join(up, end, "left").withColumn(end, F.coalesce("__up", end)).drop("__up")

        state = store_and_reload(renamed(renamed(state, "a"), "b").groupBy("a", "b").agg(F.sum("dot").alias("dot")), "ward")
        sizes = store_and_reload(renamed(sizes, "a").groupBy("a").agg(F.sum("n").alias("n")), "ward-sizes")
    if merges is None:
        return gram.select(F.col("class_a").alias("kept"), F.col("class_b").alias("merged"), F.lit(0.0).alias("height")).filter("false")
    return merges


def ward_groups(gram: DataFrame, k: int) -> DataFrame:
    """(class, cluster): Ward's hierarchy cut at ``k`` clusters, each named by its smallest class."""
    merges = store_and_reload(ward_merges(gram), "ward-hierarchy")
    above = merges.orderBy(F.desc("height"), F.desc("merged")).limit(max(0, k - 1)).select("merged")
    top = merges.join(above, "merged", "left_anti").select("merged", F.col("kept").alias("__top"))
    while True:  # each step doubles the way that is known towards the top
        jump = top.select(F.col("merged").alias("__top"), F.col("__top").alias("__next"))
        steps = store_and_reload(top.join(jump, "__top", "left"), "ward-cut")
        top = steps.select("merged", F.coalesce("__next", "__top").alias("__top"))
        if steps.filter("__next IS NOT NULL").isEmpty():
            break
    classes = gram.filter("class_a = class_b").select(F.col("class_a").alias("class"))
    both = classes.join(top, classes["class"] == top["merged"], "left")
    return both.select("class", F.coalesce("__top", "class").alias("cluster"))


# --- maps ---------------------------------------------------------------------------


def class_dissimilarity(gram: DataFrame, shares: DataFrame, class_col: str, value: str = "p", term: str = "word") -> DataFrame:
    """(class_a, class_b, d): 1 - correlation of the classes' shares over the whole vocabulary, for all ordered pairs.

    Terms absent from a class count as 0. A class without variance has
    dissimilarity 1 to all others.
    """
    whole = shares.agg(F.count_distinct(term).alias("__v"))
    sums = shares.groupBy(F.col(class_col).alias("c")).agg(F.sum(value).alias("s"))
    both = with_table_scalars(_full(gram), whole)
    own = gram.filter("class_a = class_b").select(F.col("class_a").alias("c"), F.col("dot").alias("sq")).join(sums, "c")
    both = both.join(own.toDF("class_a", "sq_a", "s_a"), "class_a").join(own.toDF("class_b", "sq_b", "s_b"), "class_b")
    v = F.col("__v")
    spread = lambda x: F.sqrt(F.greatest(v * F.col(f"sq_{x}") - F.col(f"s_{x}") * F.col(f"s_{x}"), F.lit(0.0)))
    under = spread("a") * spread("b")
    r = F.when(under > 0, (v * F.col("dot") - F.col("s_a") * F.col("s_b")) / under).otherwise(0.0)
    return both.select("class_a", "class_b", F.when(F.col("class_a") == F.col("class_b"), 0.0).otherwise(1 - r).alias("d"))


def centred_matrix(distances: DataFrame) -> DataFrame:
    """(class_a, class_b, v): -1/2 of the squared distances (all ordered pairs), centred by rows and columns."""
    sq = distances.withColumn("__d", F.col("d") * F.col("d"))
    means = sq.groupBy("class_a").agg(F.avg("__d").alias("__m"))  # rows and columns are alike
    both = sq.join(means, "class_a").join(means.toDF("class_b", "__mb"), "class_b")
    both = with_table_scalars(both, sq.agg(F.avg("__d").alias("__all")))
    return both.select("class_a", "class_b", (-(F.col("__d") - F.col("__m") - F.col("__mb") + F.col("__all")) / 2).alias("v"))


def _products(rows: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Sums over all rows of the outer products of the array columns, first with each."""

    def per_task(batches):
        total = None
        for b in batches:
            arrays = [np.array(b.column(n).to_pylist()) for n in names]
            if len(arrays[0]):
                own = np.stack([arrays[-1].T @ a for a in arrays])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.ravel().tolist()])})

    parts = [np.array(r["m"]) for r in rows.select(*names).mapInArrow(per_task, "m array<double>").collect()]  # a small matrix per task
    size = int(round((len(parts[0]) / len(names)) ** 0.5))
    return list(sum(parts).reshape(len(names), size, size))


def _turned(rows: DataFrame, column: str, matrix: np.ndarray) -> DataFrame:
    """(id, x): the array column times a small matrix."""

    def per_batch(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(column).to_pylist()) @ matrix
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", column).mapInArrow(per_batch, f"id {kind}, x array<double>")


def _whitening(gram: np.ndarray) -> np.ndarray:
    """A matrix that makes vectors with this Gram matrix orthonormal; directions without length are dropped."""
    w, v = np.linalg.eigh((gram + gram.T) / 2)
    some = w > 1e-13 * w[-1] if w[-1] > 0 else np.zeros(len(w), bool)
    return v[:, some] / np.sqrt(w[some])


def leading_axes(matrix: DataFrame, k: int, tolerance: float = 1e-9, max_rounds: int = 1000) -> tuple[DataFrame, list[float]]:
    """(id, x) with the ``k`` leading unit eigenvectors of a symmetric matrix (class_a, class_b, v), and their values.

    Orthogonal iteration with a few spare columns: a round is one join and sum;
    only matrices of the size of these columns reach the driver. Ends when the
    residual of every leading pair is below ``tolerance`` times the largest
    value, and raises where ``max_rounds`` are not enough. The first class with
    a coordinate that is not 0 has a positive one on each axis.
    """
    matrix = store_and_reload(matrix, "axes-matrix")
    ids = matrix.select(F.col("class_a").alias("id")).distinct()
    n = ids.count()
    if n == 0:
        return ids.withColumn("x", F.array().cast("array<double>")), []
    wide = min(n, k + SPARE_AXES)
    draw = F.array(*[F.xxhash64("id", F.lit(j)) / float(2**63) for j in range(wide)])
    x = store_and_reload(ids.withColumn("x", draw), "axes")
    x = store_and_reload(_turned(x, "x", _whitening(_products(x, ["x"])[0])), "axes")
    shift = 0.0
    for _ in range(max_rounds):
        size = len(x.first()["x"])
        sums = F.array(*[F.sum(F.col("v") * F.col("x")[j]) for j in range(size)])
        y = matrix.join(x, F.col("class_b") == F.col("id")).groupBy(F.col("class_a").alias("id")).agg(sums.alias("y"))
        y = store_and_reload(y.join(x, "id"), "axes")
        t, g = _products(y, ["x", "y"])  # y'x and y'y
        t = (t + t.T) / 2
        values, turn = np.linalg.eigh(t)
        values, turn = values[::-1], turn[:, ::-1]
        lead = turn[:, :k]
        error = np.sqrt(np.maximum(0, np.einsum("ij,ik,kj->j", lead, g, lead) - values[: lead.shape[1]] ** 2))
        if (error <= tolerance * max(np.abs(values).max(), 1e-300)).all() or size == n:
            break
        shift = max(shift, -float(values[-1]))  # values far below 0 must not hide leading ones
        both = F.zip_with("y", "x", lambda a, b: a + F.lit(shift) * b)
        y = y.select("id", both.alias("z"))
        x = store_and_reload(_turned(y, "z", _whitening(g + 2 * shift * t + shift**2 * np.eye(size))), "axes")
    else:
        raise RuntimeError("axes did not settle within max_rounds")
    found = store_and_reload(_turned(y, "x", lead), "axes")
    m = lead.shape[1]
    first = [F.min_by(F.signum(F.col("x")[j]), F.when(F.abs(F.col("x")[j]) > 1e-7, F.col("id"))) for j in range(m)]
    signs = found.agg(F.array(*first).alias("__s"))
    out = with_table_scalars(found, signs).select("id", F.zip_with("x", "__s", lambda a, s: a * F.coalesce(s, F.lit(1.0))).alias("x"))
    return out, [float(v) for v in values[:m]]


def map_classes(distances: DataFrame, k: int, tolerance: float = 1e-9) -> DataFrame:
    """(class, coords): classical scaling of distances (class_a, class_b, d; all ordered pairs) to ``k`` axes.

    Axes with a value of 0 or less hold zeros, as distances need not be those of points.
    """
    axes, values = leading_axes(centred_matrix(distances), k, tolerance)
    scale = F.array(*[F.lit(float(np.sqrt(max(v, 0.0)))) for v in values]) if values else F.array().cast("array<double>")
    return axes.select(F.col("id").alias("class"), F.zip_with("x", scale, lambda a, s: a * s).alias("coords"))
